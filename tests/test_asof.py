import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitlane.operators.asof import asof_join, forward_return, series
from pitlane.operators.ordered import previous, row_index, running, shifted
from tests.helpers import day, frame, tuples

BASE = dt.date(2020, 1, 1)


def _random_tables(spark):
    rng = random.Random(5)
    facts, probes = [], []
    for t in ("A", "B", "C"):
        # Key A holds nearly all rows.
        n = 400 if t == "A" else 12
        for d in sorted(rng.sample(range(1500), n)):
            facts.append((t, BASE + dt.timedelta(days=d), float(rng.randrange(1000)) if rng.random() > 0.2 else None))
        for d in rng.sample(range(-20, 1600), n):
            probes.append((t, BASE + dt.timedelta(days=d)))
    probes.append(("Z", BASE))
    return (
        frame(spark, probes, "ticker string, d date"),
        frame(spark, facts, "ticker string, date date, v double"),
        facts,
        probes,
    )


@pytest.mark.parametrize("span_days", [None, 30])
@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_equals_search(spark, span_days, direction, strict):
    left, right, facts, probes = _random_tables(spark)
    got = {
        (r["ticker"], r["d"]): (r["seen"], r["v"])
        for r in asof_join(left, right, ["ticker"], "d", "date", ["v"], direction=direction, strict=strict,
                           matched_ts="seen", span_days=span_days).collect()
    }
    by = {}
    for t, d, v in facts:
        by.setdefault(t, []).append((d, v))
    for t, d in probes:
        rows = by.get(t, [])
        dates = [x for x, _ in rows]
        if direction == "backward":
            i = (bisect.bisect_left if strict else bisect.bisect_right)(dates, d) - 1
        else:
            i = (bisect.bisect_right if strict else bisect.bisect_left)(dates, d)
        want = rows[i] if 0 <= i < len(rows) else (None, None)
        assert got[(t, d)] == want
    assert len(got) == len(set(probes))


def test_filing_is_read_as_a_row_but_series_fall_back(spark):
    filings = frame(
        spark, [("AAA", day("2020-02-15"), 100.0, 5.0), ("AAA", day("2020-05-15"), 110.0, None)],
        "ticker string, datekey date, revenue double, netinc double",
    )
    asked = frame(spark, [("AAA", day("2020-06-01"))], "ticker string, date date")
    row = asof_join(asked, filings, ["ticker"], "date", "datekey", ["revenue", "netinc"]).first()
    assert (row["revenue"], row["netinc"]) == (110.0, None)
    known = asof_join(asked, series(filings, "netinc"), ["ticker"], "date", "datekey", ["netinc"]).first()
    assert known["netinc"] == 5.0


def test_tolerance_counts_days(spark):
    facts = frame(spark, [("A", day("2020-01-01"), 1.0)], "ticker string, fd date, v double")
    asked = frame(spark, [("A", day("2020-01-11")), ("A", day("2020-01-12"))], "ticker string, date date")
    out = asof_join(asked, facts, ["ticker"], "date", "fd", ["v"], tolerance_days=10)
    assert tuples(out) == [("A", day("2020-01-11"), 1.0), ("A", day("2020-01-12"), None)]


def test_forward_return_rules(spark):
    prices = frame(
        spark,
        [("A", day("2021-06-30"), 100.0), ("A", day("2021-07-31"), 110.0), ("B", day("2021-06-30"), 100.0),
         ("B", day("2021-07-31"), 90.0), ("C", day("2021-06-30"), 50.0), ("D", day("2021-06-01"), 50.0),
         ("D", day("2021-07-20"), 60.0), ("E", day("2021-06-30"), 0.0), ("E", day("2021-07-31"), 1.0)],
        "ticker string, date date, close double",
    )
    rows = [(t, day("2021-06-30"), day("2021-07-31")) for t in "ABCDE"] + [("A", day("2021-07-31"), None)]
    asked = frame(spark, rows, "ticker string, date date, next_date date")
    got = {(r["ticker"], r["date"]): r["ret"] for r in forward_return(asked, prices).collect()}
    assert got[("A", day("2021-06-30"))] == pytest.approx(0.1)
    assert got[("B", day("2021-06-30"))] == pytest.approx(-0.1)
    # C never trades again, D's entry is stale, E starts at zero, the last date has no next one.
    assert [got[(t, day("2021-06-30"))] for t in "CDE"] == [None, None, None]
    assert got[("A", day("2021-07-31"))] is None
    loose = {r["ticker"]: r["ret"] for r in forward_return(asked, prices, stale_days=None, need_later_exit=False).collect()
             if r["next_date"]}
    assert loose["D"] == pytest.approx(0.2) and loose["C"] == 0.0


@pytest.mark.parametrize("span_days", [None, 20])
def test_ordered_scans(spark, span_days):
    rows = [("A", BASE + dt.timedelta(days=3 * i), float(i)) for i in range(60)] + [("B", BASE, 7.0)]
    df = frame(spark, rows, "ticker string, date date, x double")
    prev = {(r["ticker"], r["date"]): r["p"] for r in previous(df, ["ticker"], "date", {"p": "x"}, span_days=span_days).collect()}
    cum = {(r["ticker"], r["date"]): r["s"] for r in running(df, ["ticker"], "date", {"s": F.col("x")}, span_days=span_days).collect()}
    numbered = row_index(df, ["ticker"], "date", span_days=span_days)
    back = {(r["ticker"], r["date"]): r["b"] for r in shifted(numbered, ["ticker"], "idx", 5, {"b": "x"}).collect()}
    for i in range(60):
        key = ("A", rows[i][1])
        assert prev[key] == (float(i - 1) if i else None)
        assert cum[key] == sum(range(i + 1))
        assert back[key] == (float(i - 5) if i >= 5 else None)
    assert prev[("B", BASE)] is None and len(prev) == 61
