import math

import pytest
from pyspark.sql import functions as F

from pitlane.operators import panel as panels
from pitlane.operators.dedupe import last_wins_filings
from pitlane.operators.panel import (
    FEATURES, REQUIRED_FIELDS, cross_sections, demean, features_at, rank_normalise, scale_by_assets,
)
from pitlane.operators.universe import (
    active_since, members_on, membership_spells, reconcile, sector_codes, select_tickers,
)
from pitlane.plans.fixtures import Tables
from pitlane.plans.queries_ablation import cell_panels
from pitlane.plans.queries_panel import panel
from tests.helpers import day, frame, tuples

SPELL = "ticker string, start_date date, end_date date"


def spells_by_rule(events):
    """The rule restated over a list, as a check."""
    ev = sorted((t, d, a) for d, a, t in events if a in ("added", "removed"))
    first = min(d for _, d, _ in ev)
    with_add = {t for t, _, a in ev if a == "added"}
    out = []
    for ticker in sorted({t for t, _, _ in ev}):
        start = None
        for _, d, a in [e for e in ev if e[0] == ticker]:
            if a == "added":
                start = start or d
                continue
            if start is None:
                if ticker in with_add:
                    continue
                start = first
            last = d.fromordinal(d.toordinal() - 1)
            if last >= start:
                out.append((ticker, start, last))
            start = None
        if start:
            out.append((ticker, start, None))
    return sorted(out, key=str)


def test_spells(spark):
    events = [
        ("2000-01-01", "added", "A"), ("2001-01-01", "added", "A"), ("2002-01-01", "removed", "A"),
        ("2003-01-01", "removed", "A"), ("2004-01-01", "added", "A"),
        ("2000-06-01", "removed", "B"), ("2001-06-01", "added", "B"), ("2001-06-01", "removed", "B"),
        ("2005-01-01", "removed", "C"), ("2006-01-01", "removed", "C"), ("1999-12-01", "removed", "D"),
        ("2010-01-01", "current", "A"), ("2002-03-03", "added", "E"), ("2002-03-04", "removed", "E"),
    ]
    rows = [(day(d), a, t) for d, a, t in events]
    df = frame(spark, rows, "date date, action string, ticker string")
    out = membership_spells(df)
    assert sorted(tuples(out.select("ticker", "start_date", "end_date")), key=str) == spells_by_rule(rows)
    assert {r["ticker"] for r in out.where("anchored").collect()} == {"C"}
    assert tuples(reconcile(out, df)) == []


def test_members_by_interval(spark):
    members = frame(
        spark,
        [("AAA", day("2005-01-01"), None), ("BBB", day("2008-01-01"), day("2012-01-01")), ("BBB", day("2015-01-01"), None)],
        SPELL,
    )
    days = frame(spark, [(day(f"{y}-06-01"),) for y in (2004, 2006, 2009, 2013, 2016)] + [(day("2012-01-01"),)], "date date")
    got = tuples(members_on(days, members).select("date", "ticker"))
    assert got == [
        (day("2006-06-01"), "AAA"), (day("2009-06-01"), "AAA"), (day("2009-06-01"), "BBB"), (day("2012-01-01"), "AAA"),
        (day("2012-01-01"), "BBB"), (day("2013-06-01"), "AAA"), (day("2016-06-01"), "AAA"), (day("2016-06-01"), "BBB"),
    ]
    assert {r["ticker"] for r in active_since(members, "2013-01-01").collect()} == {"AAA", "BBB"}


def test_sector_codes_and_selection(spark):
    rows = [("A", "SF1", "Domestic Common Stock", "Tech"), ("B", "SF1", "Domestic Common Stock", "Energy"),
            ("C", "SEP", "Domestic Common Stock", "Auto"), ("D", "SF1", "ADR Common Stock", "Auto"),
            ("E", "SF1", "Domestic Common Stock", None)]
    df = frame(spark, rows, "ticker string, table string, category string, sector string")
    assert tuples(sector_codes(df).select("ticker", "industry")) == [("A", 1), ("B", 0)]
    texts = frame(spark, [(" msft, aapl,,MSFT ",)], "text string")
    assert [r["ticker"] for r in select_tickers(texts, "text", limit=1).collect()] == ["MSFT"]
    assert [r["ticker"] for r in select_tickers(texts, "text").collect()] == ["MSFT", "AAPL", "MSFT"]


def test_last_filing_wins(spark):
    rows = [("A", "ART", day("2020-01-01"), day("2020-01-02"), 1.0), ("A", "ART", day("2020-01-01"), day("2020-02-02"), 2.0)]
    df = frame(spark, rows, "ticker string, dimension string, datekey date, lastupdated date, v double")
    assert [r["v"] for r in last_wins_filings(df).collect()] == [2.0]


def filing(ticker, date, **values):
    return (ticker, "ART", day(date), *[values.get(f) for f in REQUIRED_FIELDS])


FILING = "ticker string, dimension string, datekey date, " + ", ".join(f"{f} double" for f in REQUIRED_FIELDS)


def test_feature_values(spark):
    rows = [
        filing("A", "2020-06-01", roa=0.10, revenue=100.0, eps=4.0),
        filing("A", "2021-06-30", roa=0.12, revenue=110.0, eps=5.0, gp=40.0, assets=200.0, netinc=10.0, ncfo=25.0, debt=50.0),
    ]
    keys = frame(spark, [("A", day("2021-06-30")), ("A", day("2021-06-29"))], "ticker string, date date")
    out = {r["date"]: r for r in features_at(keys, frame(spark, rows, FILING)).collect()}
    now = out[day("2021-06-30")]
    assert len(FEATURES) == 47
    assert now["gross_profitability"] == 0.2 and now["accruals_to_assets"] == -0.075 and now["debt_to_assets"] == 0.25
    assert now["delta_roa"] == pytest.approx(0.02) and now["revenue_growth"] == pytest.approx(0.10)
    assert now["eps_change"] == 1.0 and now["interest_coverage"] is None
    # The day before, the newer filing is not yet known.
    assert out[day("2021-06-29")]["gp"] is None


def test_scale_by_assets(spark):
    cols = ", ".join(f"{c} double" for c in FEATURES)
    base = {"revenue": 50.0, "eps": 3.0, "roe": 0.5}
    rows = [tuple({**base, "assets": a}.get(c) for c in FEATURES) for a in (200.0, 0.0)]
    good, bad = scale_by_assets(frame(spark, rows, cols)).orderBy(F.col("assets").desc_nulls_last()).collect()
    assert good["revenue"] == 0.25 and good["assets"] == pytest.approx(math.log(200)) and good["eps"] == 3.0
    assert bad["revenue"] is None and bad["assets"] is None and bad["eps"] == 3.0


def test_rank_normalise(spark):
    df = frame(spark, [("d", "A", 10.0, 1.0), ("d", "B", None, None), ("d", "C", 30.0, None), ("d", "D", 20.0, None)],
               "date string, ticker string, x double, y double")
    got = {(r["ticker"], r["feature"]): r["z"] for r in rank_normalise(df, ["x", "y"]).collect()}
    assert got == {("A", 0): -1.0, ("C", 0): 1.0, ("D", 0): 0.0, ("A", 1): 0.0}


def _market(spark, caps):
    dates = frame(spark, [(day("2021-06-30"),), (day("2021-07-31"),)], "date date")
    members = frame(spark, [(t, day("2000-01-01"), None) for t in caps], SPELL)
    cap = frame(spark, [(t, day(d), v) for t, v in caps.items() for d in ("2021-06-28", "2021-07-30")],
                "ticker string, date date, marketcap double")
    values = {f: 1.0 for f in ("revenue", "gp", "opinc", "ebit", "netinc", "ebitda", "eps", "epsdil", "debt", "fcf")}
    equity = {"A": 100.0, "B": 200.0, "C": -5.0}
    fund = frame(spark, [filing(t, "2021-01-01", **values, equity=equity.get(t, 50.0)) for t in caps], FILING)
    return dates, members, cap, fund


def test_panel_targets(spark):
    dates, members, caps, fund = _market(spark, {"A": 1000.0, "B": 4000.0, "C": 10.0, "D": 0.0})
    book = cross_sections(dates, members, caps, fund, target="mb", min_names=2)
    got = {(r["date"], r["ticker"]): r["target"] for r in book.collect()}
    gap = (math.log(10) - math.log(20)) / 2
    assert got[(day("2021-06-30"), "A")] == pytest.approx(gap) and got[(day("2021-06-30"), "B")] == pytest.approx(-gap)
    # C has no positive equity, D no positive market value.
    assert {t for _, t in got} == {"A", "B"}
    assert cross_sections(dates, members, caps, fund, target="mb", min_names=3).count() == 0
    prices = frame(
        spark, [("A", day("2021-06-30"), 100.0), ("A", day("2021-07-31"), 110.0), ("B", day("2021-06-30"), 100.0),
                ("B", day("2021-07-31"), 90.0), ("C", day("2021-06-30"), 5.0)], "ticker string, date date, close double")
    ret = {(r["date"], r["ticker"]): r["target"] for r in
           cross_sections(dates, members, caps, fund, target="ret", prices=prices, min_names=2).collect()}
    assert ret[(day("2021-06-30"), "A")] == pytest.approx(0.1) and ret[(day("2021-06-30"), "C")] is None
    assert ret[(day("2021-07-31"), "A")] is None
    with pytest.raises(ValueError):
        cross_sections(dates, members, caps, fund, target="ret")


def test_demean_skips_missing(spark):
    df = frame(spark, [("d", 1.0), ("d", 3.0), ("d", None)], "date string, y double")
    assert sorted((r["y"] for r in demean(df, "y").collect()), key=str) == [-1.0, 1.0, None]


def test_spells_are_not_shuffled_by_month(spark):
    """Dates are few: they are sent to the spells, however many names there are."""
    spells = frame(spark, [("A", day("2020-01-10"), None), ("B", day("2020-02-01"), day("2020-02-20"))],
                   "ticker string, start_date date, end_date date")
    dates = frame(spark, [(day("2020-01-31"),), (day("2020-02-15"),)], "date date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = members_on(dates, spells)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert tuples(out) == [("A", day("2020-01-31")), ("A", day("2020-02-15")), ("B", day("2020-02-15"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_members_come_once_without_being_gathered(spark):
    """Spells of a name that overlap or touch give each date once, and no aggregate sees the members of all dates."""
    days = frame(spark, [(day(d),) for d in ("2020-01-31", "2020-02-15", "2020-03-31")], "date date")
    spells = frame(spark, [("A", day("2020-01-01"), day("2020-02-20")), ("A", day("2020-02-01"), None),
                           ("B", day("2020-02-16"), day("2020-03-30")), ("C", day("2020-02-15"), day("2020-02-15")),
                           ("C", day("2020-02-16"), day("2020-02-14"))], SPELL)
    out = members_on(days, spells)
    assert tuples(out.select("ticker", "date")) == [
        ("A", day("2020-01-31")), ("A", day("2020-02-15")), ("A", day("2020-03-31")), ("C", day("2020-02-15"))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" not in plan[:plan.index("Generate")]


def test_targets_share_one_table_of_the_features_they_need(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(panels, "cut", lambda df: stored.append(df.columns) or df)
    t = Tables(spark, "/root/testdata/sf0.001")
    both = cell_panels(t, ["revenue", "assets", "equity"])
    assert sorted(both) == ["cap", "mb"]
    assert stored == [["ticker", "date", "marketcap", "revenue", "assets", "equity", "n_features"]]


def test_return_labels_do_not_carry_features(spark, monkeypatch):
    """Labels are worked out on names and dates, so the features are stored once, with the label."""
    stored = []
    monkeypatch.setattr(panels, "cut", lambda df: stored.append(df.columns) or df)
    panel(Tables(spark, "/root/testdata/sf0.001"), "ret")
    assert len(stored) == 1 and "target" in stored[0]


def test_ranks_travel_as_one_number(spark):
    rows = [(day(f"2020-0{m}-01"), f"T{i:02d}", None if i % 5 == m else float(i * 7 % 11), float(i % 2) if m == 1 else None)
            for m in (1, 2) for i in range(23)] + [(day("2020-03-01"), "T01", 1.0, None), (day("2020-03-01"), "T02", None, None)]
    table = frame(spark, rows, "date date, ticker string, a double, b double")
    got = panels.rank_vectors(table, ["a", "b"])
    want = panels.feature_vectors(rank_normalise(table, ["a", "b"]), 2)
    assert tuples(got) == tuples(want) and got.schema["x"].dataType == want.schema["x"].dataType
    assert "collect_list(_code" in got._jdf.queryExecution().executedPlan().toString()
