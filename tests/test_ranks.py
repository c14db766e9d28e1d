import random
import statistics

import pytest
from pyspark.sql import functions as F

from pitlane.operators.ranks import exact_median, ordinal_rank, rank_table, top_k
from tests.helpers import frame, tuples


def _rows():
    rng = random.Random(3)
    # One date and one value hold most of the rows.
    rows = [("hot", f"T{i:04d}", 0.0 if rng.random() < 0.6 else rng.random()) for i in range(800)]
    rows += [("cold", f"T{i:04d}", float(i % 3)) for i in range(9)]
    return rows


def test_ordinal_and_average_ranks(spark):
    rows = _rows()
    df = frame(spark, rows, "date string, ticker string, x double")
    got = {(r["date"], r["ticker"]): (r["rn"], r["n"]) for r in
           ordinal_rank(df, ["date"], [F.col("x"), F.col("ticker")]).collect()}
    avg = {(r["date"], r["ticker"]): r["rank"] for r in df.join(rank_table(df, ["date"], "x"), ["date", "x"]).collect()}
    for date in ("hot", "cold"):
        mine = sorted((x, t) for d, t, x in rows if d == date)
        for i, (x, t) in enumerate(mine):
            assert got[(date, t)] == (i + 1, len(mine))
            same = [j + 1 for j, (y, _) in enumerate(mine) if y == x]
            assert avg[(date, t)] == pytest.approx(sum(same) / len(same))


@pytest.mark.parametrize("values,mid,upper", [([1, 2, 4, 10], 3.0, 4.0), ([5, 1, 1], 1.0, 1.0), ([7], 7.0, 7.0)])
def test_median(spark, values, mid, upper):
    df = frame(spark, [("a", float(v)) for v in values] + [("a", None)], "g string, x double")
    assert exact_median(df, ["g"], "x").first()["median"] == mid
    assert exact_median(df, [], "x", upper=True).first()["median"] == upper


def test_one_value_over_a_whole_date(spark):
    df = frame(spark, [("d", f"T{i:03d}", 1.0) for i in range(500)], "date string, ticker string, x double")
    assert rank_table(df, ["date"], "x").collect()[0]["rank"] == 250.5
    got = ordinal_rank(df, ["date"], [F.col("x"), F.col("ticker")]).collect()
    assert {r["ticker"]: r["rn"] for r in got} == {f"T{i:03d}": i + 1 for i in range(500)}


def test_top_k(spark):
    df = frame(spark, [("d", "B", 2.0), ("d", "A", 2.0), ("d", "C", 1.0)], "date string, ticker string, score double")
    out = top_k(df, ["date"], [F.col("score").desc(), F.col("ticker")], 2)
    assert tuples(out.select("ticker", "rank")) == [("A", 1), ("B", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    with pytest.raises(ValueError):
        top_k(df, ["date"], [F.col("ticker")], 0)


def test_median_orders_only_the_middle(spark):
    """Many values, ties at the middle and several groups; no row is compared with a list of cuts."""
    rng = random.Random(2)
    sizes = {"a": 20_001, "b": 6_000, "c": 2, "d": 1}
    rows = [(g, rng.choice((0.0, 0.5, rng.random()))) for g, n in sizes.items() for _ in range(n)]
    df = frame(spark, [*rows, ("e", None)], "g string, x double")
    for few in (False, True):
        out = exact_median(df, ["g"], "x", few=few)
        assert {r["g"]: (r["median"], r["n"]) for r in out.collect()} == {
            g: (statistics.median(v for k, v in rows if k == g), n) for g, n in sizes.items()}
    whole = exact_median(df, [], "x", upper=True)
    assert whole.first()["median"] == statistics.median_high(v for _, v in rows)
    assert "_cuts" not in whole._jdf.queryExecution().toString()


def test_ranked_rows_carry_no_copy_of_their_key(spark):
    df = frame(spark, [("g", float(i % 7), f"T{i}") for i in range(50)], "g string, v double, ticker string")
    plan = ordinal_rank(df, ["g"], [F.col("v"), F.col("ticker")])._jdf.queryExecution().executedPlan().toString()
    assert "_key" not in plan


def test_ranks_of_few_groups_shuffle_rows_once(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice((0.0, rng.random())), f"T{i:05d}") for g, n in (("a", 4000), ("b", 40), ("c", 1)) for i in range(n)]
    df = frame(spark, rows, "g string, v double, ticker string")
    order = [F.col("v"), F.col("ticker")]
    ranked = ordinal_rank(df, ["g"], order, few=True)
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
    want = {(g, t): (i + 1, sum(r[0] == g for r in rows)) for g in "abc"
            for i, (_, _, t) in enumerate(sorted(r for r in rows if r[0] == g))}
    for got in (ranked, ordinal_rank(df, ["g"], order), ordinal_rank(df, ["g"], order, cuts=3)):
        assert {(r["g"], r["ticker"]): (r["rn"], r["n"]) for r in got.collect()} == want
