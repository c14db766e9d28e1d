import itertools
import math

import pytest
from pyspark.sql import functions as F

from pitlane.functions.scalar import guarded_div, mid_price, normal_cdf, normal_ppf, round_half_up, slipped
from pitlane.operators.crossval import (
    combination, combinatorial_purged, contiguous_blocks, folds, overlap, purged_kfold,
)
from pitlane.operators.evaluation import metric_spread, per_window, rolling_windows
from pitlane.operators.inference import (
    check_family, deflate, expected_max_sharpe, probabilistic_sharpe, trial_sharpes, verdict,
)
from pitlane.operators.metrics import drawdown, growth, returns, run_metrics, summary_text
from pitlane.operators.signals import (
    decile_spread, newey_west, rank_ic, rolling_mean_ic, signal_months, signal_summary, spread_growth,
)
from tests.helpers import day, frame, tuples

EQ = "run_id string, ts date, equity double, level double"


def _curve(spark, equity, level=None, run="r"):
    level = level or [None] * len(equity)
    rows = [(run, day(f"2020-01-{i + 1:02d}"), e, b) for i, (e, b) in enumerate(zip(equity, level))]
    return frame(spark, rows, EQ)


def test_returns_and_curves(spark):
    df = _curve(spark, [100.0, 110.0, 99.0])
    assert [r["ret"] for r in returns(df).orderBy("ts").collect()] == [None, pytest.approx(0.1), pytest.approx(-0.1)]
    assert [r["drawdown"] for r in drawdown(df).orderBy("ts").collect()] == [0.0, 0.0, pytest.approx(-0.1)]
    gaps = _curve(spark, [1.0, 1.0, 1.0, 1.0], [None, 50.0, None, 75.0])
    assert [r["growth"] for r in growth(gaps, value="level").orderBy("ts").collect()] == [None, 1.0, None, 1.5]
    assert returns(_curve(spark, [0.0, 5.0, 10.0])).where("ret IS NOT NULL").count() == 1


def test_benchmark_metrics(spark):
    df = _curve(spark, [100.0, 110.0, 104.5, 125.4], [100.0, 104.0, 101.92, 108.0352])
    m = run_metrics(df).first()
    assert m["benchmark_return"] == pytest.approx(0.080352)
    assert m["beta"] == pytest.approx(2.9807692307)
    assert m["total_return"] == pytest.approx(0.254)
    assert m["active_return"] == pytest.approx(0.254 - 0.080352)
    assert m["max_drawdown"] == pytest.approx(-0.05) and m["turnover"] == 0.0
    years = 3 * 86400 / 31_557_600
    assert m["cagr"] == pytest.approx(math.exp(math.log(1.254) / years) - 1)
    flat = run_metrics(_curve(spark, [100.0, 100.0, 100.0])).first()
    assert flat["sharpe_ratio"] is None and flat["volatility"] == 0.0 and flat["beta"] is None
    text = summary_text(run_metrics(df).withColumn("beta", F.lit(None).cast("double"))).first()
    assert text["final_equity"] == "125.40 USD" and text["beta"] == "n/a" and text["total_return"] == "25.40 %"
    with pytest.raises(ValueError):
        run_metrics(df, periods=0)


def test_fills_make_turnover(spark):
    fills = frame(spark, [("r", "filled", 2.0, 25.0), ("r", "rejected", 9.0, 9.0)],
                  "run_id string, status string, qty double, price double")
    m = run_metrics(_curve(spark, [100.0, 110.0]), fills).first()
    assert (m["n_fills"], m["notional"], m["turnover"]) == (1, 50.0, 0.5)


def test_windows_and_spread(spark):
    w = rolling_windows(spark, "2008-01-01", "2025-12-31").orderBy("start").collect()
    assert len(w) == 13 and w[0]["label"] == "2008-01-01 -> 2013-01-01" and w[-1]["end"] == day("2025-01-01")
    assert rolling_windows(spark, "2020-01-01", "2021-01-01").count() == 0
    wide = frame(spark, [("s", day("2020-01-01"), day("2021-01-01"), 0.1, 1.0), ("s", day("2021-01-01"), day("2022-01-01"), None, 3.0)],
                 "strategy string, start date, end date, total_return double, beta double")
    got = {r["metric"]: r for r in metric_spread(wide, names=("total_return", "beta")).collect()}
    assert got["total_return"]["mean"] == pytest.approx(10.0) and got["total_return"]["std"] == 0.0
    assert got["beta"]["median"] == 2.0 and got["beta"]["n_windows"] == 2
    shown = [r["value"] for r in per_window(wide.withColumn("cagr", F.col("total_return")), "total_return").collect()]
    assert shown == ["0.1000", "n/a"]
    for bad in (dict(window_years=0), dict(step_months=0)):
        with pytest.raises(ValueError):
            rolling_windows(spark, "2020-01-01", "2021-01-01", **bad)


def test_rank_ic_and_spread(spark):
    rows = [("tie", "a", 1.0, 1.0), ("tie", "b", 1.0, 2.0), ("tie", "c", 2.0, 3.0), ("flat", "a", 1.0, 1.0),
            ("flat", "b", 1.0, 2.0), ("flat", "c", 1.0, 3.0), ("two", "a", 1.0, 1.0), ("two", "b", 2.0, 2.0)]
    df = frame(spark, rows, "date string, ticker string, score double, ret double")
    ic = {r["date"]: r["rank_ic"] for r in rank_ic(df).collect()}
    assert ic["tie"] == pytest.approx(math.sqrt(3) / 2) and ic["flat"] is None and ic["two"] is None
    twenty = frame(spark, [("d", f"N{i:02d}", float(i), i / 100) for i in range(20)], df.schema)
    assert decile_spread(twenty).first()["decile_spread"] == pytest.approx(0.18)
    assert decile_spread(twenty.limit(15)).first()["decile_spread"] is None


def test_signal_summary(spark):
    rows = [(d, f"N{i:02d}", float(i), s * i / 100) for d, s in (("2020-01-31", 1), ("2020-02-29", -1)) for i in range(40)]
    rows += [("2020-03-31", f"N{i}", float(i), float(i)) for i in range(5)]
    df = frame(spark, rows, "date string, ticker string, score double, ret double")
    months = signal_months(df)
    s = signal_summary(months).first()
    assert months.count() == 2 and s["mean_ic"] == pytest.approx(0.0) and s["hit_rate"] == 0.5 and s["n_undefined"] == 0


def _newey_west(x, lags):
    t, m = len(x), sum(x) / len(x)
    d = [v - m for v in x]
    lrv = sum(v * v for v in d) / t
    for k in range(1, min(lags, t - 1) + 1):
        lrv += 2 * (1 - k / (lags + 1)) * sum(a * b for a, b in zip(d[k:], d)) / t
    return m / math.sqrt(lrv / t)


def test_newey_west(spark):
    x = [0.1, -0.2, 0.3, 0.25, -0.05, 0.15, 0.02]
    df = frame(spark, [(day(f"2020-0{i + 1}-01"), v) for i, v in enumerate(x)], "date date, v double")
    assert newey_west(df, "v", lags=3).first()["nw_t"] == pytest.approx(_newey_west(x, 3))
    assert newey_west(df.limit(3), "v", lags=5).first()["n_months"] == 3
    assert newey_west(df.limit(1), "v").first()["nw_t"] is None
    assert newey_west(df.withColumn("v", F.lit(1.0)), "v").first()["nw_t"] is None


def test_rolling_and_growth(spark):
    rows = [(day(f"2020-0{i + 1}-01"), ic, sp) for i, (ic, sp) in enumerate([(0.1, 0.5), (0.2, None), (0.3, -1.5), (0.4, 0.2)])]
    months = frame(spark, rows, "date date, rank_ic double, decile_spread double")
    assert [round(r["rolling_ic"], 9) for r in rolling_mean_ic(months, 3).orderBy("date").collect()] == [0.2, 0.3]
    got = [r["growth"] for r in spread_growth(months).orderBy("date").collect()]
    assert got == [pytest.approx(1.5), pytest.approx(-0.75), pytest.approx(-0.9)]


def test_normal_and_sharpe_inference(spark):
    from statistics import NormalDist

    zs = [-9.0, -3.3, -0.7, 0.0, 0.99251, 2.5, 7.5]
    df = frame(spark, [(z,) for z in zs] + [(None,)], "z double")
    for r in df.select("z", normal_cdf("z").alias("c"), normal_ppf(normal_cdf("z")).alias("back")).collect():
        if r["z"] is None:
            assert r["c"] is None
            continue
        assert r["c"] == pytest.approx(NormalDist().cdf(r["z"]), abs=1e-14)
        if abs(r["z"]) < 5:
            assert r["back"] == pytest.approx(r["z"], abs=1e-8)
    for p in (1e-15, 1e-4, 0.3, 0.5, 0.77, 1 - 1e-9):
        got = frame(spark, [(p,)], "p double").select(normal_ppf("p").alias("q")).first()["q"]
        assert got == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12)
    one = spark.range(1).select(
        probabilistic_sharpe(F.lit(0.1), 0.0, F.lit(100)).alias("psr"),
        probabilistic_sharpe(F.lit(0.1), 0.0, F.lit(1)).alias("none"),
        expected_max_sharpe(F.lit(10), F.lit(0.04)).alias("best"), expected_max_sharpe(F.lit(1), F.lit(0.04)).alias("lone"),
        verdict(F.lit(0.96)).alias("a"), verdict(F.lit(0.4)).alias("b"), verdict(F.lit(0.7)).alias("c"),
    ).first()
    assert one["psr"] == pytest.approx(0.83952, abs=1e-5) and one["none"] is None and one["lone"] is None
    g, nd = 0.5772156649015329, NormalDist()
    assert one["best"] == pytest.approx(0.2 * ((1 - g) * nd.inv_cdf(0.9) + g * nd.inv_cdf(1 - 1 / (10 * math.e))))
    assert (one["a"], one["b"], one["c"]) == ("survives", "does NOT survive", "marginal under")


def test_deflation_by_window(spark):
    rows = []
    for run, step, end in (("a", 0.011, "2021-01-01"), ("b", 0.004, "2021-01-01"), ("c", 0.02, "2022-01-01")):
        drift = 0.002 if run == "b" else 0.0
        e = 100.0
        for i in range(30):
            rows.append((run, day("2020-01-01"), day(end), day(f"2020-01-{i + 1:02d}"), e))
            e *= 1 + drift + step * (1 + (i % 3)) * (-1 if i % 4 == 0 else 1)
    trials = trial_sharpes(frame(spark, rows, "run_id string, start date, end date, ts date, equity double"))
    out = {r["run_id"]: r for r in deflate(trials).collect()}
    assert out["a"]["n_trials"] == 2 and out["c"]["n_trials"] == 1
    assert 0 <= out["a"]["dsr"] < out["a"]["psr"] <= 1 and out["c"]["dsr"] is None
    assert check_family(trials, "a", ["b"]).count() == 2
    with pytest.raises(ValueError):
        check_family(trials, "a", ["c"])


def _idx(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"))


def test_combinations_by_number(spark):
    for n, k in ((6, 2), (5, 1), (7, 6), (20, 5)):
        want = list(itertools.combinations(range(n), k))
        got = spark.range(len(want)).select("id", combination(F.col("id"), n, k).alias("c")).collect()
        assert [tuple(r.c) for r in sorted(got)] == want


def test_cross_validation(spark):
    sizes = folds(_idx(spark, 11), 11, 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [4, 4, 3]
    split = purged_kfold(_idx(spark, 12), 12, n_splits=3, label_span=1, embargo=2).where("split_id = 1")
    by = {r["idx"]: r["role"] for r in split.collect()}
    assert {i for i, r in by.items() if r == "test"} == {4, 5, 6, 7}
    assert all(i not in by for i in (3, 8, 9, 10)) and by[11] == "train" and by[2] == "train"
    cp = combinatorial_purged(_idx(spark, 12), 12, label_span=1, embargo=1)
    assert cp.select("split_id").distinct().count() == 15
    counts = overlap(cp).collect()
    assert len(counts) == 15 and all(r["n_both"] == 0 and r["n_train"] > 0 and r["n_test"] > 0 for r in counts)
    both = overlap(frame(spark, [(0, 1, "train"), (0, 1, "test"), (0, 2, "test")], "split_id int, idx int, role string"))
    assert tuples(both) == [(0, 1, 2, 1)]
    tests = {}
    for r in cp.collect():
        tests.setdefault(r["split_id"], {"test": set(), "train": set()})[r["role"]].add(r["idx"])
    for s in tests.values():
        blocks, run = [], sorted(s["test"])
        for i in run:
            if blocks and i == blocks[-1][1] + 1:
                blocks[-1][1] = i
            else:
                blocks.append([i, i])
        want = {j for j in range(12) if j not in s["test"] and all(j + 1 < a or j > b + 2 for a, b in blocks)}
        assert s["train"] == want
    got = tuples(contiguous_blocks(frame(spark, [(0, i) for i in (1, 2, 3, 7, 8)], "split_id int, idx int")).select("first", "last"))
    assert got == [(1, 3), (7, 8)]
    for bad in (dict(n_splits=1), dict(label_span=-1), dict(embargo=-1)):
        with pytest.raises(ValueError):
            purged_kfold(_idx(spark, 12), 12, **bad)


def test_scalars(spark):
    r = spark.range(1).select(
        guarded_div(F.lit(1.0), F.lit(0.0)).alias("z"), guarded_div(F.lit(1.0), F.lit(-2.0)).alias("n"),
        guarded_div(F.lit(1.0), F.lit(4.0)).alias("q"), slipped(F.lit(100.0), F.lit("buy"), 5).alias("b"),
        slipped(F.lit(100.0), F.lit("sell"), 5).alias("s"), mid_price(F.lit(-1.0), F.lit(1.0)).alias("m"),
        round_half_up(F.lit(1e18), 6).alias("big"), round_half_up(F.lit(-1.25), 1).alias("half"),
    ).first()
    assert (r["z"], r["n"], r["q"], r["m"]) == (None, None, 0.25, None)
    assert (r["b"], r["s"]) == (100.05, 99.95) and r["big"] == 1e18 and r["half"] == -1.2
