import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane.operators import boosting
from pitlane.operators.boosting import best_split, descend
from pitlane.operators.models import (
    ablated_scores, boosted_scores, design_vectors, emit_scores, expanding_ridge, expanding_trees, one_feature_ridge, placebo_labels,
    ridge_coefficients, ridge_predictions, score_partition, tree_inputs,
)
from pitlane.operators.panel import FEATURES, scale_by_assets
from tests.helpers import day, frame

NAMES = [f"S{i}" for i in range(8)]


def _planted(spark, months=7, cheap="S3", missing=False):
    """Labels follow x1; in the last month one name sits one below its line."""
    rng = random.Random(4)
    rows = []
    for m in range(months):
        xs = rng.sample(range(100), len(NAMES))
        order = sorted(xs)
        for t, x in zip(NAMES, xs):
            y = order.index(x) / (len(xs) - 1) * 2 - 1
            if m == months - 1 and t == cheap:
                y -= 1.0
            label = None if missing and t == "S0" else y
            rows.append((day(f"2020-{m + 1:02d}-28"), t, float(x), float(rng.random()), label))
    return frame(spark, rows, "date date, ticker string, x1 double, x2 double, target double")


def test_ridge_finds_the_planted_name(spark):
    panel = _planted(spark)
    out = expanding_ridge(panel, ["x1", "x2"], burn_in=5)
    last = out.where(F.col("date") == "2020-07-28").orderBy(F.col("score").desc()).collect()
    assert last[0]["ticker"] == "S3" and last[0]["score"] > 0.5
    assert abs(sum(r["score"] for r in last)) < 1e-5
    assert out.select("date").distinct().count() == 2


def test_ridge_equals_refit(spark):
    panel = _planted(spark, missing=True)
    vectors = design_vectors(panel, ["x1", "x2"])
    got = {r["date"]: (r["intercept"], r["beta"]) for r in ridge_coefficients(vectors, 2, burn_in=3, alpha=1.5).collect()}
    rows = vectors.collect()
    assert len(got) == 4
    for d, (intercept, beta) in got.items():
        past = [r for r in rows if r["date"] < d and r["target"] is not None]
        x, y = np.array([r["x"] for r in past]), np.array([r["target"] for r in past])
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + 1.5 * np.eye(2), xc.T @ yc)
        assert np.allclose(beta, want, atol=1e-10) and intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-10)


def test_scores_do_not_see_the_future(spark):
    panel = _planted(spark)
    bent = panel.withColumn("target", F.when(F.col("date") == "2020-07-28", F.col("target") * 9).otherwise(F.col("target")))
    keep = F.col("date") == "2020-06-28"
    a = {r["ticker"]: r["score"] for r in expanding_ridge(panel, ["x1"], burn_in=5).where(keep).collect()}
    b = {r["ticker"]: r["score"] for r in expanding_ridge(bent, ["x1"], burn_in=5).where(keep).collect()}
    assert a == b and len(a) == 8


def test_one_feature_path_agrees(spark):
    panel = _planted(spark, missing=True)
    a = {(r["date"], r["ticker"]): r["predicted"] for r in one_feature_ridge(panel, "x1", burn_in=4).collect()}
    vectors = design_vectors(panel, ["x1"])
    b = {(r["date"], r["ticker"]): r["predicted"] for r in
         ridge_predictions(vectors, ridge_coefficients(vectors, 1, burn_in=4)).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-10) for k in a)


def test_return_scores_are_demeaned_predictions(spark):
    rows = [(day("2020-01-31"), "A", 0.9, 0.2), (day("2020-01-31"), "B", None, 0.4)]
    df = frame(spark, rows, "date date, ticker string, target double, predicted double")
    assert {r["ticker"]: r["score"] for r in emit_scores(df, "ret").collect()} == {"A": -0.1, "B": 0.1}


def test_placebo_permutes_inside_dates(spark):
    panel = _planted(spark, missing=True)
    a, b, c = (placebo_labels(panel, s).orderBy("date", "ticker").collect() for s in (1, 1, 2))
    real = panel.orderBy("date", "ticker").collect()
    assert [r["target"] for r in a] == [r["target"] for r in b] != [r["target"] for r in c]
    assert [r["target"] for r in a] != [r["target"] for r in real]
    for d in {r["date"] for r in real}:
        assert sorted((r["target"] for r in a if r["date"] == d), key=str) == sorted(
            (r["target"] for r in real if r["date"] == d), key=str)
    assert all(r["target"] is None for r in a if r["ticker"] == "S0")


def test_few_sections_and_bad_config(spark):
    panel = _planted(spark, months=3)
    assert expanding_ridge(panel, ["x1"], burn_in=3).count() == 0
    assert expanding_trees(panel, ["x1"], burn_in=3).count() == 0
    for bad in (dict(burn_in=0), dict(target="x")):
        for fit in (expanding_ridge, expanding_trees):
            with pytest.raises(ValueError):
                fit(panel, ["x1"], **bad)
    assert score_partition("ridge", "cap", placebo=True)["placebo"] == "true"


def test_trees_score_later_months_only(spark):
    panel = _planted(spark).withColumn("industry", F.when(F.col("ticker") < "S4", 0).otherwise(1))
    out = expanding_trees(panel, ["x1", "x2"], burn_in=5, industry=True, refit_every=2, n_trees=30, depth=3, least=1)
    last = out.where(F.col("date") == "2020-07-28").orderBy(F.col("score").desc()).collect()
    assert out.count() == 16 and "S3" in [r["ticker"] for r in last[:2]] and max(r["score"] for r in last if r["ticker"] == "S3") > 0.3


def test_tree_inputs_keep_missing(spark):
    cols = ", ".join(f"{c} double" for c in FEATURES)
    values = {"revenue": 50.0, "assets": 200.0}
    df = frame(spark, [(day("2020-01-31"), "A", 0.1, *[values.get(c) for c in FEATURES])],
               f"date date, ticker string, target double, {cols}")
    rows, names = tree_inputs(df, scaled=True)
    r = rows.first()
    assert r["revenue"] == 0.25 and r["gp"] is None and names == list(FEATURES)


def plain_boosting(train, test, edges, n_trees, depth, rate, least):
    """Trees by trying every split on every row, features in order, missing left last; numeric but for the last one."""
    d = len(train[0][0])

    def code(v, f):
        return 0 if v is None else (int(v) + 1 if f == d - 1 else 1 + sum(e < v for e in edges[f]))

    rows = [([code(v, f) for f, v in enumerate(x)], y) for x, y in train]
    told = [[code(v, f) for f, v in enumerate(x)] for x in test]
    base = sum(y for _, y in rows) / len(rows)
    fit, out = [base] * len(rows), [base] * len(told)

    def split(own, rest):
        whole, best = sum(rest[i] for i in own), (1e-12, None)
        for f in range(d):
            codes = sorted({rows[i][0][f] for i in own} - {0})
            mean = {c: np.mean([rest[i] for i in own if rows[i][0][f] == c]) for c in codes}
            if f == d - 1:
                codes.sort(key=lambda c: (mean[c], c))
            for missing in (False, True):
                for k in range(1, len(codes) + 1):
                    goes = set(codes[:k]) | ({0} if missing else set())
                    left = [i for i in own if rows[i][0][f] in goes]
                    n, m = len(left), len(own) - len(left)
                    if n < least or m < least:
                        continue
                    part = sum(rest[i] for i in left)
                    gain = part ** 2 / n + (whole - part) ** 2 / m - whole ** 2 / len(own)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, codes[k - 1], goes, codes))
        return best[1]

    def grow(own, there, level, rest):
        if level == depth:
            value = rate * (sum(rest[i] for i in own) / len(own) if own else 0.0)
            for i in own:
                fit[i] += value
            for i in there:
                out[i] += value
            return
        found = split(own, rest) if own else None
        if found is None:
            grow(own, there, level + 1, rest)
            return
        f, edge, goes, codes = found

        def lower(c):
            # A numeric code that no row here has lies below the edge or above it; an unseen nominal one goes right.
            return c in goes if c == 0 or f == d - 1 else c <= edge

        grow([i for i in own if lower(rows[i][0][f])], [i for i in there if lower(told[i][f])], level + 1, rest)
        grow([i for i in own if not lower(rows[i][0][f])], [i for i in there if not lower(told[i][f])], level + 1, rest)

    for _ in range(n_trees):
        rest = [y - g for (_, y), g in zip(rows, fit, strict=True)]
        grow(list(range(len(rows))), list(range(len(told))), 0, rest)
    return out


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_rows_go_down_a_tree_by_columns(kind):
    """First bins left, with the missing on either side, any set of bins of a nominal feature, and no split at all."""
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 9, (4, 500)).astype(kind)
    feature = rng.integers(0, 4, 7)
    left = np.array([np.arange(9) <= 4, np.arange(9) < 3, rng.random(9) < 0.5, np.ones(9, bool),
                     (np.arange(9) > 0) & (np.arange(9) < 6), rng.random(9) < 0.5, np.arange(9) == 0])
    for levels in range(4):
        want = []
        for r in range(500):
            at = 0
            for level in range(levels):
                inner = at + (1 << level) - 1
                at = 2 * at + (not left[inner, bins[feature[inner], r]])
            want.append(at)
        assert descend(bins, feature, left, levels).tolist() == want


def test_trees_of_all_months_against_plain_boosting(spark):
    rng = random.Random(4)
    rows = []
    for m in range(9):
        for i in range(25):
            a = rng.choice([None, *range(9)])
            b, sector = rng.choice([rng.random(), None]), rng.choice([None, 0, 1, 2, 3])
            y = (a or 4) * 0.3 + (sector or 0) % 2 * 2.0 + (b or 0.7) + rng.gauss(0, 0.3)
            rows.append((day(f"2020-{m + 1:02d}-28"), f"S{i:02d}", None if rng.random() < 0.05 else y,
                         None if a is None else float(a), b, None if sector is None else float(sector)))
    panel = frame(spark, rows, "date date, ticker string, target double, a double, b double, s double").repartition(5)
    got = boosted_scores({"one": panel, "two": panel.where("date < '2020-08-01'")}, ["a", "b"], ["s"], burn_in=4,
                         n_trees=4, depth=2, rate=0.5, least=3, bins=6)
    found = {(r.cell, r.date, r.ticker): r.predicted for r in got.collect()}
    dates = sorted({r[0] for r in rows})
    early = [r for r in rows if r[0] in dates[:4] and r[2] is not None]
    edges = []
    for f in (3, 4):
        known = sorted(r[f] for r in early if r[f] is not None)
        edges.append(sorted({known[max(0, math.ceil(len(known) * k / 5) - 1)] for k in range(1, 5)}))
    assert len(found) == 25 * (5 + 3)
    for at in range(4, 9):
        train = [(r[3:], r[2]) for r in rows if r[0] < dates[at] and r[2] is not None]
        test = [r for r in rows if r[0] == dates[at]]
        want = plain_boosting(train, [r[3:] for r in test], edges, 4, 2, 0.5, 3)
        for r, w in zip(test, want, strict=True):
            for cell in ("one", "two") if at < 7 else ("one",):
                assert found[cell, r[0], r[1]] == pytest.approx(w, rel=1e-9, abs=1e-9)


def test_splits_put_missing_and_nominal_bins_where_they_fit():
    total, count = np.array([[9.0, 0, 0, 9]]), np.array([[3.0, 3, 3, 3]])
    feature, goes, low, high = best_split(total, count, [False], 1)
    assert (feature, goes.tolist(), low, high) == (0, [False, True, True, False], 0.0, 3.0)
    total = np.array([[0.0, 9, 0, 9]])
    assert best_split(total, count, [True], 1)[1].tolist() in ([True, False, True, False], [False, False, True, False])
    assert best_split(total, count, [True], 7)[1].tolist() == [True] * 4


def test_ablation_cells_are_the_single_fits(spark):
    rng = random.Random(8)
    rows = [(day(f"2020-{m + 1:02d}-28"), f"S{i}", rng.random(), float(rng.randint(1, 50)), float(rng.randint(1, 9)), rng.random())
            for m in range(8) for i in range(12)]
    names = [f for f in FEATURES if f not in ("revenue", "assets", "roe")]
    blank = [f"CAST(NULL AS DOUBLE) AS {f}" for f in names]
    panel = frame(spark, rows, "date date, ticker string, target double, revenue double, assets double, roe double").selectExpr("*", *blank)
    other = panel.withColumn("target", F.col("target") * F.col("roe")).where("ticker <> 'S3'")
    used = ["revenue", "assets", "roe"]
    got = {}
    for r in ablated_scores({"cap": panel, "mb": other}, used, model="ridge", burn_in=4).collect():
        got.setdefault(r.cell, {})[r.date, r.ticker] = r.score
    assert set(got) == {"cap+raw", "cap+scaled", "mb+raw", "mb+scaled"} and got["cap+raw"] != got["cap+scaled"]
    for cell, table, target in (("cap+raw", panel, "cap"), ("mb+scaled", scale_by_assets(other), "mb")):
        want = {(r.date, r.ticker): r.score for r in expanding_ridge(table, used, target=target, burn_in=4).collect()}
        assert got[cell] == want
    trees = ablated_scores({"cap": panel}, used, burn_in=4, n_trees=2, depth=2, least=2)
    raw = {(r.date, r.ticker): r.score for r in trees.where("cell = 'cap+raw'").collect()}
    assert raw == {(r.date, r.ticker): r.score for r in
                   expanding_trees(panel, used, burn_in=4, n_trees=2, depth=2, least=2).collect()}
    for bad in (dict(model="x"), dict(burn_in=0)):
        with pytest.raises(ValueError):
            ablated_scores({"cap": panel}, used, **bad)
    with pytest.raises(ValueError):
        ablated_scores({"ret": panel}, used)


def test_two_features_share_a_pass():
    x = np.random.default_rng(5).integers(0, 8, (5, 40)).astype(np.uint8)
    place, shared = boosting._places(x, 4, 8)
    assert shared == 4 and len(place) == 3
    assert (place[0] == x[0] * 8 + x[1]).all() and (place[1] == x[2] * 8 + x[3]).all() and (place[2] == x[4]).all()
    place, shared = boosting._places(x, 4, 200)
    assert shared == 0 and (place == x).all()


def test_rows_of_all_batches_are_added_up_together():
    x = np.arange(12, dtype=np.uint8).reshape(2, 6)
    parts = [(1, np.array([0, 3]), np.array([1.0, 2.0]), x[:, :2]), (0, np.array([5]), np.array([3.0]), x[:, 2:3]),
             (1, np.array([0, 2, 4]), np.array([4.0, 5.0, 6.0]), x[:, 3:])]
    (g, s, y, b), (h, t, z, c) = boosting._merged(parts)
    assert (g, s.tolist(), y.tolist(), b.tolist()) == (0, [5], [3.0], [[2], [8]])
    assert (h, t.tolist(), z.tolist(), c.tolist()) == (1, [0, 0, 2, 3, 4], [1.0, 4.0, 5.0, 2.0, 6.0], [[0, 3, 4, 1, 5], [6, 9, 10, 7, 11]])
