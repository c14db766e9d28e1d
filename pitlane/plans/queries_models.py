"""Expanding-window valuation models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.operators.models import (
    emit_scores, expanding_ridge, expanding_trees, labelled, one_feature_ridge, placebo_labels,
    section_index,
)
from pitlane.operators.signals import prediction_size, valuation_error
from pitlane.operators.universe import sector_codes
from pitlane.plans.fixtures import Tables, with_ctes
from pitlane.plans.queries_panel import MIN_NAMES, panel
from pitlane.plans.queries_sources import r6, rounded
from pitlane.plans.registry import query
from pitlane.session import cut

BURN_IN = 24

_PANEL = f"""p AS (SELECT ticker, date, roe, LN(marketcap) - AVG(LN(marketcap)) OVER (PARTITION BY date) AS y FROM (
 SELECT e.*, COUNT(*) OVER (PARTITION BY date) AS n FROM enough e) c WHERE n >= {MIN_NAMES})"""
_RIDGE = f"""{_PANEL},
 z AS (SELECT p.ticker, p.date, p.y, COALESCE(k.z, 0.0::DOUBLE) AS x FROM p LEFT JOIN (SELECT ticker, date, CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE CAST(rn - 1 AS DOUBLE) / (n - 1) * 2 - 1 END AS z FROM (
 SELECT ticker, date, ROW_NUMBER() OVER (PARTITION BY date ORDER BY roe, ticker) AS rn, COUNT(*) OVER (PARTITION BY date) AS n FROM p WHERE roe IS NOT NULL) r) k
 ON p.ticker = k.ticker AND p.date = k.date),
 s AS (SELECT date, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i FROM z GROUP BY date),
 c AS (SELECT date, i, SUM(n) OVER w AS n, SUM(sx) OVER w AS sx, SUM(sy) OVER w AS sy, SUM(sxx) OVER w AS sxx, SUM(sxy) OVER w AS sxy FROM s
 WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT date, sy / n AS my, sx / n AS mx, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0::DOUBLE) AS b FROM c WHERE i >= {BURN_IN}),
 o AS (SELECT z.date, z.ticker, z.y, f.my + f.b * (z.x - f.mx) AS predicted FROM z JOIN f ON z.date = f.date)"""


@query("training_rows", "B11 I6", with_ctes("enough", body=f"WITH {_PANEL} SELECT ticker, date, {r6('y')} AS target FROM p WHERE y IS NOT NULL"))
def training_rows(t: Tables) -> DataFrame:
    return rounded(labelled(panel(t)).select("ticker", "date", "target"), "target")


@query(
    "training_windows", "E13",
    with_ctes(
        "enough",
        body=f"""WITH {_PANEL} SELECT date, CAST(ROW_NUMBER() OVER (ORDER BY date) - 1 AS INTEGER) AS section FROM (SELECT DISTINCT date FROM p) d""",
    ),
)
def training_windows(t: Tables) -> DataFrame:
    return section_index(panel(t))


@query(
    "ridge_one_feature", "I1 E13 I4",
    with_ctes("enough", body=f"WITH {_RIDGE} SELECT ticker, date, {r6('y')} AS target, {r6('predicted')} AS predicted FROM o"),
)
def ridge_one_feature(t: Tables) -> DataFrame:
    return rounded(one_feature_ridge(cut(panel(t)), "roe", burn_in=BURN_IN), "target", "predicted")


@query(
    "ridge_one_feature_scores", "I1 I4 H8",
    with_ctes(
        "enough",
        body=f"WITH {_RIDGE} SELECT date, ticker, {r6('s - AVG(s) OVER (PARTITION BY date)')} AS score FROM (SELECT o.*, predicted - y AS s FROM o) q",
    ),
)
def ridge_one_feature_scores(t: Tables) -> DataFrame:
    scored = one_feature_ridge(cut(panel(t)), "roe", burn_in=BURN_IN)
    return emit_scores(scored, "cap")


# The general path, through sums of products per month, on one feature: the same twin holds.
@query(
    "ridge_gram_scores", "I1 I6",
    with_ctes(
        "enough",
        body=f"WITH {_RIDGE} SELECT date, ticker, {r6('s - AVG(s) OVER (PARTITION BY date)')} AS score FROM (SELECT o.*, predicted - y AS s FROM o) q",
    ),
)
def ridge_gram_scores(t: Tables) -> DataFrame:
    return expanding_ridge(panel(t), ["roe"], burn_in=BURN_IN)


@query("ridge_scores", "I1 I4 I6 E6")
def ridge_scores(t: Tables) -> DataFrame:
    return expanding_ridge(panel(t), burn_in=BURN_IN)


@query("ridge_return_scores", "I1 I4 H4")
def ridge_return_scores(t: Tables) -> DataFrame:
    return expanding_ridge(panel(t, "ret"), burn_in=BURN_IN, target="ret")


@query(
    "placebo_label_sums", "I5",
    with_ctes(
        "enough",
        body=f"WITH {_PANEL} SELECT date, COUNT(y) AS n, {r6('MIN(y)')} AS low, {r6('MAX(y)')} AS high, {r6('SUM(y * y)')} AS squares FROM p GROUP BY date",
    ),
)
def placebo_label_sums(t: Tables) -> DataFrame:
    drawn = placebo_labels(cut(panel(t).select("date", "ticker", "target")), seed=7)
    out = drawn.groupBy("date").agg(
        F.count("target").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"),
        F.sum(F.col("target") * F.col("target")).alias("squares"),
    )
    return rounded(out, "low", "high", "squares")


@query("ridge_placebo_error", "I5 D36")
def ridge_placebo_error(t: Tables) -> DataFrame:
    scores = expanding_ridge(panel(t), burn_in=BURN_IN, placebo_seed=7)
    return valuation_error(cut(scores))


def tree_panel(t: Tables) -> DataFrame:
    return cut(panel(t, "mb", sectors=sector_codes(t.tickers)))


@query("tree_scores", "I2 I3 I6")
def tree_scores(t: Tables) -> DataFrame:
    return expanding_trees(tree_panel(t), target="mb", burn_in=BURN_IN, industry=True)


@query(
    "tree_score_dates", "I2 I6",
    with_ctes(
        "enough",
        body=f"""SELECT date, COUNT(*) AS n_scores, TRUE AS zero_mean FROM (
 SELECT date, n, DENSE_RANK() OVER (ORDER BY date) - 1 AS section FROM (
 SELECT e.*, COUNT(*) OVER (PARTITION BY date) AS n FROM enough e WHERE equity > 0) c WHERE n >= {MIN_NAMES}) d
 WHERE section >= {BURN_IN} GROUP BY date""",
    ),
)
def tree_score_dates(t: Tables) -> DataFrame:
    """Scores per date: every name of a scored month has one, their mean is zero, and the burn-in has none."""
    scores = tree_scores(t)
    return scores.groupBy("date").agg(
        F.count("score").alias("n_scores"), (F.abs(F.avg("score")) < 1e-6).alias("zero_mean"))


@query("return_prediction_size", "D37 I4")
def return_prediction_size(t: Tables) -> DataFrame:
    return prediction_size(cut(expanding_ridge(panel(t, "ret"), burn_in=BURN_IN, target="ret")))
