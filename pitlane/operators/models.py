"""Valuation models fitted each month on all earlier months."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.functions.scalar import round_half_up
from pitlane.operators.boosting import Bins, binned, grow, learn_bins, predict
from pitlane.operators.panel import (
    DEFLATOR, FEATURES, TARGETS, demean, rank_normalise, rank_vectors, scale_by_assets,
)
from pitlane.operators.ranks import ordinal_rank
from pitlane.session import cut

#: Blocks of products that a task holds before it hands them on.
KEPT = 64


def _checked(target: str, burn_in: int) -> None:
    if target not in TARGETS or burn_in < 1:
        raise ValueError(f"a fit needs a target of {TARGETS} and one month of history at least: {target!r}, {burn_in}")


def score_partition(
    model: str, target: str, *, industry: bool = False, scaled: bool = False, placebo: bool = False
) -> dict[str, str]:
    """Partition values of the score table that a fit is written to."""
    flags = {"industry": industry, "scaled": scaled, "placebo": placebo}
    return {"model": model, "target": target, **{k: str(v).lower() for k, v in flags.items()}}


def labelled(panel: DataFrame) -> DataFrame:
    """Rows that can train: their label is known."""
    return panel.where(F.col("target").isNotNull())


def section_index(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each date's position, from 0, in each group. One row per calendar date."""
    days = panel.select(*by, "date").distinct()
    along = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("date")
    return days.select(*by, "date", (F.row_number().over(along) - 1).alias("section"))


def placebo_labels(panel: DataFrame, seed: int = 0) -> DataFrame:
    """Known labels permuted inside each date, the same way for the same seed.

    Rows ranked by a seeded hash take the labels ranked by ticker; the pairing is an equi-join on (date, rank).
    """
    known = labelled(panel)
    givers = ordinal_rank(known.select("date", "ticker", "target"), ["date"], [F.col("ticker")], total=None)
    takers = ordinal_rank(
        known.select("date", "ticker"), ["date"],
        [F.xxhash64(F.lit(seed), F.col("date"), F.col("ticker")), F.col("ticker")], total=None,
    )
    drawn = takers.join(givers.select("date", "rn", "target"), ["date", "rn"]).select("date", "ticker", "target")
    return panel.drop("target").join(drawn, ["date", "ticker"], "left")


def _gram_blocks(vectors: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """Sums of products of (1, x, y) per group and date, summed inside each task before any shuffle."""
    d = p + 2
    upper = np.triu_indices(d)
    keys = [*by, "date"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False):
                x = np.array(rows["x"].tolist(), dtype=np.float64)
                y = rows["target"].to_numpy(dtype=np.float64, na_value=np.nan)
                keep = ~np.isnan(y)
                z = np.column_stack([np.ones(keep.sum()), x[keep], y[keep]])
                sums[key] = sums.get(key, 0.0) + (z.T @ z)[upper]
            if len(sums) > KEPT:
                yield pd.DataFrame([(*key, g) for key, g in sums.items()], columns=[*keys, "g"])
                sums = {}
        if sums:
            yield pd.DataFrame([(*key, g) for key, g in sums.items()], columns=[*keys, "g"])

    head = "".join(f"{c} string, " for c in by)
    parts = vectors.select(*keys, "x", "target").mapInPandas(blocks, f"{head}date date, g array<double>")
    return parts.select(*keys, F.posexplode("g").alias("cell_no", "v")).groupBy(*keys, "cell_no").agg(F.sum("v").alias("v"))


def ridge_coefficients(
    vectors: DataFrame, p: int, *, burn_in: int = 96, alpha: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Per test date: intercept and coefficients fitted on all earlier dates. ``vectors`` is (by, date, ticker, x, target).

    Sums over a date do not depend on later dates, so each date's block is
    computed once and the fits use running sums of blocks: one pass over the
    rows for all months of all groups, and a ``p x p`` system per month.
    """
    d = p + 2
    keys = [*by, "date"]
    order = section_index(vectors, by)
    cells = _gram_blocks(vectors, p, by)
    before = Window.partitionBy(*by, "cell_no").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    history = cells.withColumn("v", F.sum("v").over(before)).join(order, keys).where(F.col("section") >= burn_in)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((d, d))
        upper = np.triu_indices(d)
        full[upper] = pdf.sort_values("cell_no")["v"].to_numpy()
        full = full + np.triu(full, 1).T
        n = full[0, 0]
        if n < 1:
            return pd.DataFrame({c: [] for c in (*keys, "intercept", "beta")})
        mean = full[0, 1:] / n
        centred = full[1:, 1:] - n * np.outer(mean, mean)
        beta = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p])
        return pd.DataFrame(
            {**{c: [pdf[c].iloc[0]] for c in keys}, "intercept": [mean[p] - mean[:p] @ beta], "beta": [beta]}
        )

    head = "".join(f"{c} string, " for c in by)
    return history.groupBy(*keys).applyInPandas(solve, f"{head}date date, intercept double, beta array<double>")


def ridge_predictions(vectors: DataFrame, coefficients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return vectors.join(F.broadcast(coefficients), [*by, "date"]).select(
        *by, "date", "ticker", "target", (F.col("intercept") + dot).alias("predicted")
    )


def emit_scores(predictions: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Predictions to scores: for returns the demeaned prediction, else the demeaned prediction error."""
    raw = F.col("predicted") if target == "ret" else F.col("predicted") - F.col("target")
    centred = demean(predictions.withColumn("score", raw), "score", by=[*by, "date"])
    return centred.select(*by, "date", "ticker", round_half_up("score", 6).alias("score"))


def design_vectors(panel: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, ticker, x, target) with rank-normalised features; a row without any known feature is all 0."""
    keys = [*by, "date"]
    vectors = rank_vectors(panel, features, by=keys)
    zero = F.array_repeat(F.lit(0.0), len(features))
    return panel.select(*keys, "ticker", "target").join(vectors, [*keys, "ticker"], "left").withColumn(
        "x", F.coalesce("x", zero)
    )


def expanding_ridge(
    panel: DataFrame, features: Sequence[str] = FEATURES, *, target: str = "cap", burn_in: int = 96, alpha: float = 1.0,
    placebo_seed: int | None = None,
) -> DataFrame:
    """Ridge scores for every date from the burn-in on. Fewer dates than that give no rows.

    With ``placebo_seed`` the fit learns from permuted labels; its errors are against the real ones.

    The feature vectors are stored once: the sums, the section order and the predictions read them.
    """
    _checked(target, burn_in)
    train = panel if placebo_seed is None else placebo_labels(panel, placebo_seed)
    vectors = cut(design_vectors(train, features))
    coefficients = ridge_coefficients(vectors, len(features), burn_in=burn_in, alpha=alpha)
    scored = ridge_predictions(vectors, coefficients)
    if placebo_seed is not None:
        scored = scored.drop("target").join(panel.select("date", "ticker", "target"), ["date", "ticker"])
    return emit_scores(scored, target)


def tree_inputs(
    panel: DataFrame, features: Sequence[str] = FEATURES, *, scaled: bool = False, industry: bool = False
) -> tuple[DataFrame, list[str]]:
    """Features for trees, null where missing: levels or asset-scaled levels, and the sector code if asked."""
    rows = scale_by_assets(panel) if scaled else panel
    names = [*features, *(["industry"] if industry else [])]
    return rows.select("date", "ticker", "target", *[F.col(f).cast("double").alias(f) for f in names]), names


def boosted_scores(
    cells: Mapping[str, DataFrame], features: Sequence[str], nominal: Sequence[str] = (), *, burn_in: int = 96,
    refit_every: int = 1, n_trees: int = 10, depth: int = 3, rate: float = 0.3, least: int = 20, bins: int = 64,
) -> DataFrame:
    """(cell, date, ticker, target, predicted) of boosted trees for several tables (date, ticker, target, features) at
    once: each cell has a model for every month from the burn-in on, or for every ``refit_every``-th, and all of them
    grow together (see :mod:`pitlane.operators.boosting`).

    Bin edges come from a cell's burn-in months alone, so no later row has a part in them. A missing value goes to the
    side that fits better; nominal features are split by the order of their codes' means.
    """
    names = [*features, *nominal]
    dated = [(c, df.join(section_index(df), "date").withColumn("grp", F.lit(g)))
             for g, (c, df) in enumerate(cells.items())]
    learnt = [learn_bins(df.where((F.col("section") < burn_in) & F.col("target").isNotNull()), features, nominal, bins)
              for _, df in dated]
    width = max(b.width for b in learnt)
    learnt = [Bins(b.edges, width) for b in learnt]
    rows = cut(reduce(DataFrame.unionByName, [binned(df, b, names) for (_, df), b in zip(dated, learnt, strict=True)]))
    last = {r.grp: r.last for r in rows.groupBy("grp").agg(F.max("section").alias("last")).collect()}
    models = [(g, first) for g in sorted(last) for first in range(burn_in, last[g] + 1, refit_every)]
    forest = grow(rows, models, learnt[0], n_trees=n_trees if models else 0, depth=depth, rate=rate, least=least)
    names_of = F.create_map(*[F.lit(v) for g, (c, _) in enumerate(dated) for v in (g, c)])
    return predict(rows, forest).select(names_of[F.col("grp")].alias("cell"), "date", "ticker", "target", "predicted")


def expanding_trees(
    panel: DataFrame, features: Sequence[str] = FEATURES, *, target: str = "cap", burn_in: int = 96,
    scaled: bool | None = None, industry: bool = False, placebo_seed: int | None = None, refit_every: int = 1,
    n_trees: int = 10, depth: int = 3, rate: float = 0.3, least: int = 20,
) -> DataFrame:
    """Gradient-boosted tree scores; refitted at every month, or every ``refit_every``, on all earlier ones.

    ``scaled`` features are divided by assets; by default where the target is deflated too. The sector code is a
    nominal feature, whatever the number of sectors.
    """
    _checked(target, burn_in)
    base = panel if placebo_seed is None else placebo_labels(panel, placebo_seed)
    rows, _ = tree_inputs(base, features, scaled=target in DEFLATOR if scaled is None else scaled, industry=industry)
    scored = boosted_scores(
        {"all": rows}, features, ["industry"] if industry else [], burn_in=burn_in, refit_every=refit_every,
        n_trees=n_trees, depth=depth, rate=rate, least=least).drop("cell")
    if placebo_seed is not None:
        scored = scored.drop("target").join(panel.select("date", "ticker", "target"), ["date", "ticker"])
    return emit_scores(scored, target)


def one_feature_ridge(panel: DataFrame, feature: str, *, burn_in: int, alpha: float = 1.0) -> DataFrame:
    """Predictions of a ridge on a single ranked feature, from running sums alone (no Python)."""
    z = rank_normalise(panel, [feature]).select("date", "ticker", F.col("z").alias("x"))
    rows = panel.select("date", "ticker", "target").join(z, ["date", "ticker"], "left").withColumn(
        "x", F.coalesce("x", F.lit(0.0))
    )
    sums = labelled(rows).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("target").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("target")).alias("sxy"),
    )
    order = section_index(rows).join(sums, "date", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    cum = order.select("date", "section", *[F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    beta = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (
        F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n") + alpha
    )
    fits = cum.where((F.col("section") >= burn_in) & (F.col("n") > 0)).select(
        "date", beta.alias("beta"), (F.col("sy") / F.col("n") - beta * F.col("sx") / F.col("n")).alias("intercept")
    )
    return rows.join(fits, "date").select(
        "date", "ticker", "target", (F.col("intercept") + F.col("beta") * F.col("x")).alias("predicted")
    )


def scaling_cells(panels: Mapping[str, DataFrame], features: Sequence[str] = FEATURES) -> dict[str, DataFrame]:
    """The tables of an ablation, by name: each target's panel with its features as they are and over assets."""
    return {f"{target}+{name}": tree_inputs(panel, features, scaled=scaled)[0]
            for target, panel in panels.items() for name, scaled in (("raw", False), ("scaled", True))}


def ablated_scores(
    panels: Mapping[str, DataFrame], features: Sequence[str] = FEATURES, *, model: str = "gbt", burn_in: int = 96,
    alpha: float = 1.0, **trees: float,
) -> DataFrame:
    """(cell, date, ticker, score) of every target with raw and with asset-scaled features, all cells fitted together.

    The panels are price-level targets, by name. Ridges share one table of vectors and one pass of sums of products,
    trees one pass per level.
    """
    if model not in ("gbt", "ridge"):
        raise ValueError(f"model must be gbt or ridge, got {model!r}")
    for target in panels:
        _checked(target, burn_in)
        if target == "ret":
            raise ValueError("an ablation compares valuation errors; returns have none")
    cells = scaling_cells(panels, features)
    if model == "gbt":
        return emit_scores(boosted_scores(cells, features, burn_in=burn_in, **trees), "cap", by=["cell"])
    stacked = reduce(DataFrame.unionByName, [df.withColumn("cell", F.lit(c)) for c, df in cells.items()])
    vectors = cut(design_vectors(stacked, features, by=["cell"]))
    fitted = ridge_coefficients(vectors, len(features), burn_in=burn_in, alpha=alpha, by=["cell"])
    return emit_scores(ridge_predictions(vectors, fitted, by=["cell"]), "cap", by=["cell"])
