"""Return windows, and the matrices and weights of the cost-aware book.

A matrix belongs to one rebalance of one book. Its task sees one row per
selected name, each with an array of ``lookback`` returns: a size set by the
parameters, not by the data. Baskets of any size are in :mod:`pitlane.operators.frontier`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.operators.asof import asof_join
from pitlane.operators.ordered import row_index

MAX_ITERATIONS = 5_000
SOLVER_TOLERANCE = 1e-10
TRADING_DAYS = 252.0
SCORE_RETURN_SCALE = 0.05


def return_windows(keys: DataFrame, bars: DataFrame, *, lookback: int) -> DataFrame:
    """The last ``lookback`` returns of each key's symbol as of the key's date, oldest first.

    Symbols with a shorter history (inside the run, if ``keys`` has ``start``),
    or with any close but the last at or below zero, drop out.
    """
    if lookback < 2:
        raise ValueError(f"lookback must be >= 2, got {lookback}")
    rows = bars.select("ticker", F.col("date").alias("_bd"), "close")
    numbered = row_index(rows, ["ticker"], "_bd")
    latest = asof_join(keys, numbered, ["ticker"], "date", "_bd", ["idx"]).where(F.col("idx") >= lookback)
    # A symbol's closes, bounded by the calendar, meet its keys as one row; each key takes its own stretch of them.
    tapes = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("_bd", "close"))).alias("_t"))
    stretch = F.slice("_t", (F.col("idx") - lookback + 1).cast("int"), lookback + 1)
    read = latest.join(tapes, "ticker").select(*keys.columns, stretch.alias("_c"))
    if "start" in keys.columns:
        read = read.where(F.col("_c")[0]["_bd"] >= F.col("start"))
    closes = read.select(*keys.columns, F.transform("_c", lambda s: s["close"]).alias("_c")).where(
        F.array_min(F.slice("_c", 1, lookback)) > 0)
    rets = F.transform(
        F.sequence(F.lit(1), F.lit(lookback)),
        lambda i: (F.col("_c")[i] - F.col("_c")[i - 1]) / F.col("_c")[i - 1],
    )
    return closes.select(*keys.columns, rets.alias("rets"))


def covariance_rows(windows: DataFrame, *, ridge: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Per (run, date, ticker): position in the basket, mean return and one covariance row.

    Sample covariance times ``scale``, plus ``ridge`` on the diagonal. Baskets
    of fewer than two names have no rows. Basket order is by ``pos`` if
    present, else by ticker.
    """
    has_pos = "pos" in windows.columns

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos" if has_pos else "ticker")
        if len(pdf) < 2:
            return pdf.iloc[:0][["run_id", "date", "ticker"]].assign(
                pos=pd.Series(dtype="int64"), mu=pd.Series(dtype="float64"), cov=pd.Series(dtype="object")
            )
        returns = np.array(pdf["rets"].tolist(), dtype=np.float64)
        cov = np.cov(returns, ddof=1) * scale + ridge * np.eye(len(pdf))
        return pd.DataFrame(
            {
                "run_id": pdf["run_id"].to_numpy(), "date": pdf["date"].to_numpy(), "ticker": pdf["ticker"].to_numpy(),
                "pos": np.arange(len(pdf)), "mu": returns.mean(axis=1), "cov": list(cov),
            }
        )

    schema = "run_id string, date date, ticker string, pos long, mu double, cov array<double>"
    return windows.groupBy("run_id", "date").applyInPandas(matrix, schema)


def project_capped_simplex(v: np.ndarray, upper: float) -> np.ndarray:
    """Nearest point with entries in ``[0, upper]`` that sum to 1.

    The shift is found exactly where no entry reaches the cap, else by bisection.
    """
    high = np.sort(v)[::-1]
    sums = (np.cumsum(high) - 1.0) / np.arange(1, len(v) + 1)
    point = np.maximum(v - sums[np.nonzero(high > sums)[0][-1]], 0.0)
    if point.max() <= upper:
        return point
    lo, hi = v.min() - 1.0, v.max()
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if np.clip(v - mid, 0.0, upper).sum() > 1.0:
            lo = mid
        else:
            hi = mid
    return np.clip(v - 0.5 * (lo + hi), 0.0, upper)


def solve_long_only(quad: np.ndarray, lin: np.ndarray, upper: float = 1.0) -> np.ndarray | None:
    """Minimise ``w'Qw/2 - l'w`` over the capped simplex; None when it does not converge."""
    n = len(lin)
    top = float(np.linalg.eigvalsh(quad)[-1])
    w = np.full(n, 1.0 / n)
    if top <= 0.0 and not np.any(lin):
        return w
    step = 1.0 / max(top, 1e-18)
    point, momentum, best = w.copy(), 1.0, np.inf
    for _ in range(MAX_ITERATIONS):
        new = project_capped_simplex(point - step * (quad @ point - lin), upper)
        value = 0.5 * new @ quad @ new - lin @ new
        if value > best:
            point, momentum = w.copy(), 1.0
            new = project_capped_simplex(point - step * (quad @ point - lin), upper)
            value = 0.5 * new @ quad @ new - lin @ new
        grown = 0.5 * (1.0 + np.sqrt(1.0 + 4.0 * momentum * momentum))
        point = new + (momentum - 1.0) / grown * (new - w)
        shift, w, momentum, best = float(np.abs(new - w).max()), new, grown, value
        if shift <= SOLVER_TOLERANCE:
            return w
    return None


def cut_weights(w: np.ndarray) -> np.ndarray:
    """Clip, normalise, and cut down to six digits; all zero becomes equal weight."""
    kept = np.where(w < 0.0, 0.0, w)
    total = kept.sum()
    if total <= 0.0:
        return np.full(len(w), 1.0 / len(w))
    return np.floor(kept / total * 1e6) / 1e6


def expected_returns(selected: DataFrame, *, by: tuple[str, ...] = ("run_id", "date")) -> DataFrame:
    """Scores as expected returns: population z-score inside the selection, times a fixed scale; flat gives 0."""
    stats = selected.groupBy(*by).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_sd"))
    z = F.when(F.col("_sd") > 0, SCORE_RETURN_SCALE * (F.col("score") - F.col("_m")) / F.col("_sd")).otherwise(0.0)
    return selected.join(stats, list(by)).withColumn("mu", z).drop("_m", "_sd")


def cost_aware_inputs(
    selected: DataFrame, bars: DataFrame, *, lookback: int = 252, ridge: float = 1e-6, keep: tuple[str, ...] = ("start",)
) -> DataFrame:
    """What the cost-aware decision needs at each rebalance: expected return and covariance row per name.

    Names without enough history drop out first; the z-score is over the rest.
    """
    cols = ["run_id", "date", "ticker", "score", "rank", *[c for c in keep if c in selected.columns]]
    windows = return_windows(selected.select(*cols), bars, lookback=lookback).withColumnRenamed("rank", "pos")
    rows = covariance_rows(windows, ridge=ridge, scale=TRADING_DAYS).drop("mu")
    scored = expected_returns(windows.select("run_id", "date", "ticker", "score"))
    return rows.join(scored, ["run_id", "date", "ticker"]).select("run_id", "date", "ticker", "pos", "mu", "cov")


def cost_aware_step(
    cov: np.ndarray, mu: np.ndarray, now: np.ndarray, *, risk_aversion: float, turnover_aversion: float, max_weight: float
) -> np.ndarray | None:
    """Weights that trade risk and return against the distance from the current book."""
    n = len(mu)
    quad = risk_aversion * cov + turnover_aversion * np.eye(n)
    w = solve_long_only(quad, mu + turnover_aversion * now, max(max_weight, 1.0 / n))
    return None if w is None else cut_weights(w)
