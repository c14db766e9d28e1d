"""Sharpe ratios under selection: probabilistic, expected maximum, deflated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.functions.scalar import PERIODS_PER_YEAR, _c, normal_cdf, normal_ppf
from pitlane.functions.stats import kurtosis, sharpe, skewness
from pitlane.operators.metrics import returns

EULER_MASCHERONI = 0.5772156649015329


def probabilistic_sharpe(
    observed: Column | str, benchmark: Column | str | float, n_obs: Column | str, skew: Column | str | float = 0.0,
    kurt: Column | str | float = 3.0,
) -> Column:
    """P[true Sharpe > benchmark]; null with fewer than two observations or a non-positive variance."""
    sr, b, n, g3, g4 = _c(observed), _c(benchmark), _c(n_obs), _c(skew), _c(kurt)
    var = 1.0 - g3 * sr + (g4 - 1.0) / 4.0 * sr * sr
    safe = F.when((n >= 2) & (var > 0), var)
    return normal_cdf((sr - b) * F.sqrt(n - 1.0) / F.sqrt(safe))


def expected_max_sharpe(n_trials: Column | str, sr_variance: Column | str) -> Column:
    """Expected best Sharpe of N unskilled trials; null with fewer than two trials."""
    n, v = _c(n_trials).cast("double"), _c(sr_variance)
    n = F.when(n >= 2, n)
    g = EULER_MASCHERONI
    return F.sqrt(F.when(v >= 0, v)) * (
        (1.0 - g) * normal_ppf(1.0 - 1.0 / n) + g * normal_ppf(1.0 - 1.0 / (n * math.e))
    )


def deflated_sharpe(
    observed: Column | str, n_trials: Column | str, sr_variance: Column | str, n_obs: Column | str,
    skew: Column | str | float = 0.0, kurt: Column | str | float = 3.0,
) -> Column:
    return probabilistic_sharpe(observed, expected_max_sharpe(n_trials, sr_variance), n_obs, skew, kurt)


def verdict(dsr: Column | str) -> Column:
    d = _c(dsr)
    return F.when(d > 0.95, "survives").when(d < 0.5, "does NOT survive").when(d.isNotNull(), "marginal under")


def trial_sharpes(equity: DataFrame) -> DataFrame:
    """Per-period Sharpe and return moments of every run. ``equity`` has run_id, start, end, ts, equity."""
    rets = returns(equity, by=["run_id", "start", "end"]).where(F.col("ret").isNotNull())
    return rets.groupBy("run_id", "start", "end").agg(
        F.count(F.lit(1)).alias("n_obs"), sharpe("ret").alias("sharpe"), skewness("ret").alias("skew"),
        kurtosis("ret").alias("kurt"),
    )


def same_window(trials: DataFrame, strategy: str) -> DataFrame:
    """The trial family of a run: the runs over exactly its window."""
    own = trials.where(F.col("run_id") == strategy).select("start", "end").distinct()
    return trials.join(own, ["start", "end"], "left_semi")


def other_windows(trials: DataFrame, strategy: str) -> DataFrame:
    """Runs left out of the family because their window differs."""
    own = trials.where(F.col("run_id") == strategy).select("start", "end").distinct()
    return trials.join(own, ["start", "end"], "left_anti").select("run_id", "start", "end").distinct()


def check_family(trials: DataFrame, strategy: str, family: list[str]) -> DataFrame:
    """An explicit family: raises when one of its runs covers another window."""
    named = trials.where(F.col("run_id").isin([*family, strategy]))
    odd = sorted(r["run_id"] for r in other_windows(named, strategy).select("run_id").distinct().collect())
    if odd:  # at most the runs named in the arguments
        raise ValueError(f"not over the window of {strategy!r}: {', '.join(odd)}")
    return named


def deflate(trials: DataFrame) -> DataFrame:
    """Every run deflated against the runs over the same window."""
    family = trials.groupBy("start", "end").agg(
        F.count("sharpe").alias("n_trials"), F.avg("sharpe").alias("mean_sharpe"), F.var_samp("sharpe").alias("sr_var")
    )
    joined = trials.join(family, ["start", "end"])
    return joined.select(
        "run_id", "start", "end", "n_trials", "n_obs", "sharpe", "skew", "kurt", "mean_sharpe", "sr_var",
        (F.col("sharpe") * math.sqrt(PERIODS_PER_YEAR)).alias("sharpe_annual"),
        expected_max_sharpe("n_trials", "sr_var").alias("expected_max"),
        probabilistic_sharpe("sharpe", 0.0, "n_obs", "skew", "kurt").alias("psr"),
        deflated_sharpe("sharpe", "n_trials", "sr_var", "n_obs", "skew", "kurt").alias("dsr"),
    ).withColumn("verdict", verdict("dsr"))
