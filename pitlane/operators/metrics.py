"""Equity curves to metrics: one row per run and timestamp in, one wide row per run out.

An equity table has one row per run and calendar date, so a run's curve is as
long as the calendar and its windows are small; the rows behind it are
aggregated before they get here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane.functions.scalar import PERIODS_PER_YEAR, SECONDS_PER_YEAR, annualised
from pitlane.functions.stats import nonzero_ratio, sample_std, sharpe

METRICS = (
    "total_return", "cagr", "volatility", "sharpe_ratio", "max_drawdown", "turnover", "benchmark_return",
    "active_return", "tracking_error", "information_ratio", "beta", "jensens_alpha",
)
PERCENT_METRICS = (
    "total_return", "cagr", "volatility", "max_drawdown", "benchmark_return", "active_return", "tracking_error",
    "jensens_alpha",
)


def _along(by: Sequence[str], ts: str) -> Window:
    return Window.partitionBy(*by).orderBy(ts)


def returns(equity: DataFrame, *, by: Sequence[str] = ("run_id",), ts: str = "ts", value: str = "equity") -> DataFrame:
    """Period returns; null on the first step and after a step at or below zero."""
    prev = F.lag(value).over(_along(by, ts))
    return equity.withColumn("ret", F.when(prev > 0, (F.col(value) - prev) / prev))


def paired_returns(equity: DataFrame, *, by: Sequence[str] = ("run_id",), ts: str = "ts") -> DataFrame:
    """Book and benchmark returns of the steps where both are defined."""
    w = _along(by, ts)
    pe, pl = F.lag("equity").over(w), F.lag("level").over(w)
    ok = (pe > 0) & (pl > 0) & F.col("level").isNotNull()
    return equity.withColumn("pair_ret", F.when(ok, (F.col("equity") - pe) / pe)).withColumn(
        "bench_ret", F.when(ok, (F.col("level") - pl) / pl)
    )


def drawdown(equity: DataFrame, *, by: Sequence[str] = ("run_id",), ts: str = "ts", value: str = "equity") -> DataFrame:
    """Distance below the running peak; 0 while the peak is not positive."""
    peak = F.max(value).over(_along(by, ts).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return equity.withColumn("drawdown", F.when(peak > 0, (F.col(value) - peak) / peak).otherwise(F.lit(0.0)))


def growth(equity: DataFrame, *, by: Sequence[str] = ("run_id",), ts: str = "ts", value: str = "equity") -> DataFrame:
    """Growth of 1 from the first known value; a zero base is undefined, so null."""
    base = F.first(value, ignorenulls=True).over(
        _along(by, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return equity.withColumn("growth", F.when(base != 0, F.col(value) / base))


def fill_stats(fills: DataFrame, *, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Count and gross notional of the filled orders."""
    return fills.where("status = 'filled'").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fills"), F.sum(F.col("qty") * F.col("price")).alias("notional")
    )


def run_metrics(
    equity: DataFrame, fills: DataFrame | None = None, *, by: Sequence[str] = ("run_id",), ts: str = "ts",
    periods: int = PERIODS_PER_YEAR,
) -> DataFrame:
    """The metric catalogue, one row per run. ``equity`` may lack a ``level`` column."""
    by = list(by)
    if "level" not in equity.columns:
        equity = equity.withColumn("level", F.lit(None).cast("double"))
    steps = drawdown(paired_returns(returns(equity, by=by, ts=ts), by=by, ts=ts), by=by, ts=ts)
    active = F.col("pair_ret") - F.col("bench_ret")
    known = F.col("level").isNotNull()
    pairs = F.count("pair_ret")
    beta = nonzero_ratio(F.covar_samp("pair_ret", "bench_ret"), F.var_samp("bench_ret"))
    agg = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.min_by("equity", ts).alias("start_equity"),
        F.max_by("equity", ts).alias("final_equity"),
        (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("_secs"),
        F.when(F.count("ret") >= 2, annualised(sample_std("ret"), periods)).otherwise(0.0).alias("volatility"),
        annualised(sharpe("ret"), periods).alias("sharpe_ratio"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.count("level").alias("_known"),
        F.min_by("level", F.when(known, F.col(ts))).alias("_l0"),
        F.max_by("level", F.when(known, F.col(ts))).alias("_l1"),
        annualised(F.when(pairs >= 2, F.stddev_samp(active)), periods).alias("tracking_error"),
        annualised(sharpe(active), periods).alias("information_ratio"),
        beta.alias("beta"),
        ((F.avg("pair_ret") - beta * F.avg("bench_ret")) * F.lit(float(periods))).alias("jensens_alpha"),
    )
    years = F.col("_secs") / F.lit(float(SECONDS_PER_YEAR))
    whole = (F.col("start_equity") > 0) & (F.col("final_equity") > 0) & (F.col("_secs") > 0)
    bench = F.when((F.col("_known") >= 2) & (F.col("_l0") > 0), (F.col("_l1") - F.col("_l0")) / F.col("_l0"))
    out = (
        agg.withColumn("total_return", F.try_divide(F.col("final_equity") - F.col("start_equity"), "start_equity"))
        .withColumn("cagr", F.when(whole, F.exp(F.ln(F.col("final_equity") / F.col("start_equity")) / years) - 1))
        .withColumn("benchmark_return", bench)
        .withColumn("active_return", F.col("total_return") - F.col("benchmark_return"))
    )
    if fills is not None:
        out = out.join(fill_stats(fills, by=by), by, "left")
        out = out.withColumn("n_fills", F.coalesce("n_fills", F.lit(0).cast("bigint"))).withColumn(
            "notional", F.coalesce("notional", F.lit(0.0))
        )
    else:
        out = out.withColumn("n_fills", F.lit(0).cast("bigint")).withColumn("notional", F.lit(0.0))
    turnover = F.when(F.col("start_equity") > 0, F.col("notional") / F.col("start_equity")).otherwise(0.0)
    return out.withColumn("turnover", turnover).select(
        *by, "n_steps", "start_equity", "final_equity", "n_fills", "notional", *METRICS
    )


def metrics_long(wide: DataFrame, *, by: Sequence[str] = ("run_id",), names: Sequence[str] = METRICS) -> DataFrame:
    """One row per run and metric."""
    pairs = ", ".join(f"'{m}', {m}" for m in names)
    return wide.select(*by, F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))


def summary_text(wide: DataFrame) -> DataFrame:
    """The headline numbers as text, ``n/a`` where undefined."""

    def pct(c: str) -> Column:
        return F.coalesce(F.concat(F.format_number(F.col(c) * 100, 2), F.lit(" %")), F.lit("n/a"))

    def num(c: str) -> Column:
        return F.coalesce(F.format_number(c, 3), F.lit("n/a"))

    texts = {c: pct(c) for c in PERCENT_METRICS} | {c: num(c) for c in ("sharpe_ratio", "information_ratio", "beta")}
    texts["start_equity"] = F.concat(F.format_number("start_equity", 2), F.lit(" USD"))
    texts["final_equity"] = F.concat(F.format_number("final_equity", 2), F.lit(" USD"))
    texts["turnover"] = F.concat(F.format_number("turnover", 2), F.lit(" x"))
    texts["n_fills"] = F.col("n_fills").cast("string")
    return wide.select("run_id", *[c.alias(n) for n, c in sorted(texts.items())])
