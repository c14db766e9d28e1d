"""Target weights: ``(run_id, date, ticker, weight)``; a step without rows is left alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane.functions.scalar import WEIGHT_DIGITS, share_down
from pitlane.operators.asof import asof_join
from pitlane.operators.ordered import row_index, shifted
from pitlane.operators.ranks import top_k

WEIGHT_TOLERANCE = 1e-9


def run_timeline(runs: DataFrame, calendar: DataFrame) -> DataFrame:
    """``(run_id, date)`` for every calendar date inside each run, matched month by month."""
    days = calendar.select("date").distinct().withColumn("_m", F.trunc("date", "month"))
    laid = runs.select(
        "run_id", "start", "end",
        F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("INTERVAL 1 MONTH"))).alias("_m"),
    )
    return laid.join(days, "_m").where((F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end"))).select(
        "run_id", "date"
    )


def every_nth(timeline: DataFrame, n: int, *, by: Sequence[str] = ("run_id",), date: str = "date") -> DataFrame:
    """Every ``n``-th step of each run, from the first. A run is as long as the calendar."""
    if n < 1:
        raise ValueError(f"n must be >= 1, got {n}")
    w = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy(date)
    return timeline.withColumn("step", F.row_number().over(w) - 1).where(F.col("step") % n == 0)


def buy_and_hold(timeline: DataFrame, symbols: DataFrame) -> DataFrame:
    """``1/n`` once, at the first step of each run. ``symbols`` is ``(run_id, ticker)``."""
    first = timeline.groupBy("run_id").agg(F.min("date").alias("date"))
    return _equal(symbols.join(first, "run_id"))


def equal_weight(rebalances: DataFrame, symbols: DataFrame) -> DataFrame:
    """``1/n`` at every rebalance."""
    return _equal(symbols.join(rebalances.select("run_id", "date"), "run_id"))


def _equal(picks: DataFrame) -> DataFrame:
    sizes = picks.groupBy("run_id", "date").agg(F.count(F.lit(1)).alias("_n"))
    return picks.join(sizes, ["run_id", "date"]).select(
        "run_id", "date", "ticker", (F.lit(1.0) / F.col("_n")).alias("weight")
    )


def momentum_table(
    bars: DataFrame, *, lookback: int = 126, skip: int = 0, span_days: int | None = None
) -> DataFrame:
    """Return over ``lookback`` bars of the symbol itself, ending ``skip`` bars ago, at each bar.

    Daily bars: a symbol's history is bounded by the calendar, so both reads are
    lags in one window. For finer bars pass ``span_days``: bars are numbered in
    spans and the past ones fetched by equi-joins on the number.
    """
    if lookback < 1:
        raise ValueError(f"lookback must be >= 1, got {lookback}")
    if skip < 0:
        raise ValueError(f"skip must be >= 0, got {skip}")
    rows = bars.select("ticker", "date", "close")
    if span_days is None:
        w = Window.partitionBy("ticker").orderBy("date")
        past = rows.select(
            "ticker", "date", F.lag("close", skip).over(w).alias("recent"),
            F.lag("close", skip + lookback).over(w).alias("past"), F.lag("date", skip + lookback).over(w).alias("past_date"),
        )
    else:
        numbered = row_index(rows, ["ticker"], "date", span_days=span_days)
        recent = shifted(numbered, ["ticker"], "idx", skip, {"recent": "close"})
        past = shifted(recent, ["ticker"], "idx", skip + lookback, {"past": "close", "past_date": "date"})
    mom = F.when(F.col("past") > 0, (F.col("recent") - F.col("past")) / F.col("past"))
    return past.select("ticker", "date", "past_date", mom.alias("momentum"))


def momentum_at(keys: DataFrame, bars: DataFrame, *, lookback: int = 126, skip: int = 0) -> DataFrame:
    """Momentum as of each ``(ticker, date)`` key; a ``start`` column limits the history used."""
    table = momentum_table(bars, lookback=lookback, skip=skip).withColumnRenamed("date", "_bd")
    read = asof_join(keys, table, ["ticker"], "date", "_bd", ["momentum", "past_date"])
    if "start" in keys.columns:
        read = read.where(F.col("past_date") >= F.col("start"))
    return read.where(F.col("momentum").isNotNull()).drop("past_date")


def momentum_weights(
    rebalances: DataFrame, symbols: DataFrame, bars: DataFrame, *, lookback: int = 126, skip: int = 0,
    k: int = 10, tie: str = "ticker",
) -> DataFrame:
    """Equal weight in the ``k`` best momentum names; ties in the order of column ``tie``."""
    keys = symbols.join(rebalances, "run_id")
    scored = momentum_at(keys, bars, lookback=lookback, skip=skip)
    return _equal(top_k(scored, ["run_id", "date"], [F.col("momentum").desc(), F.col(tie)], k))


def default_momentum_k(n_symbols: int, k: int | None = None) -> int:
    chosen = k if k is not None else max(1, n_symbols // 2)
    if not 1 <= chosen <= n_symbols:
        raise ValueError(f"top_k must be in [1, {n_symbols}], got {k}")
    return chosen


def score_equal(selected: DataFrame) -> DataFrame:
    """Equal weight over the selected names. ``selected`` is ``(run_id, date, ticker, score)``."""
    return _equal(selected)


def score_proportional(selected: DataFrame) -> DataFrame:
    """Positive scores over their sum, cut down to six digits, zero weights dropped.

    When no score is positive, equal weight over all selected names. Scores are
    taken as decimals, so a share that is exact, such as one fifth, stays exact.
    """
    exact = selected.withColumn("_s", F.col("score").cast("decimal(20,12)"))
    sums = exact.groupBy("run_id", "date").agg(
        F.sum(F.when(F.col("_s") > 0, F.col("_s"))).alias("_t"), F.count(F.lit(1)).alias("_n")
    )
    joined = exact.join(sums, ["run_id", "date"])
    by_score = F.when(F.col("_s") > 0, share_down("_s", "_t"))
    flat = F.floor(F.lit(10.0**WEIGHT_DIGITS) / F.col("_n")).cast("double") / F.lit(10.0**WEIGHT_DIGITS)
    weight = F.when(F.col("_t").isNull(), flat).otherwise(by_score)
    return joined.select("run_id", "date", "ticker", weight.alias("weight")).where(F.col("weight") > 0)


def bad_weights(weights: DataFrame) -> DataFrame:
    """Steps whose weights break the rules: a negative weight, or a sum above 1."""
    per = weights.groupBy("run_id", "date").agg(F.min("weight").alias("lowest"), F.sum("weight").alias("total"))
    return per.where((F.col("lowest") < 0) | (F.col("total") > 1 + WEIGHT_TOLERANCE))


def repeated_symbols(basket: DataFrame) -> DataFrame:
    """(run_id, ticker, n) of the names that a basket lists more than once; a basket must have none. Null names count too."""
    return basket.groupBy("run_id", "ticker").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def trades(
    targets: DataFrame, held: DataFrame, equity: DataFrame, closes: DataFrame, *, cash_buffer: float = 0.02,
    min_notional: float = 0.0,
) -> DataFrame:
    """Orders that move the held quantities to the target weights.

    ``targets`` and ``held`` are full-outer-joined per (run, date, ticker), a
    missing side counting as 0. ``side_order`` puts sells first; within a side
    orders go by ticker.
    """
    if not 0 <= cash_buffer < 1:
        raise ValueError(f"cash_buffer must be in [0, 1), got {cash_buffer}")
    if min_notional < 0:
        raise ValueError(f"min_notional must be non-negative, got {min_notional}")
    keys = ["run_id", "date", "ticker"]
    both = targets.select(*keys, "weight").join(held.select(*keys, "qty"), keys, "full")
    priced = both.join(equity.select("run_id", "date", "equity"), ["run_id", "date"]).join(
        closes.select("ticker", "date", "close"), ["ticker", "date"]
    ).where(F.col("close") > 0)
    target = F.col("equity") * (1 - cash_buffer) * F.coalesce("weight", F.lit(0.0)) / F.col("close")
    moved = priced.withColumn("delta", target - F.coalesce("qty", F.lit(0.0)))
    wanted = moved.where((F.abs("delta") * F.col("close") >= min_notional) & (F.col("delta") != 0))
    side: Column = F.when(F.col("delta") < 0, "sell").otherwise("buy")
    return wanted.select(
        *keys, side.alias("side"), F.abs("delta").alias("qty"), (F.col("delta") > 0).cast("int").alias("side_order")
    )


def valued_weights(held: DataFrame, *, by: tuple[str, ...] = ("run_id", "date")) -> DataFrame:
    """Weight of every holding (qty, close) in the value of its book; null where the book is worth nothing."""
    worth = F.col("qty") * F.col("close")
    total = held.groupBy(*by).agg(F.sum(worth).alias("_v"))
    return held.join(total, list(by)).withColumn("weight", F.when(F.col("_v") > 0, worth / F.col("_v"))).drop("_v")
