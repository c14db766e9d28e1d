"""As-of joins, forward returns: what was known, and what came next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.operators.ordered import _key, span

STALE_DAYS = 10
YEAR_LAG_DAYS = 365


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    *,
    direction: str = "backward",
    strict: bool = False,
    tolerance_days: int | None = None,
    matched_ts: str | None = None,
    span_days: int | None = None,
) -> DataFrame:
    """Left as-of join: each left row gets the nearest right row at or before it
    (``direction='forward'``: at or after; ``strict`` excludes equal times).

    The whole right row is taken, never field by field, so a field that is null
    in the latest row stays null. For series semantics drop null values first.
    Right rows must be unique per ``(on, right_ts)``.

    Facts and probes are unioned and scanned once per key: one pass over each
    side, one shuffle. A key's tape is bounded by the calendar while both sides
    are daily. For finer times pass ``span_days``: keys are cut into time spans,
    and one carried row per span brings in the last fact of the earlier ones.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, got {direction!r}")
    on = list(on)
    backward = direction == "backward"

    value = F.struct(F.col(right_ts).alias("_ts"), *[F.col(c) for c in values])
    known = right.where(F.col(right_ts).isNotNull())
    for c in on:
        known = known.where(F.col(c).isNotNull())
    facts = known.select(*on, F.col(right_ts).alias("_t"), value.alias("_v"))
    probes = left.select(*on, F.col(left_ts).alias("_t"), F.struct(*left.columns).alias("_row"))
    v_type, row_type = facts.schema["_v"].dataType, probes.schema["_row"].dataType
    t_type = probes.schema["_t"].dataType
    facts = facts.withColumn("_t", F.col("_t").cast(t_type))
    parts = list(on)
    if span_days is not None:
        facts = facts.withColumn("_s", span("_t", span_days))
        probes = probes.withColumn("_s", span("_t", span_days))
        parts.append("_s")

    fact_rank, probe_rank = (1, 0) if strict else (0, 1)
    no_row, no_value = F.lit(None).cast(row_type).alias("_row"), F.lit(None).cast(v_type).alias("_v")
    tape = facts.select(*parts, F.lit(1).alias("_o"), "_t", F.lit(fact_rank).alias("_k"), "_v", no_row).unionByName(
        probes.select(*parts, F.lit(1).alias("_o"), "_t", F.lit(probe_rank).alias("_k"), no_value, "_row")
    )
    if span_days is not None:
        tape = tape.unionByName(_carried(facts, probes, on, backward).select(
            *parts, F.lit(0).alias("_o"), F.lit(None).cast(t_type).alias("_t"), F.lit(0).alias("_k"), "_v", no_row
        ))
    along = (
        Window.partitionBy(*([F.col(c) for c in parts] or _key(on)))
        .orderBy("_o", F.col("_t").asc() if backward else F.col("_t").desc(), "_k")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hit = tape.withColumn("_hit", F.last("_v", ignorenulls=True).over(along)).where(F.col("_row").isNotNull())
    if tolerance_days is not None:
        age = F.abs(F.datediff(F.col("_t"), F.col("_hit._ts")))
        hit = hit.withColumn("_hit", F.when(age <= tolerance_days, F.col("_hit")))
    extra = [F.col("_hit._ts").alias(matched_ts)] if matched_ts else []
    return hit.select("_row.*", *extra, *[F.col(f"_hit.{c}").alias(c) for c in values])


def _carried(facts: DataFrame, probes: DataFrame, on: Sequence[str], backward: bool) -> DataFrame:
    """Per (key, span): the last fact of the spans before it (after it, when looking forward)."""
    edge = F.max_by("_v", "_t") if backward else F.min_by("_v", "_t")
    edges = facts.groupBy(*on, "_s").agg(edge.alias("_e"))
    asked = probes.select(*on, "_s").distinct().withColumn("_e", F.lit(None).cast(edges.schema["_e"].dataType))
    spans = edges.unionByName(asked).groupBy(*on, "_s").agg(F.first("_e", ignorenulls=True).alias("_e"))
    along = (
        Window.partitionBy(*_key(on))
        .orderBy(F.col("_s").asc() if backward else F.col("_s").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = spans.select(*on, "_s", F.last("_e", ignorenulls=True).over(along).alias("_v"))
    return carried.where(F.col("_v").isNotNull())


def series(df: DataFrame, value: str) -> DataFrame:
    """Series semantics: rows whose value is missing do not exist."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))


def forward_return(
    left: DataFrame,
    prices: DataFrame,
    *,
    on: Sequence[str] = ("ticker",),
    now: str = "date",
    after: str = "next_date",
    price: str = "close",
    price_ts: str = "date",
    stale_days: int | None = STALE_DAYS,
    need_later_exit: bool = True,
    out: str = "ret",
) -> DataFrame:
    """``exit / entry - 1`` between two as-of reads of one price series.

    The entry must be at most ``stale_days`` old and the exit observation must
    come after the entry observation; otherwise, or when the entry price is
    zero, the return is null.
    """
    quotes = series(prices, price).select(*on, F.col(price_ts).alias("_qd"), F.col(price).alias("_px"))
    entry = asof_join(left, quotes, on, now, "_qd", ["_px"], matched_ts="_s0").withColumnRenamed("_px", "_p0")
    both = asof_join(entry, quotes, on, after, "_qd", ["_px"], matched_ts="_s1").withColumnRenamed("_px", "_p1")
    ok = F.col(after).isNotNull() & (F.col("_p0") != 0) & F.col("_p1").isNotNull()
    if stale_days is not None:
        ok = ok & (F.datediff(F.col(now), F.col("_s0")) <= stale_days)
    if need_later_exit:
        ok = ok & (F.col("_s1") > F.col("_s0"))
    ret = F.when(ok, F.try_divide("_p1", "_p0") - 1)
    return both.select(*left.columns, ret.alias(out))
