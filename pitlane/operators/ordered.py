"""Scans along time for one key.

Tables here hold at most one row (or a fixed few) per key and calendar day, so
the history of a key is as long as the calendar, some tens of thousands of
rows in a century, however large the table is: one window per key, one shuffle
and one pass. Where times are finer than days that bound is gone; then pass
``span_days``. Each key is cut into spans of that many days, every span is
scanned by its own task, and what it needs from earlier spans is one summary
row per span, aggregated map-side. That costs a second pass over the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def span(ts: Column | str, days: int) -> Column:
    """Index of the time span that ``ts`` (date or timestamp) falls in."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_date(col.cast("date")) / F.lit(days)).cast("int")


def _key(on: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in on] or [F.lit(0)]


def previous(
    df: DataFrame, on: Sequence[str], ts: str | Sequence[str], cols: Mapping[str, str], *, span_days: int | None = None
) -> DataFrame:
    """``lag`` by one row along ``ts`` per key; ``cols`` maps new name to source column."""
    names = df.columns
    order = [ts] if isinstance(ts, str) else list(ts)
    value = F.struct(*[F.col(src).alias(out) for out, src in cols.items()])
    if span_days is None:
        w = Window.partitionBy(*_key(on)).orderBy(*order)
        return df.select(*df.columns, *[F.lag(src, 1).over(w).alias(out) for out, src in cols.items()])
    base = df.withColumn("_s", span(order[0], span_days)).withColumn("_v", value).withColumn("_t", F.struct(*order))
    tails = base.groupBy(*on, "_s").agg(F.max_by("_v", "_t").alias("_tail"))
    along = Window.partitionBy(*_key(on)).orderBy("_s")
    carry = tails.select(*on, "_s", F.lag("_tail", 1).over(along).alias("_v")).where(F.col("_v").isNotNull())
    rows = base.select(*on, "_s", F.lit(1).alias("_o"), "_t", "_v", F.struct(*names).alias("_row"))
    row_type = rows.schema["_row"].dataType
    heads = carry.select(
        *on, "_s", F.lit(0).alias("_o"), F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"), "_v",
        F.lit(None).cast(row_type).alias("_row"),
    )
    inside = Window.partitionBy(*_key(on), "_s").orderBy("_o", "_t")
    lagged = rows.unionByName(heads).withColumn("_p", F.lag("_v", 1).over(inside)).where(F.col("_row").isNotNull())
    return lagged.select("_row.*", *[F.col(f"_p.{out}").alias(out) for out in cols])


def running(
    df: DataFrame,
    on: Sequence[str],
    ts: str | Sequence[str],
    sums: Mapping[str, Column],
    *,
    span_days: int | None = None,
) -> DataFrame:
    """Inclusive running sums along ``ts`` per key. ``sums`` maps new name to a summand."""
    order = [ts] if isinstance(ts, str) else list(ts)
    if span_days is None:
        w = Window.partitionBy(*_key(on)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*df.columns, *[F.sum(expr).over(w).alias(out) for out, expr in sums.items()])
    base = df.withColumn("_s", span(order[0], span_days))
    for out, expr in sums.items():
        base = base.withColumn(f"_x_{out}", expr)
    totals = base.groupBy(*on, "_s").agg(*[F.sum(f"_x_{o}").alias(f"_t_{o}") for o in sums])
    before = Window.partitionBy(*_key(on)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*on, "_s", *[F.sum(f"_t_{o}").over(before).alias(f"_c_{o}") for o in sums])
    inside = (
        Window.partitionBy(*_key(on), "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = base.repartition(*on, "_s").join(carry, [*on, "_s"], "left")
    return out.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_c_{o}"), F.lit(0)) + F.sum(f"_x_{o}").over(inside)).alias(o)
            for o in sums
        ],
    )


def row_index(
    df: DataFrame, on: Sequence[str], ts: str | Sequence[str], name: str = "idx", *, span_days: int | None = None
) -> DataFrame:
    """Position of each row along ``ts`` within its key, counted from 0."""
    return running(df, on, ts, {name: F.lit(1).cast("bigint")}, span_days=span_days).withColumn(
        name, F.col(name) - 1
    )


def shifted(
    df: DataFrame, on: Sequence[str], index: str, steps: int, cols: Mapping[str, str]
) -> DataFrame:
    """Values ``steps`` rows back, found by an equi-join on the row position."""
    back = df.select(
        *on, (F.col(index) + F.lit(steps)).alias(index), *[F.col(src).alias(out) for out, src in cols.items()]
    )
    return df.join(back, [*on, index], "left")


def attach(df: DataFrame, on: Sequence[str], *, few: bool = False, **stats: Column) -> DataFrame:
    """Join group statistics onto the rows: partial aggregation, so no group has to fit one task.

    Reads ``df`` twice; give it something cheap to read again. With ``few`` groups (the dates of a calendar) the
    statistics go to the rows, which stay where they are.
    """
    found = df.groupBy(*on).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(F.broadcast(found) if few else found, list(on))
