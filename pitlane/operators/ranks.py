"""Exact ranks inside a cross-section, also one that is too large for one task.

Each group is cut at a few of its own rows, drawn by hash: one row per hash
class, at most ``cuts`` per group, from one row in :data:`DRAWN`. The pieces are ordered against each other,
so a rank is the rank inside the piece plus the size of the pieces before it.
Cuts are taken on the full ordering key, ties included, so neither a hot date
nor a hot value ends up in one task. Any cuts give the same, exact answer; they
only balance the work. The plan is the same for every size, and nothing runs
while it is built.

The cuts read the input again, so it should be cheap to read: a stored table
or one cut with ``pitlane.session.cut``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 32
#: One row in so many may become a cut, so a group of some hundred rows has few cuts or none, and only these are compared.
DRAWN = 32


def split_prefix(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    measure: Column,
    *,
    before: str = "before",
    total: str | None = "n",
    cuts: int = CUTS,
    few: bool = False,
) -> DataFrame:
    """Adds the sum of ``measure`` over the rows strictly before this one, and the group total.

    ``order`` must be non-null and give a total order inside each group. With ``few`` groups (dates, features) their
    cuts and sizes go to the rows, which are then shuffled and sorted once.
    """
    sent = F.broadcast if few else (lambda rows: rows)
    by = list(by)
    # The key is put together where it is compared, and the measure where it is summed: no row carries them through a shuffle.
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    draw = F.xxhash64(key)
    drawn = (
        df.where(F.pmod(draw, F.lit(DRAWN)) == 0)
        .groupBy(*by, F.pmod(F.shiftright(draw, 32), F.lit(cuts)).alias("_h"))
        .agg(F.min(F.struct(draw.alias("d"), key.alias("k"))).alias("_d"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("_d.k")).alias("_cuts"))
    )
    below = [F.coalesce((F.get("_cuts", F.lit(i)) < key).cast("int"), F.lit(0)) for i in range(cuts)]
    placed = df.join(sent(drawn), by, "left").withColumn("_piece", sum(below[1:], below[0]).cast("smallint")).drop("_cuts")
    sizes = placed.groupBy(*by, "_piece").agg(F.sum(measure).alias("_size"))
    group = Window.partitionBy(*by)
    offsets = sizes.select(
        *by, "_piece",
        F.sum("_size").over(group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"),
        F.sum("_size").over(group).alias("_total"),
    )
    inside = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.repartition(*by, "_piece").join(sent(offsets), [*by, "_piece"])
    tail = [F.col("_total").alias(total)] if total else []
    return out.select(
        *df.columns,
        (F.coalesce("_off", F.lit(0)) + F.coalesce(F.sum(measure).over(inside), F.lit(0))).alias(before),
        *tail,
    )


def ordinal_rank(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], *, name: str = "rn", total: str | None = "n",
    cuts: int = CUTS, few: bool = False,
) -> DataFrame:
    """``row_number`` from 1 in ``order`` inside each group, plus the group size."""
    ranked = split_prefix(df, by, order, F.lit(1).cast("bigint"), before=name, total=total, cuts=cuts, few=few)
    return ranked.withColumn(name, F.col(name) + 1)


def rank_table(
    df: DataFrame, by: Sequence[str], value: str, *, name: str = "rank", cuts: int = CUTS
) -> DataFrame:
    """``(by, value, rank)``: fractional ranks of the distinct values, ties sharing their mean position.

    Values are counted before they are ranked, so one shared by most names is one row.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = split_prefix(counts, by, [F.col(value)], F.col("_c"), before="_b", total=None, cuts=cuts)
    return ranked.select(*by, value, (F.col("_b") + (F.col("_c") + 1) / F.lit(2.0)).alias(name))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, *, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark limits each map partition to ``k``
    rows per group before the shuffle, so a hot group stays small."""
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def exact_median(
    df: DataFrame, by: Sequence[str], value: str, *, upper: bool = False, name: str = "median", few: bool = False,
) -> DataFrame:
    """Exact median per group without gathering the group: middle pair mean, or its upper element.

    Approximate quantiles on both sides, whose rank is off by one row in ten thousand at most, enclose the median. Rows
    below are counted; only the distinct values between them, about one in a hundred, are put in order. With ``few``
    groups (signals, cells) their edges are sent to every task, so that a large group stays spread.
    """
    keys = list(by) or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull()).select(*keys, value)
    ends = F.percentile_approx(value, [0.495, 0.505], 10_000)
    edges = rows.groupBy(*keys).agg(ends.alias("_e"), F.count(F.lit(1)).alias("_n"))
    if few or not by:
        edges = F.broadcast(edges)
    known = rows.join(edges, keys).where(F.col(value) <= F.col("_e")[1])
    counts = known.groupBy(*keys, "_n", F.when(F.col(value) >= F.col("_e")[0], F.col(value)).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    # Those below the lower edge have no value and come first.
    along = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_b", F.coalesce(F.sum("_c").over(along), F.lit(0)))
    hi = F.floor(F.col("_n") / 2)
    lo = hi if upper else F.floor((F.col("_n") - 1) / 2)

    def covers(pos: Column) -> Column:
        return (F.col("_b") <= pos) & (pos < F.col("_b") + F.col("_c"))

    out = ranked.where(covers(lo) | covers(hi)).groupBy(*keys).agg(
        ((F.min("_v") + F.max("_v")) / 2).alias(name), F.max("_n").alias("n")
    )
    return out if by else out.drop("_all")
