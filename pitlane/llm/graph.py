"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.session import cut


def components(edges: DataFrame) -> DataFrame:
    """id, comp: the smallest id reachable from every id that has an edge in ``edges`` (a, b).

    Each round points the neighbours of an id at the smallest of them, once upwards and once downwards, and is stored;
    the rounds grow with the logarithm of a component's size. Nothing but two numbers per round reaches the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(
                now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        seen = mark
