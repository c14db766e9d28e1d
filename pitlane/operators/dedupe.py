"""Last-wins clean-up of filings and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes last in ``order``.

    Rows have no order of their own in Spark, so the order columns are named.
    An aggregate, not a window: duplicates of one key are reduced before the
    shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def last_wins_filings(filings: DataFrame, order: Sequence[str] = ("lastupdated",)) -> DataFrame:
    return last_wins(filings, ["ticker", "dimension", "datekey"], order)


def last_wins_scores(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    return last_wins(scores, ["ticker", "date"], order)
