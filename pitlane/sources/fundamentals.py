"""Filings: schema probe, as-reported dimensions, empty rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.operators.asof import asof_join
from pitlane.operators.ranks import top_k
from pitlane.sources.prices import clean

# Default fields, identity columns and as-reported dimensions.
DEFAULT_FIELDS = (
    "revenue", "gp", "opinc", "netinc", "ebitda", "eps", "epsdil", "assets", "liabilities", "equity", "debt", "fcf",
    "ncfo", "roe", "roa",
)
IDENTITY = ("ticker", "dimension", "datekey")
AS_REPORTED = ("ARQ", "ART", "ARY")


def available_fields(df: DataFrame, fields: Sequence[str] | None = None) -> list[str]:
    """Requested fields that the table has; none at all is an error."""
    asked = list(fields) if fields is not None else list(DEFAULT_FIELDS)
    present = [f for f in asked if f in df.columns]
    if not present:
        raise ValueError(f"none of the requested fields exist: {asked}")
    return present


def select_filings(
    df: DataFrame, *, fields: Sequence[str] | None = None, dimensions: Sequence[str] = AS_REPORTED,
    symbols: DataFrame | Sequence[str] | None = None,
) -> DataFrame:
    """Filings of the dimensions with at least one requested field known."""
    present = available_fields(df, fields)
    rows = clean(df.where(F.col("dimension").isin(list(dimensions))).select(*IDENTITY, *present), present)
    if isinstance(symbols, DataFrame):
        rows = rows.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    elif symbols is not None:
        rows = rows.where(F.col("ticker").isin(list(symbols)))
    return rows.where(F.coalesce(*present).isNotNull())


def load_filings(spark: SparkSession, path: str, *, check: bool = True, **options) -> DataFrame:
    rows = select_filings(spark.read.parquet(path), **options)
    if check and rows.isEmpty():
        raise ValueError(f"no filings for the requested symbols and dimensions in {path}")
    return rows


def narrow(filings: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per known field of a filing."""
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    return filings.select(*IDENTITY, F.expr(f"stack({len(fields)}, {pairs}) AS (field, value)")).where("value IS NOT NULL")


def known_fields(filings: DataFrame, fields: Sequence[str]) -> DataFrame:
    return narrow(filings, fields).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def first_known(basket: DataFrame, filings: DataFrame, field: str, as_of: str, *, dimension: str = "ART") -> DataFrame:
    """The first symbol of the basket, by name, with a known field as of a day."""
    asked = basket.select("ticker").distinct().withColumn("as_of", F.lit(as_of).cast("date"))
    filed = filings.where(F.col("dimension") == dimension)
    read = asof_join(asked, filed, ["ticker"], "as_of", "datekey", [field]).where(F.col(field).isNotNull())
    return top_k(read, ["as_of"], [F.col("ticker")], 1).select("ticker", "as_of", field)
