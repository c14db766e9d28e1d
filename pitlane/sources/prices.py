"""Price tables: scan, price basis, series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = ("closeadj", "closeunadj", "close")
PRICE_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "closeadj", "closeunadj", "volume")
TIMEFRAME = "1Day"


def clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN becomes null: there is one kind of missing."""
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in cols and dict(df.dtypes)[c] == "double" else F.col(c)
                       for c in df.columns])


def select_bars(
    prices: DataFrame, symbols: Sequence[str] | DataFrame | None, start: str, end: str, *, price: str = "closeadj"
) -> DataFrame:
    """Bars of the symbols between two days (inclusive) on one price basis.

    A short symbol list is pushed to the scan as a filter; a table of symbols is
    a semi-join. Opens, highs and lows are scaled by basis over close; where the
    close is not positive they take the basis price.
    """
    if price not in BASES:
        raise ValueError(f"price must be one of {BASES}, got {price!r}")
    rows = prices.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if isinstance(symbols, DataFrame):
        rows = rows.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    elif symbols is not None:
        if not symbols:
            raise ValueError("at least one symbol is required")
        rows = rows.where(F.col("ticker").isin(list(dict.fromkeys(symbols))))
    target = F.col(price)

    def scaled(c: str) -> F.Column:
        return F.when(F.col("close") > 0, F.col(c) * (target / F.col("close"))).otherwise(target)

    return rows.select(
        "ticker", F.col("date"), scaled("open").alias("open"), scaled("high").alias("high"), scaled("low").alias("low"),
        target.alias("close"), "volume", F.lit(TIMEFRAME).alias("timeframe"),
    )


def load_bars(
    spark: SparkSession, path: str, symbols: Sequence[str] | DataFrame | None, start: str, end: str, *,
    price: str = "closeadj", check: bool = True,
) -> DataFrame:
    raw = spark.read.parquet(path).select(*PRICE_COLUMNS)
    bars = select_bars(clean(raw, PRICE_COLUMNS), symbols, start, end, price=price)
    if check and bars.isEmpty():
        raise ValueError(f"no bars between {start} and {end} for the requested symbols in {path}")
    return bars


def load_series(spark: SparkSession, path: str, value: str, symbols: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """``ticker, date, value`` with missing values dropped."""
    rows = clean(spark.read.parquet(path).select("ticker", "date", value), [value]).where(F.col(value).isNotNull())
    if isinstance(symbols, DataFrame):
        return rows.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    return rows if symbols is None else rows.where(F.col("ticker").isin(list(symbols)))


def load_market_caps(spark: SparkSession, path: str, symbols: DataFrame | Sequence[str] | None = None) -> DataFrame:
    return load_series(spark, path, "marketcap", symbols)


def trading_calendar(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct observation dates in a range."""
    day = F.col("date").cast("date")
    return daily.select(day.alias("date")).where(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ).distinct()


def timeline(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct().orderBy("date")


def visible_bars(bars: DataFrame, asked: DataFrame) -> DataFrame:
    """Bars of each request ``(ticker, start, end, as_of)`` that the clock lets through."""
    limit = F.least(F.col("end"), F.col("as_of"))
    return asked.join(bars, "ticker").where((F.col("start") <= F.col("date")) & (F.col("date") <= limit))
