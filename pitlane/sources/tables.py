"""Scores, benchmark, membership and metadata tables; writers and conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.operators.dedupe import last_wins

MEMBERSHIP_SCHEMA = "ticker string, start_date date, end_date date"

# Column types of the bulk exports; all other columns are doubles.
EXPORTS = {
    "sep": {"strings": ("ticker",), "dates": ("date", "lastupdated"), "report": "date"},
    "daily": {"strings": ("ticker",), "dates": ("date", "lastupdated"), "report": "date"},
    "sf1": {
        "strings": ("ticker", "dimension"),
        "dates": ("calendardate", "datekey", "reportperiod", "lastupdated"),
        "report": "datekey",
    },
}


def load_membership(spark: SparkSession, path: str) -> DataFrame:
    """Membership CSV; a blank end is open, a ticker may have several spells."""
    rows = spark.read.schema(MEMBERSHIP_SCHEMA).csv(path, header=True, nullValue="")
    if rows.isEmpty():
        raise ValueError(f"no membership rows found in {path}")
    return rows


def load_scores(spark: SparkSession, path: str, symbols: DataFrame | Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path).select("date", "ticker", "score")
    if isinstance(symbols, DataFrame):
        return rows.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    return rows if symbols is None else rows.where(F.col("ticker").isin(list(symbols)))


def write_scores(scores: DataFrame, path: str, *, mode: str = "overwrite", partition: dict[str, str] | None = None) -> None:
    """``date, ticker, score``; ``partition`` adds constant partition columns such as model and target."""
    out = scores.select("date", "ticker", F.col("score").cast("double"))
    for name, value in (partition or {}).items():
        out = out.withColumn(name, F.lit(value))
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def clean_benchmark(levels: DataFrame, order: Sequence[str]) -> DataFrame:
    """Known levels, one per date; of repeated dates the last in ``order`` wins."""
    known = levels.where(F.col("level").isNotNull())
    return last_wins(known, ["date"], list(order))


def benchmark_faults(levels: DataFrame) -> DataFrame:
    """Counts that must be right for a benchmark: some rows, one per date, all above zero."""
    return levels.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.min("level").alias("lowest"),
        (
            (F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count_distinct("date")) & (F.min("level") > 0)
        ).alias("valid"),
    )


def load_benchmark(
    spark: SparkSession, path: str, *, date_column: str = "Date", level_column: str = "Close"
) -> DataFrame:
    """Benchmark CSV to ``(date, level)``. Blank levels are skipped; a later line wins over an earlier one."""
    raw = spark.read.csv(path, header=True)
    missing = {date_column, level_column} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} must have columns {date_column!r} and {level_column!r}; got {raw.columns}")
    lines = raw.select(
        F.to_date(F.substring(F.col(date_column), 1, 10)).alias("date"),
        F.nullif(F.trim(F.col(level_column)), F.lit("")).cast("double").alias("level"),
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"),
    )
    levels = clean_benchmark(lines, ["file", "line"]).select("date", "level")
    if not benchmark_faults(levels).first()["valid"]:
        raise ValueError(f"benchmark levels in {path} must be non-empty and strictly positive")
    return levels


def export_schema(header: Sequence[str], kind: str) -> T.StructType:
    """Explicit types for a bulk export: named strings, named dates, everything else double."""
    spec = EXPORTS[kind]

    def typed(c: str) -> T.DataType:
        return T.StringType() if c in spec["strings"] else T.DateType() if c in spec["dates"] else T.DoubleType()

    return T.StructType([T.StructField(c, typed(c)) for c in header])


def csv_to_parquet(spark: SparkSession, source: str, target: str, kind: str) -> DataFrame:
    """Typed CSV to Parquet; a large file is read in splits. Returns the conversion stats."""
    header = spark.read.csv(source, header=True).columns
    rows = spark.read.schema(export_schema(header, kind)).csv(
        source, header=True, dateFormat="yyyy-MM-dd", mode="FAILFAST"
    )
    rows.write.mode("overwrite").parquet(target)
    written = spark.read.parquet(target)
    if written.isEmpty():
        raise ValueError(f"{source} contained no rows")
    return conversion_stats(written, EXPORTS[kind]["report"])


def conversion_stats(rows: DataFrame, report_date: str) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
        F.min(report_date).alias("date_min"), F.max(report_date).alias("date_max"),
    )


def write_both(df: DataFrame, stem: str, *, sort_by: Sequence[str] = ()) -> None:
    """Parquet and a CSV mirror, sorted by the sort columns that exist."""
    cols = [c for c in sort_by if c in df.columns]
    ordered = df.orderBy(*cols) if cols else df
    ordered.write.mode("overwrite").parquet(f"{stem}.parquet")
    ordered.write.mode("overwrite").csv(f"{stem}.csv", header=True)


def file_manifest(spark: SparkSession, path: str, *, full_path: bool = False) -> DataFrame:
    """Name (and path, if asked), size and SHA-256 of every file under a path. A file is read as one value: files must
    be smaller than 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        *(["path"] if full_path else []), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def append_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("append").json(path)


def clean_tickers(raw: DataFrame, dates: Sequence[str] = ("firstpricedate", "lastpricedate")) -> DataFrame:
    """Metadata with dates parsed (bad text becomes null), sorted by table and ticker."""
    out = raw
    for c in dates:
        if c in raw.columns:
            out = out.withColumn(c, F.try_to_timestamp(F.col(c).cast("string")).cast("date"))
    return out.orderBy("table", "ticker")


def ticker_counts(tickers: DataFrame) -> DataFrame:
    """Rows and distinct tickers by table and category."""
    return tickers.groupBy("table", "category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers")
    )
