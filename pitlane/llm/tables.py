"""Reading the given tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a given table; without any, all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in small batches: some thousand whole texts are tens of megabytes, several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
