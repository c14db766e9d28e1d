"""Spark session factory and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "pitlane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI, AQE."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application; they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="spark-")) / f"{here.name}.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(bundle))
    _shipped.add(app)


#: Rows of input for which a shuffle begins with one more partition.
ROWS_PER_PART = 250_000
_INITIAL, _PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"


def spread(spark: SparkSession, rows: int) -> None:
    """Let shuffles begin with partitions in proportion to the input, ``spark.sql.shuffle.partitions`` at least.

    A fixed number of them would make what a task holds grow with the input. Spark joins those that turn out small.
    """
    spark.conf.set(_INITIAL, str(max(int(spark.conf.get(_PARTS)), -(-rows // ROWS_PER_PART))))


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle begins with."""
    return int(spark.conf.get(_INITIAL, None) or spark.conf.get(_PARTS))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` once as a table in the shared folder and read it back.

    Used where a result is read by several later branches (the monthly panel),
    so that they do not each recompute it. A Parquet table survives lost
    executors, later reads take only the columns they need, and its size is
    known when joins are planned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
