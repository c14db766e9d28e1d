"""Run ledger: artifacts and one ledger line per run, as JSON tables; equity series as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "timestamp timestamp, seq long, slug string, git_commit string, params map<string, string>, "
    "headline map<string, double>, payload string, kind string"
)
SERIES_SCHEMA = "timestamps array<string>, equity array<string>, benchmark array<string>"


def record_runs(runs: DataFrame, path: str) -> None:
    """Append runs, partitioned by kind. ``runs`` has the ledger columns."""
    runs.select(
        "timestamp", "seq", "slug", "git_commit", "params", "headline", "payload", "kind"
    ).write.mode("append").partitionBy("kind").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All lines, oldest first."""
    return spark.read.schema(LEDGER_SCHEMA).json(path).orderBy("timestamp", "seq")


def latest_runs(ledger: DataFrame) -> DataFrame:
    """The last recorded run of every kind and slug."""
    order = F.struct("timestamp", "seq")
    rest = [c for c in ledger.columns if c not in ("kind", "slug")]
    return ledger.groupBy("kind", "slug").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("kind", "slug", "_r.*")


def latest_run(ledger: DataFrame, slug: str, kind: str) -> DataFrame:
    found = latest_runs(ledger.where((F.col("kind") == kind) & (F.col("slug") == slug)))
    if found.isEmpty():
        raise ValueError(f"no ledger entry of kind {kind!r} for slug {slug!r}")
    return found


def slugs_of_kind(ledger: DataFrame, kind: str, *, prefix: str = "") -> DataFrame:
    """Distinct slugs of a kind, in the order first seen: by the time, then the ``first_seq``, of their first run."""
    rows = ledger.where((F.col("kind") == kind) & F.col("slug").startswith(prefix))
    firsts = rows.groupBy("slug").agg(F.min(F.struct("timestamp", "seq")).alias("_f"))
    return firsts.select(
        "slug", F.col("_f.timestamp").alias("first_seen"), F.col("_f.seq").alias("first_seq")
    ).orderBy("first_seen", "first_seq")


def series_json(equity: DataFrame) -> DataFrame:
    """One JSON text per run: times, equity and benchmark in cents (half to even), missing levels kept.

    One row per calendar date goes into each text.
    """
    if "level" not in equity.columns:
        equity = equity.withColumn("level", F.lit(None).cast("double"))

    def cents(c: str) -> F.Column:
        return F.bround(c, 2).cast("decimal(38,2)").cast("string")

    point = F.struct(
        F.col("ts").cast("timestamp").alias("t"), cents("equity").alias("e"), cents("level").alias("b"),
    )
    rows = equity.groupBy("run_id").agg(F.array_sort(F.collect_list(point)).alias("p"), F.count("level").alias("_k"))
    stamps = F.transform("p", lambda s: F.date_format(s["t"], "yyyy-MM-dd'T'HH:mm:ssXXX"))
    levels = F.when(F.col("_k") > 0, F.transform("p", lambda s: s["b"]))
    return rows.select(
        "run_id",
        F.to_json(
            F.struct(stamps.alias("timestamps"), F.transform("p", lambda s: s["e"]).alias("equity"), levels.alias("benchmark")),
            {"ignoreNullFields": "false"},
        ).alias("series"),
    )


def series_rows(texts: DataFrame) -> DataFrame:
    """Back to ``(run_id, ts, equity, level)``. Text that is not a series, or is out of step, raises."""
    s = F.from_json("series", SERIES_SCHEMA, {"mode": "FAILFAST"})
    parsed = texts.select("run_id", s.alias("s"))
    n = F.size("s.timestamps")
    fits = (F.size("s.equity") == n) & (F.col("s.benchmark").isNull() | (F.size("s.benchmark") == n))
    ok = F.col("s.timestamps").isNotNull() & F.col("s.equity").isNotNull() & fits
    checked = parsed.select(
        "run_id", F.when(ok, F.col("s")).otherwise(F.raise_error(F.lit("series arrays missing or out of step"))).alias("s")
    )
    zipped = F.arrays_zip(
        F.col("s.timestamps").alias("t"), F.col("s.equity").alias("e"),
        F.coalesce("s.benchmark", F.transform("s.timestamps", lambda _: F.lit(None).cast("string"))).alias("b"),
    )
    return checked.select("run_id", F.explode(zipped).alias("p")).select(
        "run_id", F.to_timestamp("p.t").alias("ts"), F.col("p.e").cast("double").alias("equity"),
        F.col("p.b").cast("double").alias("level"),
    )
