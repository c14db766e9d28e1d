"""Loaders and writers over real files: the given tables are written to the shared folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.operators.models import score_partition
from pitlane.operators.weights import valued_weights
from pitlane.plans.fixtures import Tables, with_ctes
from pitlane.plans.queries_sources import r6, rounded
from pitlane.plans.registry import query
from pitlane.session import shared_folder
from pitlane.sources.ledger import latest_runs, read_ledger, record_runs
from pitlane.sources.tables import csv_to_parquet, file_manifest, load_membership, load_scores, write_both, write_scores


def _folder(t: Tables) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(t.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("membership_file", "A5", with_ctes("members", body="SELECT ticker, start_date, end_date FROM members"))
def membership_file(t: Tables) -> DataFrame:
    folder = _folder(t)
    t.members.select("ticker", "start_date", "end_date").write.csv(folder, header=True)
    return load_membership(t.spark, folder)


@query(
    "score_file", "A6 A16",
    with_ctes("scores", "members", body=f"SELECT date, ticker, {r6('score')} AS score FROM scores WHERE ticker IN (SELECT ticker FROM members WHERE start_date < DATE '1997-01-01')"),
)
def score_file(t: Tables) -> DataFrame:
    folder = _folder(t)
    write_scores(t.scores, folder)
    return rounded(load_scores(t.spark, folder, t.members.where("start_date < DATE '1997-01-01'")).select("date", "ticker", "score"), "score")


@query(
    "score_partitions", "A29 A16",
    with_ctes("scores", body=f"""SELECT 'ridge' AS model, 'cap' AS target, date, ticker, {r6('score')} AS score FROM scores
 UNION ALL SELECT 'gbt', 'mb', date, ticker, {r6('-score')} FROM scores"""),
)
def score_partitions(t: Tables) -> DataFrame:
    folder = _folder(t)
    write_scores(t.scores, folder, mode="append", partition=score_partition("ridge", "cap"))
    negative = t.scores.withColumn("score", -F.col("score"))
    write_scores(negative, folder, mode="append", partition=score_partition("gbt", "mb"))
    return rounded(t.spark.read.parquet(folder).select("model", "target", "date", "ticker", "score"), "score")


@query(
    "table_mirrors", "A17",
    with_ctes("sectors", body="""SELECT 'parquet' AS form, ticker, sector FROM sectors UNION ALL SELECT 'csv', ticker, sector FROM sectors"""),
)
def table_mirrors(t: Tables) -> DataFrame:
    stem = f"{_folder(t)}/table"
    write_both(t.sectors.select("ticker", "sector"), stem, sort_by=("table", "ticker"))
    forms = {"parquet": t.spark.read.parquet(f"{stem}.parquet"),
             "csv": t.spark.read.csv(f"{stem}.csv", header=True, schema="ticker string, sector string")}
    both = [df.select(F.lit(k).alias("form"), "ticker", "sector") for k, df in forms.items()]
    return both[0].unionByName(both[1])



@query(
    "export_converted", "A18 A19",
    with_ctes("bars", body="""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT ticker) AS n_tickers, MIN(date) AS date_min, MAX(date) AS date_max,
 COUNT(*) AS n_read, CAST(ROUND(SUM(close)) AS DOUBLE) AS close_sum FROM bars"""),
)
def export_converted(t: Tables) -> DataFrame:
    """The conversion's own figures beside those of the table it wrote."""
    source, target = _folder(t), _folder(t)
    t.bars.select("ticker", "date", "close", "volume").write.csv(source, header=True)
    stats = csv_to_parquet(t.spark, source, target, "sep")
    read = t.spark.read.parquet(target).agg(
        F.count("*").alias("n_read"), F.round(F.sum(F.col("close").cast("double"))).alias("close_sum"))
    return stats.join(read, stats["n_rows"] == read["n_read"])


@query(
    "manifest_of_files", "A20",
    with_ctes("sectors", body="""SELECT sector, SHA256(STRING_AGG(ticker || CHR(10), '' ORDER BY ticker)) AS sha256,
 CAST(SUM(LENGTH(ticker) + 1) AS BIGINT) AS bytes FROM sectors WHERE sector IS NOT NULL GROUP BY sector"""),
)
def manifest_of_files(t: Tables) -> DataFrame:
    """A text file of tickers for every sector; size and digest of each."""
    folder = _folder(t)
    rows = t.sectors.where("sector IS NOT NULL").select("sector", "ticker")
    rows.repartition("sector").sortWithinPartitions("sector", "ticker").write.partitionBy("sector").text(folder)
    names = t.spark.read.text(folder).select("sector", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name")).distinct()
    found = file_manifest(t.spark, folder, full_path=True)
    sector = F.element_at(F.split("path", "/"), -2)
    coded = names.select("sector", "name")
    return found.withColumn("dir", sector).join(coded, "name").where(
        F.url_decode(F.substring_index("dir", "=", -1)) == F.col("sector")).select("sector", "sha256", "bytes")


@query(
    "ledger_file", "A24 A25 A26",
    """SELECT o_orderstatus AS kind, o_orderpriority AS slug, o_orderkey AS seq, CAST(o_totalprice AS VARCHAR) AS payload FROM (
 SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
 FROM orders o) z WHERE rn = 1""",
)
def ledger_file(t: Tables) -> DataFrame:
    """Runs appended in two batches, read back, the last of every kind and slug."""
    folder = _folder(t)
    runs = t.raw("orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderkey").cast("long").alias("seq"),
        F.col("o_orderpriority").alias("slug"), F.lit("c").alias("git_commit"),
        F.create_map(F.lit("p"), F.lit("1")).alias("params"), F.create_map(F.lit("h"), F.lit(1.0)).alias("headline"),
        F.col("o_totalprice").cast("string").alias("payload"), F.col("o_orderstatus").alias("kind"))
    for part in (0, 1):
        record_runs(runs.where(F.col("seq") % 2 == part), folder)
    return latest_runs(read_ledger(t.spark, folder)).select("kind", "slug", "seq", "payload")


_BOOK = """h AS (SELECT ticker, month AS date, close, CAST(10 + LENGTH(ticker) * 3 AS DOUBLE) AS qty FROM monthly WHERE close > 0)"""


@query(
    "current_weights", "E20",
    with_ctes("monthly", body=f"""WITH {_BOOK} SELECT ticker, date, {r6('qty * close / SUM(qty * close) OVER (PARTITION BY date)')} AS weight FROM h"""),
)
def current_weights(t: Tables) -> DataFrame:
    held = t.monthly.where("close > 0").select(
        F.lit("B").alias("run_id"), F.col("month").alias("date"), "ticker", "close",
        (10.0 + F.length("ticker") * 3).alias("qty"))
    return rounded(valued_weights(held).select("ticker", "date", "weight"), "weight")
