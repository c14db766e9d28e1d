"""Shuffles begin with partitions in proportion to the input."""

import __spark_entry__ as entry
from pitlane import session
from pitlane.plans.fixtures import Tables


def test_partitions_follow_the_input(spark):
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.spread(spark, 1000)
    assert session.parts(spark) == at_least
    session.spread(spark, 100 * session.ROWS_PER_PART)
    assert session.parts(spark) == 100
    session.spread(spark, 1)


def test_queries_spread_by_their_tables(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    rows = Tables(spark, folder).rows()
    assert rows >= spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(session, "ROWS_PER_PART", rows // 20)
    lines = entry.queries()["position_profit"](spark, folder)
    assert session.parts(spark) >= 20
    assert lines.count() == Tables(spark, folder).bars.count()
    session.spread(spark, 1)
