import __spark_entry__ as entry
from pitlane.plans.registry import ENTRIES


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 110
    assert all(e.ids for e in ENTRIES.values())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "n_names", "rank_ic", "decile_spread"] and df.count() > 0
