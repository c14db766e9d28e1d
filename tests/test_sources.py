import hashlib
import math

import pytest

from pitlane.operators.models import score_partition
from pitlane.plans.fixtures import Tables
from pitlane.plans.queries_sources import ledger_slugs
from pitlane.sources.fundamentals import load_filings, select_filings
from pitlane.sources.ledger import (
    latest_run, latest_runs, read_ledger, record_runs, series_json, series_rows, slugs_of_kind,
)
from pitlane.sources.prices import load_bars, load_market_caps, load_series
from pitlane.sources.tables import (
    append_manifest, benchmark_faults, clean_tickers, csv_to_parquet, file_manifest, load_benchmark, load_membership,
    load_scores, write_both, write_scores,
)
from tests.helpers import day, frame, tuples

PRICE = ("ticker string, date timestamp, open double, high double, low double, close double, closeadj double, "
         "closeunadj double, volume double")


@pytest.fixture
def prices(spark, tmp_path):
    import datetime as dt

    rows = [
        ("AAA", dt.datetime(2010, 1, 4), 99.0, 101.0, 98.0, 100.0, 50.0, 200.0, 10.0),
        ("AAA", dt.datetime(2010, 1, 5), 109.0, 111.0, 108.0, 110.0, 66.0, 220.0, 10.0),
        ("BBB", dt.datetime(2010, 1, 4), 1.0, 1.0, 1.0, 0.0, 7.0, 8.0, 1.0),
    ]
    path = str(tmp_path / "prices")
    frame(spark, rows, PRICE).write.parquet(path)
    return path


def test_price_bases(spark, prices):
    bars = load_bars(spark, prices, ["AAA", "BBB"], "2010-01-01", "2010-01-31").orderBy("ticker", "date").collect()
    assert [r["open"] for r in bars] == [pytest.approx(49.5), pytest.approx(65.4), 7.0]
    assert [r["close"] for r in bars] == [50.0, 66.0, 7.0]
    raw = load_bars(spark, prices, ["AAA"], "2010-01-05", "2010-01-05", price="closeunadj").first()
    assert raw["close"] == 220.0 and raw["high"] == pytest.approx(222.0)
    wanted = frame(spark, [("BBB",)], "ticker string")
    assert load_bars(spark, prices, wanted, "2010-01-01", "2010-01-31").count() == 1
    for bad in (lambda: load_bars(spark, prices, [], "2010-01-01", "2010-01-31"),
                lambda: load_bars(spark, prices, ["AAA"], "2011-01-01", "2011-01-31"),
                lambda: load_bars(spark, prices, ["AAA"], "2010-01-01", "2010-01-31", price="open")):
        with pytest.raises(ValueError):
            bad()


def test_scan_is_pruned_and_pushed_down(spark, prices):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = load_bars(spark, prices, ["AAA"], "2010-01-01", "2010-01-31", check=False).select("ticker", "close")
    text = plan._jdf.queryExecution().executedPlan().toString()
    pushed = text.split("PushedFilters")[1]
    assert "EqualTo(ticker,AAA)" in pushed or "In(ticker, [AAA])" in pushed, text
    assert "GreaterThanOrEqual(date" in pushed and "LessThanOrEqual(date" in pushed
    assert "volume" not in text.split("ReadSchema")[1]


def test_filings(spark, tmp_path):
    path = str(tmp_path / "filings")
    rows = [("AAA", "ART", day("2020-02-15"), 100.0, math.nan), ("AAA", "MRT", day("2020-02-15"), 1.0, 1.0),
            ("AAA", "ARQ", day("2020-05-15"), None, None)]
    frame(spark, rows, "ticker string, dimension string, datekey date, revenue double, netinc double").write.parquet(path)
    got = load_filings(spark, path).collect()
    assert len(got) == 1 and got[0]["netinc"] is None and got[0].asDict().keys() == {"ticker", "dimension", "datekey", "revenue", "netinc"}
    with pytest.raises(ValueError):
        select_filings(spark.read.parquet(path), fields=("nothing",))
    with pytest.raises(ValueError):
        load_filings(spark, path, symbols=["ZZZ"])


def test_series_drop_missing(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = [("A", day("2020-01-01"), 5.0), ("A", day("2020-01-02"), math.nan), ("B", day("2020-01-01"), None)]
    frame(spark, rows, "ticker string, date date, marketcap double").write.parquet(path)
    assert load_market_caps(spark, path).count() == 1 and load_series(spark, path, "marketcap", ["B"]).count() == 0


def test_membership_csv(spark, tmp_path):
    path = tmp_path / "members.csv"
    path.write_text("ticker,start_date,end_date\nAAA,2005-01-01,\nBBB,2008-01-01,2012-01-01\nBBB,2015-01-01,\n")
    got = load_membership(spark, str(path))
    assert got.where("end_date IS NULL").count() == 2 and got.count() == 3
    (tmp_path / "none.csv").write_text("ticker,start_date,end_date\n")
    with pytest.raises(ValueError):
        load_membership(spark, str(tmp_path / "none.csv"))


def test_benchmark_csv(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("Date,Close\n2020-01-02,10\n2020-01-03,\n2020-01-02,11.5\n2020-01-01,9\n")
    assert tuples(load_benchmark(spark, str(path))) == [(day("2020-01-01"), 9.0), (day("2020-01-02"), 11.5)]
    with pytest.raises(ValueError):
        load_benchmark(spark, str(path), level_column="Level")
    path.write_text("Date,Close\n2020-01-02,-1\n")
    with pytest.raises(ValueError):
        load_benchmark(spark, str(path))
    twice = frame(spark, [(day("2020-01-01"), 1.0), (day("2020-01-01"), 2.0)], "date date, level double")
    assert not benchmark_faults(twice).first()["valid"]


def test_scores_round_trip(spark, tmp_path):
    path = str(tmp_path / "scores")
    df = frame(spark, [(day("2020-01-31"), "A", 0.5), (day("2020-01-31"), "B", 0.1)], "date date, ticker string, score double")
    write_scores(df, path, partition=score_partition("ridge", "cap"))
    assert spark.read.parquet(path).where("model = 'ridge' AND target = 'cap'").count() == 2
    assert tuples(load_scores(spark, path, ["A"])) == [(day("2020-01-31"), "A", 0.5)]


def test_export_conversion(spark, tmp_path):
    csv, out = tmp_path / "sep.csv", str(tmp_path / "sep")
    csv.write_text("ticker,date,close,volume\nNA,2020-01-02,10,\nBB,2020-01-03,11.5,3\n")
    stats = csv_to_parquet(spark, str(csv), out, "sep").first()
    assert (stats["n_rows"], stats["n_tickers"], stats["date_min"], stats["date_max"]) == (2, 2, day("2020-01-02"), day("2020-01-03"))
    assert dict(spark.read.parquet(out).dtypes) == {"ticker": "string", "date": "date", "close": "double", "volume": "double"}
    csv.write_text("ticker,date,close,volume\n")
    with pytest.raises(ValueError):
        csv_to_parquet(spark, str(csv), out, "sep")


def test_write_both_and_manifest(spark, tmp_path):
    df = frame(spark, [("B", 2), ("A", 1)], "ticker string, n int")
    stem = str(tmp_path / "table")
    write_both(df, stem, sort_by=["nope", "ticker"])
    assert spark.read.parquet(stem + ".parquet").count() == 2
    assert [r["ticker"] for r in spark.read.csv(stem + ".csv", header=True).collect()] == ["A", "B"]
    files = tmp_path / "files"
    files.mkdir()
    (files / "x.bin").write_bytes(b"hello")
    row = file_manifest(spark, str(files)).first()
    assert (row["name"], row["bytes"], row["sha256"]) == ("x.bin", 5, hashlib.sha256(b"hello").hexdigest())
    for _ in range(2):
        append_manifest(file_manifest(spark, str(files)), str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 2


def test_ticker_dates(spark):
    df = frame(spark, [("SF1", "A", "2020-01-02", "n/a")], "table string, ticker string, firstpricedate string, lastpricedate string")
    row = clean_tickers(df).first()
    assert row["firstpricedate"] == day("2020-01-02") and row["lastpricedate"] is None


def test_ledger(spark, tmp_path):
    import datetime as dt

    path = str(tmp_path / "ledger")
    schema = ("timestamp timestamp, seq long, slug string, git_commit string, params map<string,string>, "
              "headline map<string,double>, payload string, kind string")

    def run(sec, slug, kind="single_run"):
        return (dt.datetime(2026, 1, 1, 0, 0, sec), sec, slug, "abc", {"start": "2020-01-01"}, {"sharpe": 0.5}, f"p{sec}", kind)

    record_runs(frame(spark, [run(1, "b"), run(2, "a")], schema), path)
    record_runs(frame(spark, [run(3, "b"), run(4, "z", "windows")], schema), path)
    ledger = read_ledger(spark, path)
    assert [r["seq"] for r in ledger.collect()] == [1, 2, 3, 4]
    assert {(r["kind"], r["slug"]): r["payload"] for r in latest_runs(ledger).collect()} == {
        ("single_run", "b"): "p3", ("single_run", "a"): "p2", ("windows", "z"): "p4"}
    assert [r["slug"] for r in slugs_of_kind(ledger, "single_run").collect()] == ["b", "a"]
    assert latest_run(ledger, "b", "single_run").first()["params"] == {"start": "2020-01-01"}
    with pytest.raises(ValueError):
        latest_run(ledger, "q", "single_run")


def test_slugs_first_seen_at_one_time_go_by_sequence(spark, tmp_path):
    """Orders of one day: the order that came first decides, not the name."""
    orders = [(1, "2-HIGH", "F", day("1995-01-01"), 1.0), (7, "1-URGENT", "F", day("1995-01-01"), 1.0),
              (3, "5-LOW", "F", day("1995-01-01"), 1.0), (9, "4-MEDIUM", "F", day("1994-12-31"), 1.0)]
    frame(spark, orders, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_orderdate date, "
          "o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["slug"]: r["pos"] for r in ledger_slugs(Tables(spark, str(tmp_path))).collect()}
    assert got == {"4-MEDIUM": 1, "2-HIGH": 2, "5-LOW": 3, "1-URGENT": 4}


def test_series_json(spark):
    rows = [("r", day("2020-01-01"), 100.005, None), ("r", day("2020-01-02"), 101.0, 50.0), ("s", day("2020-01-01"), 1.0, None)]
    texts = series_json(frame(spark, rows, "run_id string, ts date, equity double, level double"))
    by = {r["run_id"]: r["series"] for r in texts.collect()}
    assert '"benchmark":null' in by["s"] and '"benchmark":[null,"50.00"]' in by["r"]
    back = series_rows(texts).orderBy("run_id", "ts").collect()
    assert [(r["equity"], r["level"]) for r in back] == [(100.0, None), (101.0, 50.0), (1.0, None)]
    for bad in ('{"timestamps": ["2020-01-01"], "equity": ["1", "2"], "benchmark": null}', '{"equity": ["1"]}'):
        with pytest.raises(Exception):
            series_rows(frame(spark, [("r", bad)], "run_id string, series string")).collect()


def test_bars_do_not_fill_memory_before_the_shuffle(spark, tmp_path):
    """Lines go to their bars as they are read; only the bars of one part are held."""
    import datetime as dt

    frame(spark, [(1, 1, 7, dt.date(1996, 1, 2), 2.0, 10.0, 0.0, 0.0, "A", "F"), (2, 2, 7, dt.date(1996, 1, 2), 3.0, 30.0, 0.0, 0.0, "A", "F"),
                  (3, 1, 7, dt.date(1996, 1, 3), 1.0, 4.0, 0.0, 0.0, "A", "F")],
          "l_orderkey long, l_linenumber long, l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, "
          "l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    bars = Tables(spark, str(tmp_path)).bars
    assert tuples(bars.select("date", "low", "high", "close", "n_rows")) == [
        (day("1996-01-02"), 5.0, 10.0, 8.0, 2), (day("1996-01-03"), 4.0, 4.0, 4.0, 1)]
    plan = bars._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange" in plan and "Aggregate" not in plan[plan.index("Exchange"):]
