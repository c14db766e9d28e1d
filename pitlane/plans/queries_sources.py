"""Scans, clean-up, membership and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.functions.scalar import commission, mid_price, parse_day, round_half_up, slipped
from pitlane.operators.asof import series
from pitlane.operators.dedupe import last_wins_filings, last_wins_scores
from pitlane.operators.signals import score_panel
from pitlane.operators.universe import (
    active_since, basket_at, broad_universe, covered_by_prices, ever_members, index_changes, keep_members,
    members_on, membership_spells, membership_summary, missing_metadata, reconcile, sector_codes, sector_names,
    select_tickers, universe_tickers,
)
from pitlane.plans.fixtures import CTES, Tables, with_ctes
from pitlane.plans.registry import query
from pitlane.sources.fundamentals import DEFAULT_FIELDS, first_known, known_fields, narrow, select_filings
from pitlane.sources.ledger import latest_runs, slugs_of_kind
from pitlane.sources.prices import select_bars, timeline, trading_calendar, visible_bars
from pitlane.sources.tables import benchmark_faults, clean_benchmark, clean_tickers, conversion_stats, ticker_counts


def r6(x: str) -> str:
    return f"FLOOR(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[round_half_up(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query(
    "bars_total_return", "A1 A2 B12 M1 M3",
    with_ctes(
        "bars", "sectors",
        body=f"""SELECT ticker, date, {r6('open * (closeadj / close)')} AS open, {r6('high * (closeadj / close)')} AS high,
 {r6('low * (closeadj / close)')} AS low, {r6('closeadj')} AS close, volume, '1Day' AS timeframe
 FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND ticker IN (SELECT ticker FROM sectors)""",
    ),
)
def bars_total_return(t: Tables) -> DataFrame:
    bars = select_bars(t.bars, t.sectors, "1996-01-01", "1999-12-31", price="closeadj")
    return rounded(bars, "open", "high", "low", "close")


@query(
    "bars_unadjusted", "A1 A2",
    with_ctes(
        "bars",
        body=f"""SELECT ticker, date, {r6('open * (closeunadj / close)')} AS open, {r6('high * (closeunadj / close)')} AS high,
 {r6('low * (closeunadj / close)')} AS low, {r6('closeunadj')} AS close, volume, '1Day' AS timeframe
 FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""",
    ),
)
def bars_unadjusted(t: Tables) -> DataFrame:
    bars = select_bars(t.bars, None, "1995-01-01", "2001-12-31", price="closeunadj")
    return rounded(bars, "open", "high", "low", "close")


@query(
    "filings_selected", "A3 A4 B10 M4",
    with_ctes(
        "filings",
        body="SELECT ticker, dimension, datekey, " + ", ".join(f"{r6(c)} AS {c}" for c in DEFAULT_FIELDS)
        + " FROM filings WHERE dimension IN ('ARQ', 'ART')",
    ),
)
def filings_selected(t: Tables) -> DataFrame:
    return rounded(select_filings(t.filings, dimensions=("ARQ", "ART")), *DEFAULT_FIELDS)


@query(
    "filings_thin_dropped", "A3",
    with_ctes(
        "filings",
        body=f"""SELECT ticker, dimension, datekey, {r6('netinc')} AS netinc, {r6('roe')} AS roe FROM filings
 WHERE COALESCE(netinc, roe) IS NOT NULL""",
    ),
)
def filings_thin_dropped(t: Tables) -> DataFrame:
    rows = select_filings(t.filings, fields=("netinc", "roe", "not_a_field"))
    return rounded(rows, "netinc", "roe")


@query(
    "filings_narrow", "M4 G5",
    with_ctes(
        "filings",
        body=f"""SELECT ticker, dimension, datekey, field, {r6('value')} AS value FROM (
 SELECT ticker, dimension, datekey, 'netinc' AS field, netinc AS value FROM filings
 UNION ALL SELECT ticker, dimension, datekey, 'revenue', revenue FROM filings) z WHERE value IS NOT NULL""",
    ),
)
def filings_narrow(t: Tables) -> DataFrame:
    return rounded(narrow(t.filings, ("netinc", "revenue")), "value")


@query(
    "filings_known_fields", "G5",
    with_ctes(
        "filings",
        body="""SELECT 'netinc' AS field, COUNT(netinc) AS n FROM filings UNION ALL SELECT 'roe', COUNT(roe) FROM filings
 UNION ALL SELECT 'de', COUNT(de) FROM filings""",
    ),
)
def filings_known_fields(t: Tables) -> DataFrame:
    return known_fields(t.filings, ("netinc", "roe", "de"))


@query(
    "series_known_values", "A7 A8 M7 M8",
    with_ctes(
        "filings",
        body=f"SELECT ticker, datekey AS date, {r6('netinc')} AS value FROM filings WHERE dimension = 'ART' AND netinc IS NOT NULL",
    ),
)
def series_known_values(t: Tables) -> DataFrame:
    rows = t.filings.where("dimension = 'ART'").select("ticker", F.col("datekey").alias("date"), F.col("netinc").alias("value"))
    return rounded(series(rows, "value"), "value")


@query(
    "benchmark_last_wins", "A9 M10",
    """SELECT date, level FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS level,
 ROW_NUMBER() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn
 FROM orders WHERE o_orderpriority <> '5-LOW') z WHERE rn = 1""",
)
def benchmark_last_wins(t: Tables) -> DataFrame:
    lines = t.raw("orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("level"), "o_orderkey",
    )
    return clean_benchmark(lines, ["o_orderkey"]).select("date", "level")


@query(
    "benchmark_checks", "A10",
    with_ctes(
        "benchmark_levels",
        body=f"""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT date) AS n_dates, {r6('MIN(level)')} AS lowest,
 COUNT(*) > 0 AND COUNT(*) = COUNT(DISTINCT date) AND MIN(level) > 0 AS valid FROM benchmark_levels""",
    ),
)
def benchmark_checks(t: Tables) -> DataFrame:
    return rounded(benchmark_faults(t.benchmark_levels), "lowest")


@query(
    "trading_days", "A11 B12",
    with_ctes("bars", body="SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"),
)
def trading_days(t: Tables) -> DataFrame:
    return trading_calendar(t.bars, "1996-01-01", "2000-12-31")


@query("bar_timeline", "A12 M20", with_ctes("bars", body="SELECT DISTINCT date FROM bars ORDER BY date"))
def bar_timeline(t: Tables) -> DataFrame:
    return timeline(t.bars)


@query(
    "broad_universe", "A13 M18",
    with_ctes(
        "tickers",
        body="""SELECT ticker, firstpricedate AS start_date, lastpricedate AS end_date FROM tickers
 WHERE "table" = 'SF1' AND category LIKE 'Domestic Common Stock%' AND firstpricedate IS NOT NULL""",
    ),
)
def broad_universe_query(t: Tables) -> DataFrame:
    return broad_universe(t.tickers)


@query(
    "sector_codes", "A14",
    with_ctes(
        "tickers",
        body="""SELECT ticker, sector, CAST(DENSE_RANK() OVER (ORDER BY sector) - 1 AS INTEGER) AS industry FROM tickers
 WHERE "table" = 'SF1' AND category LIKE 'Domestic Common Stock%' AND sector IS NOT NULL""",
    ),
)
def sector_codes_query(t: Tables) -> DataFrame:
    return sector_codes(t.tickers)


@query(
    "sector_names", "A15",
    with_ctes("tickers", body="SELECT ticker, sector FROM tickers WHERE \"table\" = 'SF1' AND sector IS NOT NULL"),
)
def sector_names_query(t: Tables) -> DataFrame:
    return sector_names(t.tickers)


@query(
    "ticker_metadata_clean", "A21 F4",
    with_ctes("tickers", body='SELECT ticker, "table", category, sector, firstpricedate, lastpricedate FROM tickers ORDER BY "table", ticker'),
)
def ticker_metadata_clean(t: Tables) -> DataFrame:
    return clean_tickers(t.tickers)


@query(
    "ticker_counts", "A21",
    with_ctes(
        "tickers",
        body='SELECT "table", category, COUNT(*) AS n_rows, COUNT(DISTINCT ticker) AS n_tickers FROM tickers GROUP BY ALL',
    ),
)
def ticker_counts_query(t: Tables) -> DataFrame:
    return ticker_counts(t.tickers)


@query("universe_tickers", "A22", with_ctes("members", body="SELECT DISTINCT ticker FROM members ORDER BY ticker"))
def universe_tickers_query(t: Tables) -> DataFrame:
    return universe_tickers(t.members)


@query(
    "ticker_selection", "A23",
    with_ctes(
        "sectors",
        body="""SELECT ticker FROM (SELECT s, i, UPPER(TRIM(LIST_EXTRACT(STRING_SPLIT(s, ','), i))) AS ticker
 FROM (SELECT s, UNNEST(RANGE(1, LEN(STRING_SPLIT(s, ',')) + 1)) AS i
 FROM (SELECT LOWER(CONCAT(' ', ticker, ' ,, ', sector, ',')) AS s FROM sectors) q) z) y
 WHERE ticker <> '' ORDER BY s, i LIMIT 40""",
    ),
)
def ticker_selection(t: Tables) -> DataFrame:
    texts = t.sectors.select(F.lower(F.concat(F.lit(" "), "ticker", F.lit(" ,, "), "sector", F.lit(","))).alias("text"))
    return select_tickers(texts, "text", limit=40)


@query(
    "conversion_stats", "A19",
    with_ctes(
        "filings",
        body="""SELECT COUNT(*) AS n_rows, COUNT(DISTINCT ticker) AS n_tickers, MIN(datekey) AS date_min, MAX(datekey) AS date_max
 FROM filings""",
    ),
)
def conversion_stats_query(t: Tables) -> DataFrame:
    return conversion_stats(t.filings, "datekey")


@query(
    "score_panel", "A30 B12",
    with_ctes("scores", body=f"SELECT date, ticker, {r6('score')} AS score FROM scores WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'"),
)
def score_panel_query(t: Tables) -> DataFrame:
    return rounded(score_panel(t.scores, "1997-01-01", "2000-12-31"), "score")


@query(
    "filings_last_wins", "B2",
    with_ctes(
        "filings_raw",
        body=f"""SELECT ticker, dimension, datekey, status, lastupdated, {r6('revenue')} AS revenue, {r6('netinc')} AS netinc FROM (
 SELECT r.*, ROW_NUMBER() OVER (PARTITION BY ticker, dimension, datekey ORDER BY lastupdated DESC, status DESC) AS rn
 FROM filings_raw r) z WHERE rn = 1""",
    ),
)
def filings_last_wins(t: Tables) -> DataFrame:
    return rounded(last_wins_filings(t.filings_raw, ["lastupdated", "status"]), "revenue", "netinc")


@query(
    "scores_last_wins", "B3 M6",
    """SELECT ticker, date, score FROM (SELECT CONCAT('S', CAST(l_suppkey AS VARCHAR)) AS ticker, CAST(l_shipdate AS DATE) AS date,
 l_discount AS score, ROW_NUMBER() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
 ORDER BY l_orderkey DESC, l_linenumber DESC, l_discount DESC) AS rn FROM lineitem) z WHERE rn = 1""",
)
def scores_last_wins(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").selectExpr(
        "CONCAT('S', CAST(l_suppkey AS STRING)) AS ticker", "CAST(l_shipdate AS DATE) AS date", "l_discount AS score",
        "l_orderkey", "l_linenumber",
    )
    return last_wins_scores(rows, ["l_orderkey", "l_linenumber", "score"]).select("ticker", "date", "score")


@query(
    "visible_bars", "B1",
    with_ctes(
        "bars", "members",
        body=f"""SELECT b.ticker, b.date, {r6('b.close')} AS close FROM bars b JOIN (
 SELECT ticker, MIN(start_date) AS s, DATE '2000-12-31' AS e, CAST(MIN(start_date) + INTERVAL '500' DAY AS DATE) AS a FROM members GROUP BY ticker) r
 ON b.ticker = r.ticker AND b.date >= r.s AND b.date <= LEAST(r.e, r.a)""",
    ),
)
def visible_bars_query(t: Tables) -> DataFrame:
    asked = t.members.groupBy("ticker").agg(F.min("start_date").alias("start")).select(
        "ticker", "start", F.lit("2000-12-31").cast("date").alias("end"), F.date_add("start", 500).alias("as_of")
    )
    return rounded(visible_bars(t.bars, asked).select("ticker", "date", "close"), "close")


SPELL_IDS = "E14 B15 M5 M19"


@query("event_spells", SPELL_IDS, "WITH actions AS (" + CTES["actions"][1].replace("AS STRING", "AS VARCHAR") + ") SELECT ticker, start_date, end_date FROM "
       + CTES["members"][1].split("FROM ", 1)[1].replace("index_actions", "actions"))
def event_spells(t: Tables) -> DataFrame:
    return membership_spells(t.actions).select("ticker", "start_date", "end_date")


@query("index_spells", SPELL_IDS, with_ctes("members", body="SELECT ticker, start_date, end_date FROM members"))
def index_spells(t: Tables) -> DataFrame:
    return t.members


# Removals only: no ticker has an add, so every spell is anchored at the first removal of all.
@query(
    "anchored_spells", "E14",
    with_ctes(
        "actions",
        body="""SELECT a.ticker, i.d AS start_date, CAST(a.date - INTERVAL '1' DAY AS DATE) AS end_date, TRUE AS anchored
 FROM actions a, (SELECT MIN(date) AS d FROM actions WHERE action = 'removed') i
 WHERE a.action = 'removed' AND CAST(a.date - INTERVAL '1' DAY AS DATE) >= i.d""",
    ),
)
def anchored_spells(t: Tables) -> DataFrame:
    return membership_spells(t.actions.where("action = 'removed'"))


@query(
    "action_filter", "B15",
    with_ctes("actions", body="SELECT ticker, date, action FROM actions WHERE action <> 'current'"),
)
def action_filter(t: Tables) -> DataFrame:
    return index_changes(t.actions).select("ticker", "date", "action")


_EVENT_SPELLS = "spells AS (SELECT * FROM " + CTES["members"][1].split("FROM ", 1)[1].replace("index_actions", "actions") + ")"


@query(
    "membership_reconcile", "C10 G3",
    with_ctes(
        "actions",
        body=f"""WITH {_EVENT_SPELLS}, o AS (SELECT DISTINCT ticker FROM spells WHERE end_date IS NULL),
 c AS (SELECT DISTINCT ticker FROM actions WHERE action = 'current')
 SELECT ticker, 'only_open' AS side FROM (SELECT ticker FROM o EXCEPT SELECT ticker FROM c) a
 UNION ALL SELECT ticker, 'only_current' FROM (SELECT ticker FROM c EXCEPT SELECT ticker FROM o) b""",
    ),
)
def membership_reconcile(t: Tables) -> DataFrame:
    return reconcile(membership_spells(t.actions), t.actions)


@query(
    "metadata_missing", "C10",
    with_ctes(
        "members", "sectors",
        body="SELECT DISTINCT ticker FROM members WHERE ticker NOT IN (SELECT ticker FROM sectors)",
    ),
)
def metadata_missing(t: Tables) -> DataFrame:
    return missing_metadata(t.members, t.sectors)


@query(
    "members_active_since", "B4",
    with_ctes("members", body="SELECT ticker, start_date, end_date FROM members WHERE end_date IS NULL OR end_date >= DATE '1998-01-01'"),
)
def members_active_since(t: Tables) -> DataFrame:
    return active_since(t.members)


@query(
    "members_priced", "B5",
    with_ctes(
        "members", "bars",
        body="""SELECT ticker, start_date, end_date FROM members
 WHERE ticker IN (SELECT ticker FROM bars WHERE date >= DATE '2001-10-25')""",
    ),
)
def members_priced(t: Tables) -> DataFrame:
    return covered_by_prices(t.members, t.bars.where(F.col("date") >= F.lit("2001-10-25").cast("date")))


@query(
    "membership_summary", "D43 B4 B5",
    with_ctes(
        "members",
        body="""SELECT COUNT(DISTINCT CASE WHEN k THEN ticker END) AS n_tickers, CAST(COUNT_IF(k) AS BIGINT) AS n_spells,
 COUNT(DISTINCT ticker) - COUNT(DISTINCT CASE WHEN k THEN ticker END) AS n_dropped
 FROM (SELECT ticker, (end_date IS NULL OR end_date >= DATE '1998-01-01') AS k FROM members) z""",
    ),
)
def membership_summary_query(t: Tables) -> DataFrame:
    return membership_summary(t.members, active_since(t.members))


@query(
    "basket_at_start", "B13 C4",
    with_ctes(
        "members",
        body="""SELECT DISTINCT ticker FROM members WHERE start_date <= DATE '1998-06-30'
 AND (end_date IS NULL OR end_date >= DATE '1998-06-30') ORDER BY ticker LIMIT 40""",
    ),
)
def basket_at_start(t: Tables) -> DataFrame:
    return basket_at(t.members, "1998-06-30", 40)


@query("members_by_month", "C4 M5", with_ctes("members_at", body="SELECT ticker, date FROM members_at"))
def members_by_month(t: Tables) -> DataFrame:
    return members_on(t.month_ends, t.members)


@query("ever_members", "G6", with_ctes("members_at", body="SELECT DISTINCT ticker FROM members_at"))
def ever_members_query(t: Tables) -> DataFrame:
    return ever_members(t.month_ends, t.members)


@query(
    "scores_of_members", "C4 C11",
    with_ctes("members_at", "scores", body=f"SELECT s.date, s.ticker, {r6('score')} AS score FROM scores s JOIN members_at m ON s.ticker = m.ticker AND s.date = m.date"),
)
def scores_of_members(t: Tables) -> DataFrame:
    return rounded(keep_members(t.scores, t.members), "score")


@query(
    "first_known_field", "B18",
    with_ctes(
        "art", "members",
        body=f"""SELECT ticker, DATE '1998-06-30' AS as_of, {r6('netinc')} AS netinc FROM (
 SELECT k.ticker, f.netinc FROM (SELECT DISTINCT ticker, DATE '1998-06-30' AS d FROM members) k
 ASOF LEFT JOIN art f ON k.ticker = f.ticker AND k.d >= f.datekey) z WHERE netinc IS NOT NULL ORDER BY ticker LIMIT 1""",
    ),
)
def first_known_field(t: Tables) -> DataFrame:
    return rounded(first_known(t.members, t.filings, "netinc", "1998-06-30"), "netinc")


@query(
    "fill_prices", "H5 H13 M2",
    with_ctes(
        "bars",
        body=f"""SELECT ticker, date, {r6('open + open * 5 / 10000')} AS buy_price, {r6('open - open * 5 / 10000')} AS sell_price,
 {r6('volume * 0.005')} AS fee, {r6('close')} AS mid FROM bars""",
    ),
)
def fill_prices(t: Tables) -> DataFrame:
    out = t.bars.select(
        "ticker", "date", slipped("open", F.lit("buy"), 5.0).alias("buy_price"),
        slipped("open", F.lit("sell"), 5.0).alias("sell_price"), commission("volume", 0.005).alias("fee"),
        mid_price("close", "close").alias("mid"),
    )
    return rounded(out, "buy_price", "sell_price", "fee", "mid")


@query(
    "order_days_parsed", "H10",
    "SELECT o_orderkey, o_orderdate AS day FROM orders",
)
def order_days_parsed(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", parse_day(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


def _ledger(t: Tables) -> DataFrame:
    return t.raw("orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("slug"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("payload"),
    )


@query(
    "ledger_latest", "A26 M17",
    """SELECT o_orderstatus AS kind, o_orderpriority AS slug, o_orderkey AS seq, o_totalprice AS payload FROM (
 SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
 FROM orders o) z WHERE rn = 1""",
)
def ledger_latest(t: Tables) -> DataFrame:
    return latest_runs(_ledger(t)).select("kind", "slug", "seq", "payload")


@query(
    "ledger_slugs", "A27",
    """SELECT slug, ROW_NUMBER() OVER (ORDER BY d, k) AS pos FROM (SELECT o_orderpriority AS slug, MIN(o_orderdate) AS d,
 ARG_MIN(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) z""",
)
def ledger_slugs(t: Tables) -> DataFrame:
    found = slugs_of_kind(_ledger(t), "F")
    w = Window.partitionBy(F.lit(0)).orderBy("first_seen", "first_seq")
    return found.select("slug", F.row_number().over(w).cast("bigint").alias("pos"))
