"""As-of, interval and forward joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.operators.asof import asof_join, forward_return, series
from pitlane.operators.book import delisted_names, market_open, next_bars
from pitlane.operators.panel import market_caps_at, month_end_dates, next_dates
from pitlane.operators.signals import score_returns
from pitlane.plans.fixtures import Tables, with_ctes
from pitlane.plans.queries_sources import r6, rounded
from pitlane.plans.registry import query


def name_months(t: Tables) -> DataFrame:
    return t.monthly.select("ticker", F.col("month").alias("date"))


@query(
    "asof_filing", "C1 C1a",
    with_ctes(
        "monthly", "art",
        body=f"""SELECT m.ticker, m.month AS date, f.datekey AS filed, {r6('f.netinc')} AS netinc, {r6('f.revenue')} AS revenue
 FROM monthly m ASOF LEFT JOIN art f ON m.ticker = f.ticker AND m.month >= f.datekey""",
    ),
)
def asof_filing(t: Tables) -> DataFrame:
    art = t.filings.where("dimension = 'ART'")
    out = asof_join(name_months(t), art, ["ticker"], "date", "datekey", ["netinc", "revenue"], matched_ts="filed")
    return rounded(out, "netinc", "revenue")


@query(
    "asof_series", "C1 C1b M7",
    with_ctes(
        "monthly", "art",
        body=f"""SELECT m.ticker, m.month AS date, {r6('f.netinc')} AS netinc FROM monthly m
 ASOF LEFT JOIN (SELECT * FROM art WHERE netinc IS NOT NULL) f ON m.ticker = f.ticker AND m.month >= f.datekey""",
    ),
)
def asof_series(t: Tables) -> DataFrame:
    known = series(t.filings.where("dimension = 'ART'"), "netinc")
    return rounded(asof_join(name_months(t), known, ["ticker"], "date", "datekey", ["netinc"]), "netinc")


@query(
    "asof_scores", "C1 M6",
    with_ctes(
        "bars", "scores",
        body=f"""SELECT b.ticker, b.date, {r6('s.score')} AS score FROM bars b
 ASOF LEFT JOIN scores s ON b.ticker = s.ticker AND b.date >= s.date""",
    ),
)
def asof_scores(t: Tables) -> DataFrame:
    facts = t.scores.select("ticker", F.col("date").alias("sd"), "score")
    return rounded(asof_join(t.bars.select("ticker", "date"), facts, ["ticker"], "date", "sd", ["score"]), "score")


@query(
    "asof_stale_guard", "C2 B8 M8",
    with_ctes(
        "monthly", "caps",
        body=f"""SELECT ticker, date, {r6('marketcap')} AS marketcap FROM (SELECT m.ticker, m.month AS date, c.marketcap, c.date AS cd
 FROM monthly m ASOF LEFT JOIN caps c ON m.ticker = c.ticker AND m.month >= c.date) z WHERE date - cd <= 10 AND marketcap > 0""",
    ),
)
def asof_stale_guard(t: Tables) -> DataFrame:
    return rounded(market_caps_at(name_months(t), t.caps), "marketcap")


@query(
    "next_bar", "C3",
    with_ctes(
        "monthly", "bars",
        body=f"""SELECT m.ticker, m.month AS date, b.date AS fill_date, {r6('b.open')} AS fill_open FROM monthly m
 ASOF LEFT JOIN bars b ON m.ticker = b.ticker AND m.month < b.date""",
    ),
)
def next_bar(t: Tables) -> DataFrame:
    return rounded(next_bars(name_months(t), t.bars), "fill_open")


@query(
    "score_forward_returns", "C5 C8 E10",
    with_ctes("pairs", body=f"SELECT ticker, date, {r6('score')} AS score, {r6('ret')} AS ret FROM pairs"),
)
def score_forward_returns(t: Tables) -> DataFrame:
    return rounded(score_returns(t.scores, t.bars).select("ticker", "date", "score", "ret"), "score", "ret")


@query(
    "forward_return_30d", "C6",
    with_ctes(
        "scores", "bars",
        body=f"""SELECT ticker, date, {r6('CASE WHEN p0 <> 0 THEN p1 / p0 - 1 END')} AS ret FROM (
 SELECT e.*, b.close AS p1 FROM (SELECT s.ticker, s.date, CAST(s.date + INTERVAL '30' DAY AS DATE) AS nd, b.close AS p0 FROM scores s
 ASOF LEFT JOIN bars b ON s.ticker = b.ticker AND s.date >= b.date) e
 ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.nd >= b.date) z""",
    ),
)
def forward_return_30d(t: Tables) -> DataFrame:
    dated = t.scores.select("ticker", "date", F.date_add("date", 30).alias("next_date"))
    out = forward_return(dated, t.bars, stale_days=None, need_later_exit=False)
    return rounded(out.select("ticker", "date", "ret"), "ret")


@query(
    "asof_year_ago", "C7",
    with_ctes(
        "monthly", "art",
        body=f"""SELECT ticker, date, {r6('f.revenue')} AS revenue_then FROM (SELECT ticker, month AS date,
 CAST(month - INTERVAL '365' DAY AS DATE) AS d FROM monthly) k ASOF LEFT JOIN (SELECT ticker AS tk, datekey, revenue FROM art) f
 ON k.ticker = f.tk AND k.d >= f.datekey""",
    ),
)
def asof_year_ago(t: Tables) -> DataFrame:
    keys = name_months(t).withColumn("then", F.date_sub("date", 365))
    art = t.filings.where("dimension = 'ART'").select("ticker", "datekey", F.col("revenue").alias("revenue_then"))
    return rounded(asof_join(keys, art, ["ticker"], "then", "datekey", ["revenue_then"]).drop("then"), "revenue_then")


@query(
    "benchmark_carried", "C15",
    with_ctes(
        "calendar", "benchmark_levels",
        body=f"""SELECT c.date, {r6('b.level')} AS level FROM calendar c ASOF LEFT JOIN benchmark_levels b ON c.date >= b.date""",
    ),
)
def benchmark_carried(t: Tables) -> DataFrame:
    levels = t.benchmark_levels.select(F.col("date").alias("ld"), "level")
    return rounded(asof_join(t.calendar, levels, [], "date", "ld", ["level"]), "level")


@query(
    "delisted_names", "E17",
    with_ctes(
        "monthly", "bars",
        body="""SELECT l.ticker, e.date, l.last_bar FROM (SELECT ticker, MAX(date) AS last_bar FROM bars GROUP BY ticker) l
 JOIN (SELECT ticker, CAST(month + INTERVAL '20' DAY AS DATE) AS date FROM monthly) e ON l.ticker = e.ticker WHERE l.last_bar < e.date""",
    ),
)
def delisted_names_query(t: Tables) -> DataFrame:
    asked = name_months(t).select("ticker", F.date_add("date", 20).alias("date"))
    return delisted_names(asked, t.bars)


@query(
    "market_open_days", "J16",
    with_ctes(
        "benchmark_levels", "bars",
        body="SELECT date FROM benchmark_levels WHERE date IN (SELECT date FROM bars)",
    ),
)
def market_open_days(t: Tables) -> DataFrame:
    return market_open(t.benchmark_levels.select("date"), t.bars)


@query("month_ends", "D24", with_ctes("month_ends", body="SELECT month, date FROM month_ends"))
def month_ends(t: Tables) -> DataFrame:
    return month_end_dates(t.calendar)


@query(
    "next_panel_date", "E10",
    with_ctes("month_ends", body="SELECT date, LEAD(date) OVER (ORDER BY date) AS next_date FROM month_ends"),
)
def next_panel_date(t: Tables) -> DataFrame:
    return next_dates(t.month_ends)
