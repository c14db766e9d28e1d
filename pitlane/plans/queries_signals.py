"""Signal statistics, holdings of the top-K book, evaluation design and inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.functions.scalar import normal_cdf, normal_ppf, round_half_up
from pitlane.functions.stats import kurtosis, sample_cov, sample_std, sharpe, skewness
from pitlane.operators.crossval import combinatorial_purged, contiguous_blocks, folds, overlap, purged_kfold
from pitlane.operators.evaluation import long_enough, metric_spread, per_window, rolling_windows
from pitlane.operators.holdings import (
    breadth, mean_turnover, most_persistent, sector_by_year, sector_share, snapshot, tenure, top_book, tracked,
    turnover_by_year,
)
from pitlane.operators.inference import deflate, other_windows, trial_sharpes, verdict
from pitlane.operators.metrics import (
    METRICS, PERCENT_METRICS, drawdown, fill_stats, growth, metrics_long, paired_returns, returns, run_metrics,
    summary_text,
)
from pitlane.operators.models import section_index
from pitlane.operators.ranks import exact_median
from pitlane.operators.signals import (
    decile_spread, diagnose, newey_west, prediction_size, rank_ic, rolling_mean_ic, score_returns, signal_months,
    signal_summary, spread_growth, valuation_error,
)
from pitlane.operators.weights import run_timeline
from pitlane.plans.fixtures import Tables, with_ctes
from pitlane.plans.queries_sources import r6, rounded
from pitlane.plans.registry import query
from pitlane.session import cut

MIN_NAMES, K = 5, 5


def pairs(t: Tables) -> DataFrame:
    return cut(score_returns(t.scores, t.bars).select("ticker", "date", "score", "ret"))


def months(t: Tables) -> DataFrame:
    return signal_months(pairs(t), min_names=MIN_NAMES)


@query("rank_ic", "D25 E16", with_ctes("ic", body=f"SELECT date, n_names, {r6('rank_ic')} AS rank_ic FROM ic"))
def rank_ic_query(t: Tables) -> DataFrame:
    return rounded(rank_ic(pairs(t)), "rank_ic")


@query("decile_spread", "D26", with_ctes("spreads", body=f"SELECT date, {r6('decile_spread')} AS decile_spread FROM spreads"))
def decile_spread_query(t: Tables) -> DataFrame:
    return rounded(decile_spread(pairs(t)), "decile_spread")


@query(
    "signal_months", "D28 M16",
    with_ctes("months", body=f"SELECT date, n_names, {r6('rank_ic')} AS rank_ic, {r6('decile_spread')} AS decile_spread FROM months"),
)
def signal_months_query(t: Tables) -> DataFrame:
    return rounded(months(t), "rank_ic", "decile_spread")


def nw_sql(src: str, col: str) -> str:
    return f"""(SELECT CASE WHEN MAX(t) >= 2 AND SUM(CASE WHEN l = 0 THEN g ELSE 2.0 * (1.0 - l / 4.0) * g END) > 0
 THEN MAX(m) / SQRT(SUM(CASE WHEN l = 0 THEN g ELSE 2.0 * (1.0 - l / 4.0) * g END) / MAX(t)) END FROM (
 SELECT b.i - a.i AS l, SUM(a.d * b.d) / MAX(a.t) AS g, MAX(a.m) AS m, MAX(a.t) AS t FROM
 (SELECT ROW_NUMBER() OVER (ORDER BY date) AS i, {col} - AVG({col}) OVER () AS d, AVG({col}) OVER () AS m, COUNT(*) OVER () AS t FROM {src} WHERE {col} IS NOT NULL) a
 JOIN (SELECT ROW_NUMBER() OVER (ORDER BY date) AS i, {col} - AVG({col}) OVER () AS d FROM {src} WHERE {col} IS NOT NULL) b
 ON b.i - a.i BETWEEN 0 AND 3 GROUP BY 1) g)"""


@query(
    "newey_west", "D27",
    with_ctes("months", body=f"SELECT COUNT(rank_ic) AS n_months, {r6('AVG(rank_ic)')} AS mean, {r6(nw_sql('months', 'rank_ic'))} AS nw_t FROM months"),
)
def newey_west_query(t: Tables) -> DataFrame:
    return rounded(newey_west(months(t), "rank_ic"), "mean", "nw_t")


@query(
    "signal_summary", "D28",
    with_ctes(
        "months",
        body=f"""SELECT COUNT(*) AS n_months, {r6('AVG(rank_ic)')} AS mean_ic,
 {r6('CAST(COUNT(CASE WHEN rank_ic > 0 THEN 1 END) AS DOUBLE) / COUNT(*)')} AS hit_rate, {r6('AVG(decile_spread)')} AS mean_spread,
 COUNT(*) - COUNT(rank_ic) AS n_undefined, {r6(nw_sql('months', 'rank_ic'))} AS ic_t, {r6(nw_sql('months', 'decile_spread'))} AS spread_t FROM months""",
    ),
)
def signal_summary_query(t: Tables) -> DataFrame:
    return rounded(signal_summary(cut(months(t))), "mean_ic", "hit_rate", "mean_spread", "ic_t", "spread_t")


@query(
    "signal_diagnosis", "K10 C4 C5 D25 D26",
    with_ctes(
        "members_at", "scores", "bars",
        body=f"""WITH own AS (SELECT s.ticker, s.date, s.score FROM scores s JOIN members_at m ON s.ticker = m.ticker AND s.date = m.date),
 q AS (SELECT o.*, d.nd FROM own o JOIN (SELECT date, LEAD(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM own) x) d ON o.date = d.date),
 e AS (SELECT q.*, b.date AS d0, b.close AS p0 FROM q ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND q.date >= b.date),
 x AS (SELECT e.*, b.date AS d1, b.close AS p1 FROM e ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.nd >= b.date),
 p AS (SELECT ticker, date, score, p1 / p0 - 1 AS ret FROM x WHERE date - d0 <= 10 AND d1 > d0),
 r AS (SELECT date, ret, RANK() OVER (PARTITION BY date ORDER BY score) + (COUNT(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS rs,
 RANK() OVER (PARTITION BY date ORDER BY ret) + (COUNT(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS rr,
 ROW_NUMBER() OVER (PARTITION BY date ORDER BY score, ticker) AS rn, COUNT(*) OVER (PARTITION BY date) AS n FROM p)
 SELECT date, COUNT(*) AS n_names, {r6('CASE WHEN COUNT(*) >= 3 AND STDDEV_SAMP(rs) * STDDEV_SAMP(rr) > 0 THEN COVAR_SAMP(rs, rr) / (STDDEV_SAMP(rs) * STDDEV_SAMP(rr)) END')} AS rank_ic,
 {r6('CASE WHEN MAX(n) >= 20 THEN AVG(CASE WHEN rn > n - n // 10 THEN ret END) - AVG(CASE WHEN rn <= n // 10 THEN ret END) END')} AS decile_spread
 FROM r GROUP BY date HAVING COUNT(*) >= {MIN_NAMES}""",
    ),
)
def signal_diagnosis(t: Tables) -> DataFrame:
    return rounded(diagnose(t.scores, t.members, t.bars, min_names=MIN_NAMES), "rank_ic", "decile_spread")


@query(
    "rolling_ic", "E11 K12",
    with_ctes(
        "months",
        body=f"""SELECT date, {r6('ric')} AS rolling_ic FROM (SELECT date, AVG(rank_ic) OVER w AS ric, COUNT(*) OVER w AS n FROM months
 WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) z WHERE n = 12""",
    ),
)
def rolling_ic(t: Tables) -> DataFrame:
    return rounded(rolling_mean_ic(months(t), 12), "rolling_ic")


@query(
    "spread_growth", "E12 K12",
    with_ctes(
        "months",
        body=f"""SELECT date, g < 0 AS negative, {r6('LN(ABS(g))')} AS log_growth FROM (
 SELECT date, PRODUCT(1 + decile_spread) OVER (ORDER BY date) AS g FROM months WHERE decile_spread IS NOT NULL) z""",
    ),
)
def spread_growth_query(t: Tables) -> DataFrame:
    # Shown as sign and logarithm: over the years the growth itself spans twenty digits here.
    out = spread_growth(months(t)).select(
        "date", (F.col("growth") < 0).alias("negative"), F.ln(F.abs("growth")).alias("log_growth")
    )
    return rounded(out, "log_growth")


@query(
    "valuation_error", "D36 D2",
    with_ctes("scores", body=f"SELECT {r6('EXP(MEDIAN(ABS(score))) - 1')} AS median_ape, COUNT(*) AS n FROM scores"),
)
def valuation_error_query(t: Tables) -> DataFrame:
    return rounded(valuation_error(t.scores), "median_ape")


@query(
    "prediction_size", "D37",
    with_ctes(
        "scores",
        body=f"""SELECT {r6('MAX(CASE WHEN rn - 1 = n // 2 THEN a END)')} AS median_abs, MAX(n) AS n FROM (
 SELECT ABS(score) AS a, ROW_NUMBER() OVER (ORDER BY ABS(score)) AS rn, COUNT(*) OVER () AS n FROM scores) z""",
    ),
)
def prediction_size_query(t: Tables) -> DataFrame:
    return rounded(prediction_size(t.scores), "median_abs")


@query(
    "median_volume", "D2",
    with_ctes("bars", body=f"SELECT ticker, {r6('MEDIAN(volume)')} AS median, COUNT(*) AS n FROM bars GROUP BY ticker"),
)
def median_volume(t: Tables) -> DataFrame:
    return rounded(exact_median(t.bars.select("ticker", "volume"), ["ticker"], "volume"), "median")


# Holdings of the top-K book.


def book(t: Tables) -> DataFrame:
    return top_book(t.month_ends, t.scores, t.members, K)


@query(
    "top_scored", "E4 F1 G1 C11 J15",
    with_ctes("book", body=f"SELECT date, ticker, {r6('score')} AS score, CAST(rank AS INTEGER) AS rank FROM book"),
)
def top_scored(t: Tables) -> DataFrame:
    return rounded(book(t).select("date", "ticker", "score", "rank"), "score")


_HELD = "SELECT b.date, b.ticker, COALESCE(s.sector, 'Unknown') AS sector FROM book b LEFT JOIN sectors s ON b.ticker = s.ticker"


@query(
    "sector_by_year", "D29 C9",
    with_ctes(
        "book", "sectors",
        body=f"""SELECT CAST(y AS INTEGER) AS year, sector, {r6('CAST(c AS DOUBLE) / m')} AS mean_names FROM (
 SELECT YEAR(date) AS y, sector, COUNT(*) AS c FROM ({_HELD}) h GROUP BY 1, 2) a
 JOIN (SELECT YEAR(date) AS y2, COUNT(DISTINCT date) AS m FROM book GROUP BY 1) n ON a.y = n.y2""",
    ),
)
def sector_by_year_query(t: Tables) -> DataFrame:
    return rounded(sector_by_year(cut(book(t)), t.sectors), "mean_names")


_TURN = f"""SELECT d.nd AS date, CAST(COUNT(*) FILTER (WHERE p.ticker IS NULL) AS DOUBLE) / {K} AS replaced FROM (
 SELECT date, LEAD(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM book) x) d
 JOIN book b ON b.date = d.nd LEFT JOIN book p ON p.date = d.date AND p.ticker = b.ticker GROUP BY d.nd"""


@query(
    "turnover_by_year", "D30 C13",
    with_ctes("book", body=f"SELECT CAST(YEAR(date) AS INTEGER) AS year, {r6('AVG(replaced)')} AS turnover, COUNT(*) AS n FROM ({_TURN}) z GROUP BY 1"),
)
def turnover_by_year_query(t: Tables) -> DataFrame:
    return rounded(turnover_by_year(cut(book(t)), K), "turnover")


@query(
    "mean_turnover", "D30",
    with_ctes("book", body=f"SELECT {r6('AVG(replaced)')} AS turnover, COUNT(*) AS n FROM ({_TURN}) z"),
)
def mean_turnover_query(t: Tables) -> DataFrame:
    return rounded(mean_turnover(cut(book(t)), K), "turnover")


_TENURE = "SELECT ticker, COUNT(*) AS months, MIN(date) AS first_date, MAX(date) AS last_date FROM book GROUP BY ticker"


@query("tenure", "D31", with_ctes("book", body=_TENURE))
def tenure_query(t: Tables) -> DataFrame:
    return tenure(book(t))


@query(
    "most_persistent", "D31 F3",
    with_ctes(
        "book", "sectors",
        body=f"""SELECT z.ticker, months, first_date, last_date, sector FROM ({_TENURE} ORDER BY months DESC, ticker LIMIT 25) z
 LEFT JOIN sectors s ON z.ticker = s.ticker""",
    ),
)
def most_persistent_query(t: Tables) -> DataFrame:
    return most_persistent(book(t), t.sectors)


@query(
    "breadth", "D32",
    with_ctes("book", body=f"SELECT COUNT(*) AS n_names, {r6('AVG(months)')} AS mean_tenure FROM ({_TENURE}) z"),
)
def breadth_query(t: Tables) -> DataFrame:
    return rounded(breadth(book(t)), "mean_tenure")


@query(
    "sector_share", "D33 K12",
    with_ctes(
        "book", "sectors",
        body=f"SELECT date, sector, {r6('CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY date)')} AS share FROM ({_HELD}) h GROUP BY date, sector",
    ),
)
def sector_share_query(t: Tables) -> DataFrame:
    return rounded(sector_share(book(t), t.sectors), "share")


_NEXT = """SELECT e.*, CASE WHEN p0 <> 0 THEN b.close / p0 - 1 END AS next_return FROM (
 SELECT k.*, CAST(k.date + INTERVAL '30' DAY AS DATE) AS nd, b.close AS p0 FROM book k ASOF LEFT JOIN bars b ON k.ticker = b.ticker AND k.date >= b.date) e
 ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.nd >= b.date"""
SNAPSHOTS = ("1997-01-31", "1998-06-30", "2000-01-31")


@query(
    "book_snapshots", "F5 C6",
    with_ctes(
        "book", "bars",
        body=f"""SELECT date, ticker, {r6('score')} AS score, CAST(rank AS INTEGER) AS rank, {r6('next_return')} AS next_return FROM ({_NEXT}) z
 WHERE date IN (DATE '1997-01-31', DATE '1998-06-30', DATE '2000-01-31')""",
    ),
)
def book_snapshots(t: Tables) -> DataFrame:
    out = snapshot(book(t), t.bars, SNAPSHOTS).select("date", "ticker", "score", "rank", "next_return")
    return rounded(out, "score", "next_return")


TRACKED = ("S1", "S7", "S12", "S23", "S40", "S77")


@query(
    "tracked_names", "D35",
    with_ctes(
        "book", "bars",
        body=f"""SELECT ticker, COUNT(*) AS months, MIN(date) AS first_date, MAX(date) AS last_date, {r6('AVG(next_return)')} AS mean_return
 FROM ({_NEXT}) z WHERE ticker IN {TRACKED} GROUP BY ticker""",
    ),
)
def tracked_names(t: Tables) -> DataFrame:
    return rounded(tracked(book(t), t.bars, TRACKED), "mean_return")


# Metrics: each name's monthly value is one equity curve.


def equity(t: Tables) -> DataFrame:
    from pitlane.operators.asof import asof_join

    curves = t.monthly.select(F.col("ticker").alias("run_id"), F.col("month").alias("ts"), F.col("marketcap").alias("equity"))
    levels = t.benchmark_levels.select(F.col("date").alias("ld"), "level")
    days = asof_join(curves.select("ts").distinct(), levels, [], "ts", "ld", ["level"])
    return curves.join(days, "ts").select("run_id", "ts", "equity", "level")


@query(
    "period_returns", "E1 M11",
    with_ctes("rets", body=f"SELECT run_id, ts, {r6('ret')} AS ret FROM rets"),
)
def period_returns(t: Tables) -> DataFrame:
    return rounded(returns(equity(t)).select("run_id", "ts", "ret"), "ret")


@query("drawdown_curve", "E2 K12", with_ctes("rets", body=f"SELECT run_id, ts, {r6('dd')} AS drawdown FROM rets"))
def drawdown_curve(t: Tables) -> DataFrame:
    return rounded(drawdown(equity(t)).select("run_id", "ts", "drawdown"), "drawdown")


@query(
    "growth_curve", "E3 K12",
    with_ctes("equity", body=f"SELECT run_id, ts, {r6('equity / FIRST_VALUE(equity) OVER (PARTITION BY run_id ORDER BY ts)')} AS growth FROM equity"),
)
def growth_curve(t: Tables) -> DataFrame:
    return rounded(growth(equity(t)).select("run_id", "ts", "growth"), "growth")


@query(
    "paired_returns", "C14",
    with_ctes("rets", body=f"SELECT run_id, ts, {r6('pr')} AS pair_ret, {r6('br')} AS bench_ret FROM rets"),
)
def paired_returns_query(t: Tables) -> DataFrame:
    return rounded(paired_returns(equity(t)).select("run_id", "ts", "pair_ret", "bench_ret"), "pair_ret", "bench_ret")


METRIC_SQL = """SELECT *, total_return - benchmark_return AS active_return FROM (
 SELECT run_id, n_steps, start_equity, final_equity, (final_equity - start_equity) / start_equity AS total_return,
 CASE WHEN start_equity > 0 AND final_equity > 0 AND days > 0 THEN EXP(LN(final_equity / start_equity) / (days * 86400.0 / 31557600)) - 1 END AS cagr,
 volatility, sharpe_ratio, max_drawdown, 0.0::DOUBLE AS turnover,
 CASE WHEN known >= 2 AND l0 > 0 THEN (l1 - l0) / l0 END AS benchmark_return,
 tracking_error, information_ratio, beta, (mp - beta * mb) * 252 AS jensens_alpha FROM (
 SELECT run_id, COUNT(*) AS n_steps, ARG_MIN(equity, ts) AS start_equity, ARG_MAX(equity, ts) AS final_equity,
 MAX(ts) - MIN(ts) AS days, CASE WHEN COUNT(ret) >= 2 THEN STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END AS volatility,
 CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) END AS sharpe_ratio,
 LEAST(MIN(dd), 0) AS max_drawdown, COUNT(level) AS known, ARG_MIN(level, ts) FILTER (WHERE level IS NOT NULL) AS l0,
 ARG_MAX(level, ts) FILTER (WHERE level IS NOT NULL) AS l1,
 STDDEV_SAMP(pr - br) * SQRT(252) AS tracking_error,
 CASE WHEN STDDEV_SAMP(pr - br) > 0 THEN AVG(pr - br) / STDDEV_SAMP(pr - br) * SQRT(252) END AS information_ratio,
 CASE WHEN VAR_SAMP(br) > 0 THEN COVAR_SAMP(pr, br) / VAR_SAMP(br) END AS beta, AVG(pr) AS mp, AVG(br) AS mb
 FROM rets GROUP BY run_id) a) b"""


@query(
    "run_metrics", "D8 D9 D10 D11 D12 D13 D14 D15 D16 D17 D18 D21 H11",
    with_ctes(
        "rets",
        body=f"SELECT run_id, n_steps, {r6('start_equity')} AS start_equity, {r6('final_equity')} AS final_equity, "
        + ", ".join(f"{r6(m)} AS {m}" for m in METRICS) + f" FROM ({METRIC_SQL}) z",
    ),
)
def run_metrics_query(t: Tables) -> DataFrame:
    out = run_metrics(equity(t)).drop("n_fills", "notional")
    return rounded(out, "start_equity", "final_equity", *METRICS)


@query(
    "metrics_long", "D21",
    with_ctes(
        "rets",
        body="SELECT run_id, metric, " + r6("value") + " AS value FROM ("
        + " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, {m} AS value FROM m" for m in METRICS) + ") z",
    ).replace("\nSELECT run_id, metric", f", m AS ({METRIC_SQL})\nSELECT run_id, metric"),
)
def metrics_long_query(t: Tables) -> DataFrame:
    return rounded(metrics_long(run_metrics(equity(t))), "value")


@query(
    "fill_activity", "D19 B17",
    """SELECT CONCAT('C', CAST(o_custkey AS VARCHAR)) AS run_id, COUNT(*) AS n_fills,
 FLOOR(SUM(l_quantity * l_extendedprice) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS notional
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_custkey""",
)
def fill_activity(t: Tables) -> DataFrame:
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fills = lines.selectExpr(
        "CONCAT('C', CAST(o_custkey AS STRING)) AS run_id", "l_quantity AS qty", "l_extendedprice AS price",
        "CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'rejected' ELSE 'waiting' END AS status",
    )
    return fill_stats(fills).withColumn("notional", round_half_up("notional", 2))


def windows(t: Tables) -> DataFrame:
    return rolling_windows(t.spark, "1995-01-02", "2001-11-04", window_years=2, step_months=12)


WINDOWS_SQL = """SELECT CAST(i AS INTEGER) AS window_id, CAST(DATE '1995-01-02' + to_months(CAST(12 * i AS INTEGER)) AS DATE) AS start,
 CAST(DATE '1995-01-02' + to_months(CAST(12 * i + 24 AS INTEGER)) AS DATE) AS "end" FROM range(0, 20) r(i)
 WHERE CAST(DATE '1995-01-02' + to_months(CAST(12 * i + 24 AS INTEGER)) AS DATE) <= DATE '2001-11-04'"""


@query(
    "window_timelines", "K1 H9 H12 M14 B14",
    with_ctes(
        "calendar",
        body=f"""SELECT label, COUNT(*) AS n_days FROM (SELECT strftime(start, '%Y-%m-%d') || ' -> ' || strftime("end", '%Y-%m-%d') AS label, start, "end"
 FROM ({WINDOWS_SQL}) w) v JOIN calendar c ON c.date BETWEEN start AND "end" GROUP BY label HAVING COUNT(*) >= 42""",
    ),
)
def window_timelines(t: Tables) -> DataFrame:
    runs = windows(t).select(F.col("label").alias("run_id"), "start", "end")
    days = run_timeline(runs, t.calendar).withColumnRenamed("run_id", "label")
    return long_enough(days, 21, by=["label"])


def windowed_metrics(t: Tables) -> DataFrame:
    """Metrics of every name in every window: (strategy, start, end) is a run."""
    days = run_timeline(windows(t).select(F.col("window_id").cast("string").alias("run_id"), "start", "end"),
                        t.monthly.select(F.col("month").alias("date")).distinct())
    spans = windows(t).select(F.col("window_id").cast("string").alias("w"), "start", "end")
    curves = equity(t).withColumnRenamed("run_id", "strategy").join(
        days.select(F.col("run_id").alias("w"), F.col("date").alias("ts")), "ts"
    )
    wide = run_metrics(curves.join(spans, "w"), by=["strategy", "start", "end"])
    return wide


WINDOWED_SQL = METRIC_SQL.replace("FROM rets GROUP BY run_id", "FROM wrets GROUP BY run_id")
WRETS = f"""v AS (SELECT e.run_id || '|' || w.start || '|' || w."end" AS run_id, ts, equity, level FROM equity e JOIN ({WINDOWS_SQL}) w ON e.ts BETWEEN w.start AND w."end"),
 ws AS (SELECT v.*, LAG(equity) OVER w AS pe, LAG(level) OVER w AS pl, MAX(equity) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
 FROM v WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
 wrets AS (SELECT s.*, CASE WHEN pe > 0 THEN (equity - pe) / pe END AS ret, CASE WHEN pe > 0 AND pl > 0 AND level IS NOT NULL THEN (equity - pe) / pe END AS pr,
 CASE WHEN pe > 0 AND pl > 0 AND level IS NOT NULL THEN (level - pl) / pl END AS br, CASE WHEN peak > 0 THEN (equity - peak) / peak ELSE 0 END AS dd FROM ws s)"""


@query(
    "metric_spread", "D22 K2 D1 D2 D3",
    with_ctes(
        "equity",
        body=f"""WITH {WRETS}, m AS ({WINDOWED_SQL}), l AS ("""
        + " UNION ALL ".join(
            f"SELECT SPLIT_PART(run_id, '|', 1) AS strategy, '{m}' AS metric, {m} * {100 if m in PERCENT_METRICS else 1} AS value FROM m"
            for m in METRICS
        )
        + f""") SELECT strategy, metric, COUNT(*) AS n_windows, {r6('AVG(value)')} AS mean, {r6('COALESCE(STDDEV_SAMP(value), 0)')} AS std,
 {r6('MIN(value)')} AS min, {r6('MEDIAN(value)')} AS median, {r6('MAX(value)')} AS max FROM l WHERE value IS NOT NULL GROUP BY strategy, metric""",
    ),
)
def metric_spread_query(t: Tables) -> DataFrame:
    out = metric_spread(windowed_metrics(t))
    return rounded(out, "mean", "std", "min", "median", "max")


@query(
    "per_window_values", "D23 H12",
    with_ctes(
        "equity",
        body=f"""WITH {WRETS}, m AS ({WINDOWED_SQL}) """ + " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, SPLIT_PART(run_id, '|', 1) AS strategy, CAST(SPLIT_PART(run_id, '|', 2) AS DATE) AS start,
 SPLIT_PART(run_id, '|', 2) || ' -> ' || SPLIT_PART(run_id, '|', 3) AS label, COALESCE(printf('%.4f', {m}), 'n/a') AS value FROM m"""
            for m in METRICS),
    ),
)
def per_window_values(t: Tables) -> DataFrame:
    wide = cut(windowed_metrics(t))
    return reduce(DataFrame.unionByName, [per_window(wide, m).withColumn("metric", F.lit(m)) for m in METRICS])


_TEXTS = ", ".join(
    [f"COALESCE(format('{{:,.2f}}', {m} * 100) || ' %', 'n/a') AS {m}" for m in PERCENT_METRICS]
    + [f"COALESCE(format('{{:,.3f}}', {m}), 'n/a') AS {m}" for m in ("sharpe_ratio", "information_ratio", "beta")]
    + [f"format('{{:,.2f}}', {m}) || ' USD' AS {m}" for m in ("start_equity", "final_equity")]
    + ["format('{:,.2f}', turnover) || ' x' AS turnover", "'0' AS n_fills"])


@query("summary_text", "K11", with_ctes("rets", body=f"SELECT run_id, {_TEXTS} FROM ({METRIC_SQL}) z"))
def summary_text_query(t: Tables) -> DataFrame:
    return summary_text(run_metrics(equity(t)))


@query(
    "return_moments", "D1 D3 D4 D5 D6 D7",
    with_ctes(
        "rets",
        body=f"""SELECT run_id, {r6('AVG(ret)')} AS mean, {r6('COALESCE(STDDEV_SAMP(ret), 0)')} AS std, {r6('COVAR_SAMP(pr, br)')} AS cov,
 {r6('CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) END')} AS sharpe,
 {r6('CASE WHEN MAX(m2) > 0 THEN AVG(POWER(ret - mu, 3)) / POWER(AVG(POWER(ret - mu, 2)), 1.5) END')} AS skew,
 {r6('CASE WHEN MAX(m2) > 0 THEN AVG(POWER(ret - mu, 4)) / POWER(AVG(POWER(ret - mu, 2)), 2) END')} AS kurt
 FROM (SELECT *, AVG(ret) OVER (PARTITION BY run_id) AS mu, VAR_POP(ret) OVER (PARTITION BY run_id) AS m2 FROM rets) z GROUP BY run_id""",
    ),
)
def return_moments(t: Tables) -> DataFrame:
    steps = paired_returns(returns(equity(t)))
    out = steps.groupBy("run_id").agg(
        F.avg("ret").alias("mean"), sample_std("ret").alias("std"), sample_cov("pair_ret", "bench_ret").alias("cov"),
        sharpe("ret").alias("sharpe"), skewness("ret").alias("skew"), kurtosis("ret").alias("kurt"),
    )
    return rounded(out, "mean", "std", "cov", "sharpe", "skew", "kurt")


# Inference: every name is a trial; its window is its own first and last month.


def trials(t: Tables) -> DataFrame:
    curves = equity(t)
    spans = curves.groupBy("run_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return trial_sharpes(curves.join(spans, "run_id"))


# Abramowitz and Stegun 26.2.17 has too few digits for a twin, so the quantile is checked through its own inverse:
# the normal distribution function written as the integral's rational approximation.
def cdf_sql(z: str) -> str:
    from pitlane.functions.scalar import _CDF_DEN, _CDF_NUM

    def poly(cs: tuple[float, ...]) -> str:
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * a + {c!r}::DOUBLE)"
        return out

    return (
        f"(SELECT CASE WHEN z > 0 THEN 1 - tail ELSE tail END FROM (SELECT z, EXP(-a * a / 2) * {poly(_CDF_NUM)} / {poly(_CDF_DEN)} AS tail "
        f"FROM (SELECT z, ABS(z) AS a FROM (SELECT {z} AS z) q0) q1) q2)"
    )


@query(
    "normal_distribution", "H6",
    with_ctes(
        "pairs",
        body=f"SELECT ticker, date, {r6(cdf_sql('ret'))} AS cdf, {r6('CASE WHEN ret > -5 AND ret < 5 THEN ret END')} AS z FROM pairs",
    ),
)
def normal_distribution(t: Tables) -> DataFrame:
    rows = score_returns(t.scores, t.bars).withColumn("cdf", normal_cdf("ret"))
    out = rows.select("ticker", "date", "cdf", F.when((F.col("ret") > -5) & (F.col("ret") < 5), normal_ppf("cdf")).alias("z"))
    return rounded(out, "cdf", "z")


_TRIALS_SQL = """tr AS (SELECT run_id, MIN(s) AS start, MAX(e) AS "end", COUNT(*) AS n_obs, CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) END AS sharpe,
 AVG(POWER(ret - mu, 3)) / POWER(AVG(POWER(ret - mu, 2)), 1.5) AS skew, AVG(POWER(ret - mu, 4)) / POWER(AVG(POWER(ret - mu, 2)), 2) AS kurt
 FROM (SELECT r.*, MIN(ts) OVER (PARTITION BY run_id) AS s, MAX(ts) OVER (PARTITION BY run_id) AS e, AVG(ret) OVER (PARTITION BY run_id) AS mu FROM rets r) z
 WHERE ret IS NOT NULL GROUP BY run_id),
 fam AS (SELECT start, "end", COUNT(sharpe) AS n_trials, AVG(sharpe) AS mean_sharpe, VAR_SAMP(sharpe) AS sr_var FROM tr GROUP BY start, "end")"""


@query(
    "trial_families", "D39 C17 K6 K9",
    with_ctes(
        "rets",
        body=f"""WITH {_TRIALS_SQL} SELECT run_id, n_trials, n_obs, {r6('sharpe')} AS sharpe, {r6('skew')} AS skew, {r6('kurt')} AS kurt,
 {r6('mean_sharpe')} AS mean_sharpe, {r6('sr_var')} AS sr_var, {r6(cdf_sql('sharpe * SQRT(n_obs - 1) / SQRT(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)'))} AS psr
 FROM tr JOIN fam ON tr.start = fam.start AND tr."end" = fam."end" """,
    ),
)
def trial_families(t: Tables) -> DataFrame:
    out = deflate(trials(t)).select("run_id", "n_trials", "n_obs", "sharpe", "skew", "kurt", "mean_sharpe", "sr_var", "psr")
    return rounded(out, "sharpe", "skew", "kurt", "mean_sharpe", "sr_var", "psr")


def _newton(step: int) -> str:
    """One step of the quantile search on the distribution function."""
    cells = ", ".join(f"z{i} - ({cdf_sql(f'z{i}')} - p{i}) / (EXP(-z{i} * z{i} / 2) / SQRT(2 * PI())) AS z{i}" for i in (1, 2))
    return f"q{step} AS (SELECT start, \"end\", n_trials, sr_var, mean_sharpe, p1, p2, {cells} FROM q{step - 1})"


def _start(i: int) -> str:
    t = f"SQRT(-2 * LN(1 - p{i}))"
    return f"{t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}) AS z{i}"


_DEFLATED = f"""WITH {_TRIALS_SQL},
 p AS (SELECT *, 1 - 1.0::DOUBLE / n_trials AS p1, 1 - 1.0::DOUBLE / (n_trials * EXP(1.0::DOUBLE)) AS p2 FROM fam WHERE n_trials >= 2),
 q0 AS (SELECT *, {_start(1)}, {_start(2)} FROM p), {", ".join(_newton(i) for i in range(1, 5))},
 d AS (SELECT tr.run_id, tr.start, tr."end", fam.n_trials, n_obs, sharpe, skew, kurt, fam.mean_sharpe, fam.sr_var,
  SQRT(q4.sr_var) * ((1 - 0.5772156649015329) * z1 + 0.5772156649015329 * z2) AS expected_max,
  SQRT(n_obs - 1) / SQRT(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS k
  FROM tr JOIN fam ON tr.start = fam.start AND tr."end" = fam."end" LEFT JOIN q4 ON tr.start = q4.start AND tr."end" = q4."end"),
 v AS (SELECT *, {cdf_sql('sharpe * k')} AS psr, {cdf_sql('(sharpe - expected_max) * k')} AS dsr FROM d)
 SELECT run_id, start, "end", n_trials, n_obs, {r6('sharpe')} AS sharpe, {r6('skew')} AS skew, {r6('kurt')} AS kurt, {r6('mean_sharpe')} AS mean_sharpe,
 {r6('sr_var')} AS sr_var, {r6('sharpe * SQRT(252.0::DOUBLE)')} AS sharpe_annual, {r6('expected_max')} AS expected_max, {r6('psr')} AS psr, {r6('dsr')} AS dsr,
 CASE WHEN dsr > 0.95 THEN 'survives' WHEN dsr < 0.5 THEN 'does NOT survive' WHEN dsr IS NOT NULL THEN 'marginal under' END AS verdict FROM v"""


@query("deflated_sharpe", "K6 K7 K8 K9 H6 H15", with_ctes("rets", body=_DEFLATED))
def deflated_sharpe_query(t: Tables) -> DataFrame:
    return rounded(deflate(trials(t)), "sharpe", "skew", "kurt", "mean_sharpe", "sr_var", "sharpe_annual", "expected_max", "psr", "dsr")


@query(
    "trials_outside_window", "C17",
    with_ctes(
        "rets",
        body=f"""WITH {_TRIALS_SQL} SELECT run_id, start, "end" FROM tr WHERE NOT EXISTS (SELECT 1 FROM tr o WHERE o.run_id = 'S1' AND o.start = tr.start AND o."end" = tr."end")""",
    ),
)
def trials_outside_window(t: Tables) -> DataFrame:
    return other_windows(trials(t), "S1")


# Cross-validation over the trading days.


def _samples(t: Tables) -> tuple[DataFrame, int]:
    days = section_index(t.calendar).select("date", F.col("section").alias("idx"))
    return days, t.calendar.count()


_DAYS = "SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS idx, COUNT(*) OVER () AS n FROM calendar"
_FOLD = "SELECT idx, NTILE({k}) OVER (ORDER BY idx) - 1 AS g FROM days"


@query("cv_folds", "E19", with_ctes("calendar", body=f"WITH days AS ({_DAYS}) SELECT CAST(idx AS INTEGER) AS idx, CAST(g AS BIGINT) AS fold FROM ({_FOLD.format(k=7)}) z"))
def cv_folds(t: Tables) -> DataFrame:
    days, n = _samples(t)
    return folds(days.select("idx"), n, 7).withColumn("fold", F.col("fold").cast("bigint"))


@query(
    "cv_purged", "K3 C16 M15",
    with_ctes(
        "calendar",
        body=f"""WITH days AS ({_DAYS}), f AS ({_FOLD.format(k=5)}), b AS (SELECT g, MIN(idx) AS a, MAX(idx) AS z FROM f GROUP BY g)
 SELECT CAST(b.g AS INTEGER) AS split_id, CAST(f.idx AS INTEGER) AS idx, CASE WHEN f.g = b.g THEN 'test' ELSE 'train' END AS role
 FROM f, b WHERE f.g = b.g OR f.idx + 3 < b.a OR f.idx > b.z + 3 + 2""",
    ),
)
def cv_purged(t: Tables) -> DataFrame:
    days, n = _samples(t)
    return purged_kfold(days, n, n_splits=5, label_span=3, embargo=2)


def _combinatorial(t: Tables) -> DataFrame:
    days, n = _samples(t)
    return combinatorial_purged(days, n, n_groups=6, n_test_groups=2, label_span=3, embargo=2)


_CPCV = f"""WITH days AS ({_DAYS}), f AS ({_FOLD.format(k=6)}), b AS (SELECT g, MIN(idx) AS a, MAX(idx) AS z FROM f GROUP BY g),
 c AS (SELECT ROW_NUMBER() OVER (ORDER BY x.g, y.g) - 1 AS split_id, x.g AS g1, y.g AS g2, x.a AS a1, x.z AS z1, y.a AS a2, y.z AS z2 FROM b x JOIN b y ON x.g < y.g),
 r AS (SELECT split_id, idx, CASE WHEN f.g IN (g1, g2) THEN 'test' WHEN g2 = g1 + 1 AND (idx + 3 < a1 OR idx > z2 + 5) THEN 'train'
 WHEN g2 > g1 + 1 AND (idx + 3 < a1 OR idx > z1 + 5) AND (idx + 3 < a2 OR idx > z2 + 5) THEN 'train' END AS role FROM f, c)"""


@query(
    "cv_combinatorial", "K4",
    with_ctes("calendar", body=f"{_CPCV} SELECT CAST(split_id AS INTEGER) AS split_id, CAST(idx AS INTEGER) AS idx, role FROM r WHERE role IS NOT NULL"),
)
def cv_combinatorial(t: Tables) -> DataFrame:
    return _combinatorial(t)


@query(
    "cv_test_blocks", "E18",
    with_ctes(
        "calendar",
        body=f"""{_CPCV} SELECT CAST(split_id AS INTEGER) AS split_id, CAST(MIN(idx) AS INTEGER) AS first, CAST(MAX(idx) AS INTEGER) AS last FROM (
 SELECT split_id, idx, idx - ROW_NUMBER() OVER (PARTITION BY split_id ORDER BY idx) AS isl FROM r WHERE role = 'test') z GROUP BY split_id, isl""",
    ),
)
def cv_test_blocks(t: Tables) -> DataFrame:
    return contiguous_blocks(_combinatorial(t).where("role = 'test'"))


@query(
    "cv_disjoint", "G7",
    with_ctes(
        "calendar",
        body=f"""{_CPCV} SELECT CAST(split_id AS INTEGER) AS split_id, COUNT(DISTINCT CASE WHEN role = 'train' THEN idx END) AS n_train,
 COUNT(DISTINCT CASE WHEN role = 'test' THEN idx END) AS n_test, COUNT(role) - COUNT(DISTINCT CASE WHEN role IS NOT NULL THEN idx END) AS n_both
 FROM r GROUP BY split_id""",
    ),
)
def cv_disjoint(t: Tables) -> DataFrame:
    return overlap(_combinatorial(t))
