"""Target weights, covariance, trades and valued books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.functions.scalar import round_half_up, unrealised_pl
from pitlane.operators.asof import asof_join
from pitlane.operators.book import (
    CostAware, Costs, equity_curve, equity_of, fill_log, fold_rows, marked_positions, orders_by_status, positions,
    simulate,
)
from pitlane.operators.covariance import (
    cost_aware_inputs, expected_returns, return_windows,
)
from pitlane.operators.evaluation import metric_spread, rolling_windows
from pitlane.operators.frontier import basket_status, covariance_pairs, mean_variance_weights
from pitlane.operators.holdings import effective_holdings, scores_at, top_scored
from pitlane.operators.metrics import run_metrics
from pitlane.operators.universe import keep_members, members_on
from pitlane.operators.weights import (
    bad_weights, buy_and_hold, equal_weight, every_nth, momentum_at, momentum_table, momentum_weights, repeated_symbols, run_timeline,
    score_equal, score_proportional, trades,
)
from pitlane.plans.fixtures import Tables, with_ctes
from pitlane.plans.queries_joins import name_months
from pitlane.plans.queries_signals import WINDOWS_SQL, book
from pitlane.plans.queries_sources import r6, rounded
from pitlane.plans.registry import query
from pitlane.session import cut
from pitlane.sources.ledger import series_json, series_rows

EVERY, K, LOOKBACK = 21, 5, 20
COSTS = Costs(commission_per_share=0.005, slippage_bps=5.0)


def runs(t: Tables) -> DataFrame:
    """One run per two-year window."""
    return rolling_windows(t.spark, "1995-01-02", "2001-11-04", window_years=2, step_months=12).select(
        F.concat(F.lit("W"), F.col("window_id").cast("string")).alias("run_id"), "start", "end"
    )


RUNS_SQL = f"SELECT 'W' || window_id AS run_id, start, \"end\" FROM ({WINDOWS_SQL}) w"
TIMELINE_SQL = f'SELECT r.run_id, c.date, r.start, r."end" FROM ({RUNS_SQL}) r JOIN calendar c ON c.date BETWEEN r.start AND r."end"'
STEPS_SQL = f"SELECT * FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY date) - 1 AS step FROM ({TIMELINE_SQL}) t) s WHERE step % {EVERY} = 0"


def steps(t: Tables) -> DataFrame:
    return every_nth(run_timeline(runs(t), t.stored("calendar")), EVERY)


def symbols(t: Tables) -> DataFrame:
    """The basket of each run: the members on its first day."""
    on_day = members_on(runs(t), t.members, date="start").withColumnRenamed("date", "start")
    return runs(t).select("run_id", "start").join(on_day, "start").select("run_id", "ticker").distinct()


SYMBOLS_SQL = f"SELECT DISTINCT r.run_id, m.ticker FROM ({RUNS_SQL}) r JOIN members m ON m.start_date <= r.start AND (m.end_date IS NULL OR r.start <= m.end_date)"


@query(
    "rebalance_steps", "E8",
    with_ctes("calendar", body=f"SELECT run_id, date, CAST(step AS INTEGER) AS step FROM ({STEPS_SQL}) z"),
)
def rebalance_steps(t: Tables) -> DataFrame:
    return steps(t)


@query(
    "weights_buy_and_hold", "J1",
    with_ctes(
        "calendar", "members",
        body=f"""SELECT s.run_id, f.date, s.ticker, {r6('1.0::DOUBLE / COUNT(*) OVER (PARTITION BY s.run_id)')} AS weight
 FROM ({SYMBOLS_SQL}) s JOIN (SELECT run_id, MIN(date) AS date FROM ({TIMELINE_SQL}) t GROUP BY run_id) f ON s.run_id = f.run_id""",
    ),
)
def weights_buy_and_hold(t: Tables) -> DataFrame:
    return rounded(buy_and_hold(run_timeline(runs(t), t.calendar), symbols(t)), "weight")


@query(
    "weights_equal", "J2 M13",
    with_ctes(
        "calendar", "members",
        body=f"""SELECT s.run_id, k.date, s.ticker, {r6('1.0::DOUBLE / COUNT(*) OVER (PARTITION BY s.run_id, k.date)')} AS weight
 FROM ({SYMBOLS_SQL}) s JOIN ({STEPS_SQL}) k ON s.run_id = k.run_id""",
    ),
)
def weights_equal(t: Tables) -> DataFrame:
    return rounded(equal_weight(steps(t), symbols(t)), "weight")


_MOM = f"""SELECT ticker, date, LAG(close, 2) OVER w AS recent, LAG(close, {LOOKBACK + 2}) OVER w AS past, LAG(date, {LOOKBACK + 2}) OVER w AS past_date
 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""


@query(
    "momentum", "E5",
    with_ctes("bars", body=f"SELECT ticker, date, {r6('CASE WHEN past > 0 THEN (recent - past) / past END')} AS momentum FROM ({_MOM}) m"),
)
def momentum(t: Tables) -> DataFrame:
    return rounded(momentum_table(t.bars, lookback=LOOKBACK, skip=2).select("ticker", "date", "momentum"), "momentum")


@query(
    "momentum_asof", "E5 C1",
    with_ctes(
        "bars", "monthly",
        body=f"""SELECT ticker, date, {r6('mom')} AS momentum FROM (SELECT k.ticker, k.month AS date, CASE WHEN past > 0 THEN (recent - past) / past END AS mom
 FROM monthly k ASOF LEFT JOIN ({_MOM}) m ON k.ticker = m.ticker AND k.month >= m.date) z WHERE mom IS NOT NULL""",
    ),
)
def momentum_asof(t: Tables) -> DataFrame:
    return rounded(momentum_at(name_months(t), t.bars, lookback=LOOKBACK, skip=2), "momentum")


_MOM0 = _MOM.replace("LAG(close, 2) OVER w AS recent", "close AS recent").replace(str(LOOKBACK + 2), str(LOOKBACK))


@query(
    "weights_momentum", "J3 F2",
    with_ctes(
        "calendar", "members", "bars",
        body=f"""SELECT run_id, date, ticker, {r6('1.0::DOUBLE / COUNT(*) OVER (PARTITION BY run_id, date)')} AS weight FROM (
 SELECT z.*, ROW_NUMBER() OVER (PARTITION BY run_id, date ORDER BY mom DESC, ticker) AS rn FROM (
 SELECT q.run_id, q.date, q.ticker, CASE WHEN past > 0 AND past_date >= q.start THEN (recent - past) / past END AS mom FROM (
 SELECT s.ticker, k.* FROM ({SYMBOLS_SQL}) s JOIN ({STEPS_SQL}) k ON s.run_id = k.run_id) q
 ASOF LEFT JOIN ({_MOM0}) m ON q.ticker = m.ticker AND q.date >= m.date) z WHERE mom IS NOT NULL) r WHERE rn <= {K}""",
    ),
)
def weights_momentum(t: Tables) -> DataFrame:
    rebalances = steps(t).select("run_id", "date").join(runs(t).select("run_id", "start"), "run_id")
    return rounded(momentum_weights(rebalances, symbols(t), t.bars, lookback=LOOKBACK, k=K), "weight")


def picks(t: Tables, k: int = K) -> DataFrame:
    """Top scored members at each rebalance of each run."""
    days = steps(t).select("date").distinct()
    best = top_scored(scores_at(days, t.scores, t.stored("members")), k)
    return steps(t).select("run_id", "date").join(best, "date").join(runs(t).select("run_id", "start"), "run_id")


_PICKS = f"""SELECT k.run_id, k.date, b.ticker, b.score FROM ({STEPS_SQL}) k JOIN (
 SELECT * FROM (SELECT z.*, ROW_NUMBER() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM (
 SELECT m.ticker, m.date, s.score FROM (SELECT DISTINCT x.ticker, d.date FROM (SELECT DISTINCT date FROM ({STEPS_SQL}) y) d JOIN members x
 ON x.start_date <= d.date AND (x.end_date IS NULL OR d.date <= x.end_date)) m
 ASOF LEFT JOIN scores s ON m.ticker = s.ticker AND m.date >= s.date) z WHERE score IS NOT NULL) r WHERE rank <= {K}) b ON k.date = b.date"""


@query(
    "weights_score_equal", "J5 E4",
    with_ctes(
        "calendar", "members", "scores",
        body=f"SELECT run_id, date, ticker, {r6('1.0::DOUBLE / COUNT(*) OVER (PARTITION BY run_id, date)')} AS weight FROM ({_PICKS}) p",
    ),
)
def weights_score_equal(t: Tables) -> DataFrame:
    return rounded(score_equal(picks(t)), "weight")


@query(
    "weights_score_proportional", "J6 H7",
    with_ctes(
        "calendar", "members", "scores",
        body=f"""SELECT run_id, date, ticker, {r6('w')} AS weight FROM (SELECT p.*, CASE WHEN tot IS NULL THEN FLOOR(1000000 / n) / 1000000.0::DOUBLE
 WHEN s6 > 0 THEN CAST(s6 * 1000000 // tot AS DOUBLE) / 1000000.0::DOUBLE END AS w FROM (
 SELECT q.*, CAST(ROUND(score * 1000000) AS BIGINT) AS s6, SUM(CASE WHEN score > 0 THEN CAST(ROUND(score * 1000000) AS BIGINT) END) OVER (PARTITION BY run_id, date) AS tot, COUNT(*) OVER (PARTITION BY run_id, date) AS n
 FROM ({_PICKS}) q) p) z WHERE w > 0""",
    ),
)
def weights_score_proportional(t: Tables) -> DataFrame:
    return rounded(score_proportional(picks(t)), "weight")


_NAMEW = "SELECT ticker AS run_id, month AS date, ticker, CAST(n_rows AS DOUBLE) / 12 - 0.2 AS weight FROM monthly"


@query(
    "weights_rejected", "J8",
    with_ctes(
        "monthly",
        body=f"SELECT run_id, date, {r6('MIN(weight)')} AS lowest, {r6('SUM(weight)')} AS total FROM ({_NAMEW}) w GROUP BY run_id, date HAVING MIN(weight) < 0 OR SUM(weight) > 1 + 1e-9",
    ),
)
def weights_rejected(t: Tables) -> DataFrame:
    w = t.monthly.selectExpr("ticker AS run_id", "month AS date", "ticker", "CAST(n_rows AS DOUBLE) / 12 - 0.2 AS weight")
    return rounded(bad_weights(w), "lowest", "total")


@query(
    "symbols_repeated", "J9",
    with_ctes("members", body="SELECT 'index' AS run_id, ticker, COUNT(*) AS n FROM members GROUP BY ticker HAVING COUNT(*) > 1"),
)
def symbols_repeated(t: Tables) -> DataFrame:
    """Names with several spells in the index: as one basket of all spells they would be listed twice."""
    return repeated_symbols(t.members.select(F.lit("index").alias("run_id"), "ticker"))


@query(
    "effective_holdings", "D34",
    with_ctes(
        "monthly",
        body=f"""SELECT CAST(YEAR(month) AS VARCHAR) AS run_id, {r6('AVG(e)')} AS effective_holdings, COUNT(*) AS n_rebalances FROM (
 SELECT month, 1.0::DOUBLE / SUM(w * w) AS e FROM (SELECT month, marketcap / SUM(marketcap) OVER (PARTITION BY month) AS w FROM monthly) a GROUP BY month) b
 GROUP BY 1""",
    ),
)
def effective_holdings_query(t: Tables) -> DataFrame:
    totals = t.monthly.groupBy("month").agg(F.sum("marketcap").alias("total"))
    w = t.monthly.join(totals, "month").select(
        F.year("month").cast("string").alias("run_id"), F.col("month").alias("date"),
        (F.col("marketcap") / F.col("total")).alias("weight"),
    )
    return rounded(effective_holdings(w), "effective_holdings")


@query(
    "rebalance_trades", "J10 C12 G2 B16 H13",
    with_ctes(
        "book", "monthly",
        body=f"""SELECT run_id, date, ticker, CASE WHEN delta < 0 THEN 'sell' ELSE 'buy' END AS side, {r6('ABS(delta)')} AS qty,
 CAST(CASE WHEN delta > 0 THEN 1 ELSE 0 END AS INTEGER) AS side_order FROM (
 SELECT 'B' AS run_id, z.date, z.ticker, 100000.0::DOUBLE * 0.98::DOUBLE * COALESCE(w, 0) / m.close - COALESCE(qty, 0) AS delta, m.close FROM (
 SELECT COALESCE(a.date, h.date) AS date, COALESCE(a.ticker, h.ticker) AS ticker, a.w, h.qty FROM (
 SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS date, ticker, 0.2::DOUBLE AS w FROM book) a
 FULL JOIN (SELECT month AS date, ticker, 1.0::DOUBLE AS qty FROM monthly WHERE n_rows >= 9) h ON a.date = h.date AND a.ticker = h.ticker) z
 JOIN monthly m ON m.ticker = z.ticker AND m.month = z.date) d WHERE ABS(delta) * close >= 500 AND delta <> 0""",
    ),
)
def rebalance_trades(t: Tables) -> DataFrame:
    targets = book(t).select(
        F.lit("B").alias("run_id"), F.trunc("date", "month").alias("date"), "ticker", F.lit(0.2).alias("weight")
    )
    months = t.monthly
    held = months.where("n_rows >= 9").select(
        F.lit("B").alias("run_id"), F.col("month").alias("date"), "ticker", F.lit(1.0).alias("qty")
    )
    equity = months.select(F.lit("B").alias("run_id"), F.col("month").alias("date")).distinct().withColumn(
        "equity", F.lit(100000.0)
    )
    closes = months.select("ticker", F.col("month").alias("date"), "close")
    return rounded(trades(targets, held, equity, closes, min_notional=500.0), "qty")


# Return windows and covariance on monthly closes, for each month's members.


def month_bars(t: Tables) -> DataFrame:
    return t.monthly.select("ticker", F.col("month").alias("date"), "close")


_WIN = f"""SELECT ticker, date, rets FROM (SELECT ticker, month AS date,
 LIST(r) OVER (PARTITION BY ticker ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS rets, COUNT(r) OVER (PARTITION BY ticker ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS n
 FROM (SELECT ticker, month, close / LAG(close) OVER (PARTITION BY ticker ORDER BY month) - 1 AS r FROM monthly) q) z WHERE n = 12"""


_MEMBER_WIN = f"""SELECT x.* FROM ({_WIN}) x WHERE EXISTS (SELECT 1 FROM members m WHERE m.ticker = x.ticker
 AND m.start_date <= x.date AND (m.end_date IS NULL OR x.date <= m.end_date))"""


def basket_windows(t: Tables) -> DataFrame:
    keys = t.monthly.select(F.lit("B").alias("run_id"), F.col("month").alias("date"), "ticker")
    return cut(return_windows(keep_members(keys, t.members), month_bars(t), lookback=12))


@query(
    "return_windows", "E15 D41",
    with_ctes(
        "monthly",
        body=f"SELECT ticker, date, {r6('LIST_AVG(rets)')} AS mu, {r6('rets[1]')} AS oldest, {r6('rets[12]')} AS newest FROM ({_WIN}) w",
    ),
)
def return_windows_query(t: Tables) -> DataFrame:
    keys = name_months(t).withColumn("run_id", F.lit("B"))
    wins = return_windows(keys, month_bars(t), lookback=12)
    mean = F.aggregate("rets", F.lit(0.0), lambda a, x: a + x) / F.size("rets")
    out = wins.select("ticker", "date", mean.alias("mu"), F.col("rets")[0].alias("oldest"), F.col("rets")[11].alias("newest"))
    return rounded(out, "mu", "oldest", "newest")


@query(
    "covariance", "D40 C18 D4",
    with_ctes(
        "monthly", "members",
        body=f"""WITH w AS ({_MEMBER_WIN}),
 p AS (SELECT date, ticker, ROW_NUMBER() OVER (PARTITION BY date ORDER BY ticker) - 1 AS pos, COUNT(*) OVER (PARTITION BY date) AS n, rets FROM w),
 l AS (SELECT date, pos, n, k, rets[k] AS r FROM p, range(1, 13) g(k))
 SELECT 'B' AS run_id, a.date, a.pos AS i, CAST(b.pos AS INTEGER) AS j, {r6('COVAR_SAMP(a.r, b.r) + CASE WHEN a.pos = b.pos THEN 1e-6 ELSE 0 END')} AS cov
 FROM l a JOIN l b ON a.date = b.date AND a.k = b.k AND a.pos <= b.pos WHERE a.n >= 2 GROUP BY a.date, a.pos, b.pos""",
    ),
)
def covariance(t: Tables) -> DataFrame:
    return rounded(covariance_pairs(basket_windows(t), ridge=1e-6), "cov")


@query("weights_min_variance", "J4 D40 D41 H7")
def weights_min_variance(t: Tables) -> DataFrame:
    return mean_variance_weights(basket_windows(t), mode="min_var")


_SOLVED = f"""WITH w AS ({_MEMBER_WIN})
 SELECT 'B' AS run_id, date, COUNT(*) AS n_names, TRUE AS converged, TRUE AS sums_to_one, TRUE AS long_only, TRUE AS optimal
 FROM w GROUP BY date HAVING COUNT(*) >= 2"""


@query("min_variance_optimal", "J4 D40", with_ctes("monthly", "members", body=_SOLVED))
def min_variance_optimal(t: Tables) -> DataFrame:
    """Every rebalance has weights; they sum to one, none is negative, and no name could lower the variance."""
    return basket_status(basket_windows(t), mode="min_var")


@query("weights_mean_variance", "J4")
def weights_mean_variance(t: Tables) -> DataFrame:
    return mean_variance_weights(basket_windows(t), mode="mean_var", risk_aversion=3.0)


@query("mean_variance_optimal", "J4 D40", with_ctes("monthly", "members", body=_SOLVED))
def mean_variance_optimal(t: Tables) -> DataFrame:
    """The same of the weights that trade mean return against variance."""
    return basket_status(basket_windows(t), mode="mean_var", risk_aversion=3.0)


@query(
    "score_expected_returns", "E9",
    with_ctes(
        "book",
        body=f"SELECT date, ticker, {r6('CASE WHEN sd > 0 THEN 0.05::DOUBLE * (score - m) / sd ELSE 0 END')} AS mu FROM (SELECT date, ticker, score, AVG(score) OVER (PARTITION BY date) AS m, STDDEV_POP(score) OVER (PARTITION BY date) AS sd FROM book) z",
    ),
)
def score_expected_returns(t: Tables) -> DataFrame:
    out = expected_returns(cut(book(t)), by=("date",)).select("date", "ticker", "mu")
    return rounded(out, "mu")


# Valued books.


def _hold_run(t: Tables) -> tuple[DataFrame, DataFrame]:
    spell = t.spark.range(1).select(
        F.lit("H").alias("run_id"), F.lit("1996-01-01").cast("date").alias("start"),
        F.lit("1999-12-31").cast("date").alias("end"),
    )
    names = t.members.where("start_date <= DATE '1996-01-01' AND (end_date IS NULL OR end_date >= DATE '1996-01-01')")
    basket = names.select("ticker").distinct().join(
        t.stored("bars").groupBy("ticker").agg(F.min(F.when(F.col("date") >= "1996-01-01", F.col("date"))).alias("_f"),
                                     F.max("date").alias("_l")).where("_f = DATE '1996-01-01'"), "ticker", "left_semi"
    )
    return spell, basket.select(F.lit("H").alias("run_id"), "ticker")


# A free book bought once, in order of fills: a buy that costs more than the cash there is fails. A name whose bars end
# is sold at its last close on the next market day. The cash goes through all events one after the other.
_HOLD = """WITH RECURSIVE basket AS (SELECT DISTINCT m.ticker FROM members m JOIN bars b ON b.ticker = m.ticker AND b.date = DATE '1996-01-01'
 WHERE m.start_date <= DATE '1996-01-01' AND (m.end_date IS NULL OR m.end_date >= DATE '1996-01-01')),
 win AS (SELECT * FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
 nxt AS (SELECT ticker, MIN(date) AS fd FROM win WHERE date > DATE '1996-01-01' GROUP BY ticker),
 lst AS (SELECT ticker, MAX(date) AS ld FROM win GROUP BY ticker),
 gone AS (SELECT ld, MIN(date) AS gd FROM (SELECT DISTINCT ld FROM lst) e JOIN (SELECT DISTINCT date FROM win) d ON d.date > e.ld GROUP BY ld),
 asked AS (SELECT k.ticker, 50000.0::DOUBLE * (1.0::DOUBLE / (SELECT COUNT(*) FROM basket)) / c.close AS qty, o.open AS price, x.fd,
 g.gd, f.close AS lc FROM basket k JOIN win c ON c.ticker = k.ticker AND c.date = DATE '1996-01-01' JOIN nxt x ON x.ticker = k.ticker
 JOIN win o ON o.ticker = k.ticker AND o.date = x.fd JOIN lst e ON e.ticker = k.ticker JOIN win f ON f.ticker = k.ticker AND f.date = e.ld
 LEFT JOIN gone g ON g.ld = e.ld),
 events AS (SELECT z.*, ROW_NUMBER() OVER (ORDER BY date, leaves, ticker) AS i FROM (
 SELECT ticker, fd AS date, FALSE AS leaves, price * qty AS amount FROM asked UNION ALL
 SELECT ticker, gd AS date, TRUE AS leaves, qty * lc AS amount FROM asked WHERE gd IS NOT NULL) z),
 walk AS (SELECT 0::BIGINT AS i, 100000.0::DOUBLE AS cash, CAST([] AS VARCHAR[]) AS failed UNION ALL
 SELECT v.i, CASE WHEN v.leaves THEN CASE WHEN list_contains(w.failed, v.ticker) THEN w.cash ELSE w.cash + v.amount END
 WHEN v.amount > w.cash THEN w.cash ELSE w.cash - v.amount END,
 CASE WHEN NOT v.leaves AND v.amount > w.cash THEN list_append(w.failed, v.ticker) ELSE w.failed END
 FROM walk w JOIN events v ON v.i = w.i + 1),
 bought AS (SELECT a.* FROM asked a WHERE a.ticker NOT IN (SELECT UNNEST(failed) FROM (SELECT failed FROM walk ORDER BY i DESC LIMIT 1) l)),
 days AS (SELECT date FROM calendar WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
 flows AS (SELECT d.date, COALESCE(c.cash, 100000.0::DOUBLE) AS cash FROM days d ASOF LEFT JOIN (
 SELECT v.date, ARG_MAX(w.cash, w.i) AS cash FROM walk w JOIN events v ON v.i = w.i GROUP BY v.date) c ON d.date >= c.date),
 marks AS (SELECT q.date, SUM(q.qty * w.close) AS mv FROM (SELECT d.date, b.ticker, b.qty FROM days d, bought b
 WHERE b.fd <= d.date AND (b.gd IS NULL OR d.date < b.gd)) q ASOF JOIN win w ON q.ticker = w.ticker AND q.date >= w.date GROUP BY q.date)"""


def _hold_book(t: Tables) -> tuple[DataFrame, DataFrame]:
    spell, basket = _hold_run(t)
    timeline = run_timeline(spell, t.stored("calendar"))
    targets = cut(buy_and_hold(timeline, basket))
    # Half the cash is kept back; where the next open is far above the close, a buy can still cost more than is left.
    return spell, cut(simulate(fold_rows(spell, targets, t.stored("bars")), costs=Costs(cash_buffer=0.5)))


@query(
    "buy_and_hold_equity", "J11 J12 J13 D42 E17 C3",
    with_ctes(
        "members", "bars", "calendar",
        body=f"""SELECT * FROM ({_HOLD} SELECT 'H' AS run_id, f.date AS ts, FLOOR((f.cash + COALESCE(m.mv, 0)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS equity
 FROM flows f LEFT JOIN marks m ON f.date = m.date) h""",
    ),
)
def buy_and_hold_equity(t: Tables) -> DataFrame:
    spell, ledger = _hold_book(t)
    out = equity_curve(ledger, spell, t.stored("calendar"), t.stored("bars"))
    return out.withColumn("equity", round_half_up("equity", 2))


@query(
    "buy_and_hold_fills", "J11 J14 B17 M12",
    with_ctes(
        "members", "bars", "calendar",
        body=f"SELECT * FROM ({_HOLD} SELECT ticker, fd AS date, 'buy' AS side, {r6('qty')} AS qty, {r6('price')} AS price FROM bought) h",
    ),
)
def buy_and_hold_fills(t: Tables) -> DataFrame:
    _, ledger = _hold_book(t)
    return rounded(fill_log(ledger).select("ticker", "date", "side", "qty", "price"), "qty", "price")


def score_book(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Top-K score books of all windows, with costs."""
    r = runs(t)
    return r, cut(simulate(fold_rows(r, cut(score_equal(picks(t))), t.stored("bars")), costs=COSTS))


@query("book_ledger", "J11 J13 J14 B17 K2")
def book_ledger(t: Tables) -> DataFrame:
    return score_book(t)[1]


@query("book_positions", "H14 M12 J12")
def book_positions(t: Tables) -> DataFrame:
    r, ledger = score_book(t)
    return marked_positions(positions(ledger), run_timeline(r, t.stored("calendar")), t.stored("bars"), r)


@query("book_equity", "J12 C15 D42 K2")
def book_equity(t: Tables) -> DataFrame:
    r, ledger = score_book(t)
    return equity_curve(ledger, r, t.stored("calendar"), t.stored("bars"), benchmark=t.benchmark_levels)


@query("book_evaluation", "K2 D22 D21 D19 K11")
def book_evaluation(t: Tables) -> DataFrame:
    r, ledger = score_book(t)
    curve = cut(equity_curve(ledger, r, t.stored("calendar"), t.stored("bars"), benchmark=t.benchmark_levels))
    wide = run_metrics(curve, fill_log(ledger)).join(r, "run_id").withColumn("strategy", F.lit("score_top_k"))
    return metric_spread(wide)


@query("book_orders_rejected", "B17")
def book_orders_rejected(t: Tables) -> DataFrame:
    _, ledger = score_book(t)
    return orders_by_status(ledger, "rejected")


@query("book_cost_aware", "J7 E9 E20 D40")
def book_cost_aware(t: Tables) -> DataFrame:
    r = runs(t)
    inputs = cut(cost_aware_inputs(picks(t), t.stored("bars"), lookback=LOOKBACK))
    ledger = simulate(fold_rows(r, inputs, t.stored("bars")), costs=COSTS, choice=CostAware(max_weight=0.5))
    return fill_log(ledger)


@query(
    "position_profit", "H14",
    with_ctes(
        "bars",
        body=f"SELECT ticker, date, {r6('(close - open) * volume')} AS profit, {r6('volume * close')} AS value FROM bars",
    ),
)
def position_profit(t: Tables) -> DataFrame:
    out = t.bars.select(
        "ticker", "date", unrealised_pl("volume", "open", "close").alias("profit"),
        (F.col("volume") * F.col("close")).alias("value"),
    )
    return rounded(out, "profit", "value")


@query(
    "equity_of_holdings", "D42",
    with_ctes(
        "monthly",
        body="""SELECT ticker AS run_id, month AS date, FLOOR((1000 + close * n_rows) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS equity FROM monthly""",
    ),
)
def equity_of_holdings(t: Tables) -> DataFrame:
    cash = t.monthly.select(F.col("ticker").alias("run_id"), F.col("month").alias("date"), F.lit(1000.0).alias("cash"))
    marked = t.monthly.select(
        F.col("ticker").alias("run_id"), F.col("month").alias("date"), (F.col("close") * F.col("n_rows")).alias("market_value")
    )
    return equity_of(cash, marked).withColumn("equity", round_half_up("equity", 4))


@query(
    "series_round_trip", "A28",
    with_ctes(
        "monthly",
        body="""SELECT m.ticker AS run_id, CAST(m.month AS TIMESTAMP) AS ts, m.marketcap AS equity,
 CAST(CASE WHEN 2 * (s % n) > n OR (2 * (s % n) = n AND (s // n) % 2 = 1) THEN s // n + 1 ELSE s // n END AS DOUBLE) / 100 AS level
 FROM monthly m ASOF LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS s, COUNT(*) AS n
 FROM orders GROUP BY 1) b ON m.month >= b.date""",
    ),
)
def series_round_trip(t: Tables) -> DataFrame:
    curves = t.monthly.select(F.col("ticker").alias("run_id"), F.col("month").alias("ts"), F.col("marketcap").alias("equity"))
    levels = t.benchmark_levels.select(F.col("date").alias("ld"), "level")
    dated = curves.join(asof_join(curves.select("ts").distinct(), levels, [], "ts", "ld", ["level"]), "ts")
    return series_rows(series_json(dated))
