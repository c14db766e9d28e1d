"""Market-shaped tables derived from the given order tables.

Suppliers stand for listed names, their order lines for trades: bars per day,
filings per quarter, market values, index actions. Each derivation is given
twice from the same aggregate expressions: as DataFrames, and as SQL common
table expressions for the twin queries. All sums are over integers (cents,
percent, units), so no result depends on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.session import cut, parts

# One line of the order table as integers.
LINE = {
    "ticker": "CONCAT('S', CAST(l_suppkey AS STRING))",
    "suppkey": "CAST(l_suppkey AS BIGINT)",
    "date": "CAST(l_shipdate AS DATE)",
    "q": "CAST(l_quantity AS BIGINT)",
    "c": "CAST(ROUND(l_extendedprice * 100) AS BIGINT)",
    "dp": "CAST(ROUND(l_discount * 100) AS BIGINT)",
    "tp": "CAST(ROUND(l_tax * 100) AS BIGINT)",
    "ln": "CAST(l_linenumber AS BIGINT)",
    "flag": "l_returnflag",
    "status": "l_linestatus",
    "px": "l_extendedprice / l_quantity",
    "orderkey": "CAST(l_orderkey AS BIGINT)",
}


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


BAR = {
    "suppkey": "MAX(suppkey)",
    "low": "MIN(px)",
    "high": "MAX(px)",
    "close": f"{_d('SUM(c)')} / 100 / {_d('SUM(q)')}",
    "open": f"MIN(px) + (MAX(px) - MIN(px)) * {_d('MIN(ln)')} / 8",
    "volume": _d("SUM(q)"),
    "n_rows": "COUNT(*)",
}
MONTH = {
    "date": "MAX(date)",
    "close": f"{_d('SUM(c)')} / 100 / {_d('SUM(q)')}",
    "marketcap": f"{_d('SUM(c)')} / 100",
    "score": f"CAST(FLOOR((5 - {_d('SUM(dp)')} / {_d('COUNT(*)')}) * 10000 + 0.5) AS DOUBLE) / 1000000",
    "n_rows": "COUNT(*)",
}

# Filing fields: eighteen levels, fifteen ratios and the interest expense.
LEVELS = {
    "revenue": f"{_d('SUM(c)')} / 100",
    "gp": f"{_d('SUM(c * (100 - dp))')} / 10000",
    "opinc": f"{_d('SUM(c * (60 - dp - tp))')} / 10000",
    "ebit": f"{_d('SUM(c * (55 - dp - tp))')} / 10000",
    "netinc": f"CASE WHEN COUNT(*) >= 3 THEN {_d('SUM(c * (5 - dp))')} / 10000 END",
    "ebitda": f"{_d('SUM(c * (70 - dp))')} / 10000",
    "eps": f"{_d('SUM(c * (5 - dp))')} / 10000 / {_d('SUM(q)')}",
    "epsdil": f"{_d('SUM(c * (5 - dp))')} / 10000 / {_d('SUM(q) + COUNT(*)')}",
    "assets": _d("SUM(q) * 1000"),
    "liabilities": _d("SUM(q * (20 + dp * 8)) * 10"),
    "equity": _d("SUM(q * (80 - dp * 8 - tp * 8)) * 10"),
    "debt": _d("SUM(q * (dp + tp)) * 50"),
    "cashneq": _d("SUM(q * tp) * 40"),
    "workingcapital": _d("SUM(q * (tp - dp)) * 30"),
    "fcf": f"{_d('SUM(c * (4 - tp))')} / 10000",
    "ncfo": f"{_d('SUM(c * (8 - tp))')} / 10000",
    "capex": f"{_d('SUM(c * tp)')} / -10000",
    "rnd": f"CASE WHEN MIN(tp) > 0 THEN {_d('SUM(c * tp)')} / 20000 ELSE {_d('0')} END",
}
RATIOS = {
    "roe": f"CASE WHEN COUNT(*) >= 2 THEN {_d('SUM(c * (5 - dp))')} / 10000 / {_d('SUM(q) * 500')} END",
    "roa": f"{_d('SUM(c * (5 - dp))')} / 10000 / {_d('SUM(q) * 1000')}",
    "roic": f"{_d('SUM(c * (6 - dp))')} / 10000 / {_d('SUM(q) * 700')}",
    "ros": f"{_d('SUM(c * (55 - dp - tp))')} / 100 / {_d('SUM(c)')}",
    "grossmargin": f"{_d('SUM(c * (100 - dp))')} / 100 / {_d('SUM(c)')}",
    "netmargin": f"{_d('SUM(c * (5 - dp))')} / 100 / {_d('SUM(c)')}",
    "ebitdamargin": f"{_d('SUM(c * (70 - dp))')} / 100 / {_d('SUM(c)')}",
    "assetturnover": f"{_d('SUM(c)')} / 100 / {_d('SUM(q) * 1000')}",
    "currentratio": f"{_d('SUM(q * tp) + 100')} / {_d('SUM(q * dp) + 50')}",
    "de": f"CASE WHEN COUNT(*) >= 2 THEN {_d('SUM(q * (20 + dp * 8))')} / {_d('SUM(q) * 100')} END",
    "payoutratio": f"CASE WHEN MIN(dp) = 0 THEN {_d('0')} ELSE {_d('SUM(dp)')} / {_d('COUNT(*)')} / 10 END",
    "divyield": f"{_d('MIN(dp)')} / 100",
    "bvps": f"{_d('SUM(q * (80 - dp * 8 - tp * 8)) * 10')} / {_d('SUM(q)')}",
    "sps": f"{_d('SUM(c)')} / 100 / {_d('SUM(q)')}",
    "fcfps": f"{_d('SUM(c * (4 - tp))')} / 10000 / {_d('SUM(q)')}",
}
FIELDS = {**LEVELS, **RATIOS, "intexp": _d("SUM(q * dp) * 3")}

DIMENSION = "CASE flag WHEN 'A' THEN 'ARQ' WHEN 'N' THEN 'ART' ELSE 'ARY' END"
FILED = "CAST(DATE_TRUNC('quarter', date) + INTERVAL '135' DAY AS DATE)"


def _list(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def _vc(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


SPELLS = """(SELECT ticker, start_date, CASE WHEN rem IS NOT NULL THEN CAST(rem - INTERVAL '1' DAY AS DATE) END AS end_date
 FROM (
  SELECT ticker, spell, MIN(CASE WHEN opens = 1 THEN date END) AS start_date, MIN(CASE WHEN closes = 1 THEN date END) AS rem
  FROM (SELECT m.*, SUM(opens) OVER (PARTITION BY ticker ORDER BY date, action ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell
        FROM (SELECT e.*, CASE WHEN action = 'added' AND (prev IS NULL OR prev = 'removed') THEN 1 ELSE 0 END AS opens,
                     CASE WHEN action = 'removed' AND prev = 'added' THEN 1 ELSE 0 END AS closes
              FROM (SELECT ticker, date, action, LAG(action) OVER (PARTITION BY ticker ORDER BY date, action) AS prev,
                           MAX(CASE WHEN action = 'added' THEN 1 ELSE 0 END) OVER (PARTITION BY ticker) AS has_add
                    FROM {src} WHERE action IN ('added', 'removed')) e) m) g
  WHERE has_add = 1 AND spell > 0 GROUP BY ticker, spell
  UNION ALL
  SELECT r.ticker, 0, i.inception, r.date FROM {src} r, (SELECT MIN(date) AS inception FROM {src} WHERE action IN ('added', 'removed')) i
  WHERE r.action = 'removed' AND r.ticker NOT IN (SELECT ticker FROM {src} WHERE action = 'added')) s
 WHERE rem IS NULL OR CAST(rem - INTERVAL '1' DAY AS DATE) >= start_date)"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "line": ((), f"SELECT {_list(LINE)} FROM lineitem"),
    "bar0": (("line",), f"SELECT ticker, date, {_list(BAR)} FROM line GROUP BY ticker, date"),
    "bars": (
        ("bar0",),
        "SELECT ticker, date, open, high, low, close, "
        "close * CAST(100 - suppkey % 5 AS DOUBLE) / 100 AS closeadj, close * 2 AS closeunadj, volume, n_rows FROM bar0",
    ),
    "monthly": (
        ("line",),
        f"SELECT ticker, CAST(DATE_TRUNC('month', date) AS DATE) AS month, {_list(MONTH)} "
        "FROM line GROUP BY ticker, CAST(DATE_TRUNC('month', date) AS DATE)",
    ),
    "filings": (
        ("line",),
        f"SELECT ticker, {DIMENSION} AS dimension, {FILED} AS datekey, MAX(date) AS lastupdated, {_list(FIELDS)} "
        f"FROM line GROUP BY ticker, {DIMENSION}, {FILED}",
    ),
    "filings_raw": (
        ("line",),
        f"SELECT ticker, {DIMENSION} AS dimension, {FILED} AS datekey, status, MAX(date) AS lastupdated, "
        f"{LEVELS['revenue']} AS revenue, {LEVELS['netinc']} AS netinc "
        f"FROM line GROUP BY ticker, {DIMENSION}, {FILED}, status",
    ),
    "caps": (("bars",), "SELECT ticker, date, close * volume * 1000 AS marketcap FROM bars"),
    "calendar": (("line",), "SELECT DISTINCT date FROM line"),
    "month_ends": (
        ("calendar",),
        "SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS month, MAX(date) AS date FROM calendar "
        "GROUP BY CAST(DATE_TRUNC('month', date) AS DATE)",
    ),
    "scores": (
        ("monthly", "month_ends"),
        "SELECT e.date, m.ticker, m.score FROM monthly m JOIN month_ends e ON m.month = e.month",
    ),
    "actions": (
        (),
        "SELECT CONCAT('U', CAST(user_id AS STRING)) AS ticker, CAST(ts AS DATE) AS date, "
        "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'current' END AS action "
        "FROM events WHERE event_type IN ('signup', 'error') "
        "OR (event_type = 'purchase' AND CAST(ts AS DATE) >= DATE '2024-01-28') GROUP BY 1, 2, 3",
    ),
    "index_actions": (
        ("line",),
        "SELECT ticker, date, CASE WHEN flag = 'A' THEN 'added' ELSE 'removed' END AS action FROM line "
        "WHERE (flag = 'A' AND dp >= 5) OR (flag = 'R' AND dp >= 8) GROUP BY 1, 2, 3",
    ),
    "members": (("index_actions",), "SELECT * FROM " + SPELLS.format(src="index_actions")),
    "benchmark_levels": (
        (),
        "SELECT CAST(o_orderdate AS DATE) AS date, "
        "CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / CAST(COUNT(*) AS DOUBLE) AS level "
        "FROM orders GROUP BY 1",
    ),
    "sectors": (
        (),
        "SELECT CONCAT('S', CAST(s_suppkey AS STRING)) AS ticker, n_name AS sector "
        "FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 11 <> 0",
    ),
    "tickers": (
        ("line",),
        "SELECT t.ticker, k.tab AS \"table\", t.category, t.sector, b.firstpricedate, b.lastpricedate FROM ("
        "SELECT CONCAT('S', CAST(s_suppkey AS STRING)) AS ticker, CASE s_suppkey % 3 WHEN 0 THEN 'Domestic Common Stock' "
        "WHEN 1 THEN 'Domestic Common Stock Primary Class' ELSE 'ADR Common Stock' END AS category, "
        "CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey) t "
        "CROSS JOIN (VALUES ('SF1'), ('SEP')) k(tab) "
        "LEFT JOIN (SELECT ticker, MIN(date) AS firstpricedate, "
        "CASE WHEN MAX(date) < DATE '2001-10-15' THEN MAX(date) END AS lastpricedate FROM line GROUP BY ticker) b "
        "ON t.ticker = b.ticker",
    ),
}

# Twins of the larger plans, in SQL only.
CTES["members_at"] = (
    ("members", "month_ends"),
    "SELECT DISTINCT m.ticker, e.date FROM month_ends e JOIN members m "
    "ON m.start_date <= e.date AND (m.end_date IS NULL OR e.date <= m.end_date)",
)
CTES["capped"] = (
    ("members_at", "caps"),
    "SELECT ticker, date, marketcap FROM (SELECT k.ticker, k.date, c.marketcap, c.date AS cd FROM members_at k "
    "ASOF LEFT JOIN caps c ON k.ticker = c.ticker AND k.date >= c.date) z WHERE date - cd <= 10 AND marketcap > 0",
)
_LAGS = ("gp", "assets", "roa", "grossmargin", "assetturnover", "de", "currentratio", "revenue", "eps")


def _div(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({n}) / {d} END"


DERIVED_SQL = {
    "gross_profitability": _div("gp", "assets"),
    "fcf_to_assets": _div("fcf", "assets"),
    "debt_to_assets": _div("debt", "assets"),
    "cash_to_assets": _div("cashneq", "assets"),
    "interest_coverage": _div("ebit", "intexp"),
    "accruals_to_assets": _div("netinc - ncfo", "assets"),
    "delta_roa": "roa - p_roa",
    "delta_gross_profitability": f"{_div('gp', 'assets')} - {_div('p_gp', 'p_assets')}",
    "delta_grossmargin": "grossmargin - p_grossmargin",
    "delta_assetturnover": "assetturnover - p_assetturnover",
    "delta_debt_to_equity": "de - p_de",
    "delta_currentratio": "currentratio - p_currentratio",
    "revenue_growth": f"{_div('revenue', 'p_revenue')} - 1",
    "eps_change": "eps - p_eps",
}
CTES["art"] = (("filings",), "SELECT * FROM filings WHERE dimension = 'ART'")
CTES["features"] = (
    ("capped", "art"),
    f"SELECT ticker, date, marketcap, {', '.join([*LEVELS, *RATIOS])}, {_list(DERIVED_SQL)} FROM ("
    f"SELECT n.*, {', '.join(f'g.{c} AS p_{c}' for c in _LAGS)} FROM ("
    f"SELECT k.ticker, k.date, k.marketcap, CAST(k.date - INTERVAL '365' DAY AS DATE) AS then_date, "
    f"{', '.join(f'f.{c}' for c in FIELDS)} FROM capped k ASOF LEFT JOIN art f ON k.ticker = f.ticker AND k.date >= f.datekey) n "
    "ASOF LEFT JOIN art g ON n.ticker = g.ticker AND n.then_date >= g.datekey) w",
)
_KNOWN = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in [*LEVELS, *RATIOS, *DERIVED_SQL])
CTES["enough"] = (("features",), f"SELECT * FROM features WHERE {_KNOWN} >= 10")
CTES["pairs"] = (
    ("scores", "bars"),
    "SELECT ticker, date, score, ret FROM (SELECT ticker, date, score, "
    "CASE WHEN date - d0 <= 10 AND d1 > d0 AND p0 <> 0 THEN p1 / p0 - 1 END AS ret FROM ("
    "SELECT e.*, b.date AS d1, b.close AS p1 FROM (SELECT q.*, b.date AS d0, b.close AS p0 FROM ("
    "SELECT s.ticker, s.date, s.score, d.nd FROM scores s JOIN (SELECT date, LEAD(date) OVER (ORDER BY date) AS nd "
    "FROM (SELECT DISTINCT date FROM scores) dd) d ON s.date = d.date WHERE nd IS NOT NULL) q "
    "ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND q.date >= b.date) e "
    "ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.nd >= b.date) x) y WHERE ret IS NOT NULL",
)
CTES["ic"] = (
    ("pairs",),
    "SELECT date, COUNT(*) AS n_names, CASE WHEN COUNT(*) >= 3 AND STDDEV_SAMP(rs) * STDDEV_SAMP(rr) > 0 "
    "THEN COVAR_SAMP(rs, rr) / (STDDEV_SAMP(rs) * STDDEV_SAMP(rr)) END AS rank_ic FROM ("
    "SELECT date, RANK() OVER (PARTITION BY date ORDER BY score) + (COUNT(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS rs, "
    "RANK() OVER (PARTITION BY date ORDER BY ret) + (COUNT(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS rr FROM pairs) r "
    "GROUP BY date",
)
CTES["spreads"] = (
    ("pairs",),
    "SELECT date, CASE WHEN MAX(n) >= 20 THEN AVG(CASE WHEN rn > n - n // 10 THEN ret END) "
    "- AVG(CASE WHEN rn <= n // 10 THEN ret END) END AS decile_spread FROM (SELECT date, ret, "
    "ROW_NUMBER() OVER (PARTITION BY date ORDER BY score, ticker) AS rn, COUNT(*) OVER (PARTITION BY date) AS n FROM pairs) d "
    "GROUP BY date",
)
CTES["months"] = (
    ("ic", "spreads"),
    "SELECT i.date, i.n_names, i.rank_ic, s.decile_spread FROM ic i JOIN spreads s ON i.date = s.date WHERE n_names >= 5",
)
CTES["book"] = (
    ("scores", "members_at"),
    "SELECT date, ticker, score, rank FROM (SELECT z.*, ROW_NUMBER() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank "
    "FROM (SELECT k.ticker, k.date, s.score FROM members_at k ASOF LEFT JOIN scores s ON k.ticker = s.ticker AND k.date >= s.date) z "
    "WHERE score IS NOT NULL) r WHERE rank <= 5",
)
CTES["equity"] = (
    ("monthly", "benchmark_levels"),
    "SELECT m.ticker AS run_id, m.month AS ts, m.marketcap AS equity, b.level FROM monthly m "
    "ASOF LEFT JOIN benchmark_levels b ON m.month >= b.date",
)
CTES["stepped"] = (
    ("equity",),
    "SELECT e.*, LAG(equity) OVER w AS pe, LAG(level) OVER w AS pl, MAX(equity) OVER (PARTITION BY run_id ORDER BY ts "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM equity e WINDOW w AS (PARTITION BY run_id ORDER BY ts)",
)
CTES["rets"] = (
    ("stepped",),
    "SELECT s.*, CASE WHEN pe > 0 THEN (equity - pe) / pe END AS ret, "
    "CASE WHEN pe > 0 AND pl > 0 AND level IS NOT NULL THEN (equity - pe) / pe END AS pr, "
    "CASE WHEN pe > 0 AND pl > 0 AND level IS NOT NULL THEN (level - pl) / pl END AS br, "
    "CASE WHEN peak > 0 THEN (equity - peak) / peak ELSE 0 END AS dd FROM stepped s",
)


def with_ctes(*names: str, body: str) -> str:
    """``WITH`` clause holding the named expressions and all they need, then ``body``."""
    done: list[str] = []

    def need(name: str) -> None:
        for parent in CTES[name][0]:
            need(parent)
        if name not in done:
            done.append(name)

    for name in names:
        need(name)
    head = ",\n".join(f"{n} AS ({_vc(CTES[n][1])})" for n in done)
    return f"WITH {head},\n{body.lstrip()[5:]}" if body.lstrip().upper().startswith("WITH ") else f"WITH {head}\n{body}"


class Tables:
    """The derived tables as lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str) -> DataFrame:
        """A derived table stored once, as a price table would be; for plans that read it several times."""
        if name not in self._stored:
            self._stored[name] = cut(getattr(self, name))
        return self._stored[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self) -> int:
        """Rows of the larger of the two tables that the others are derived from, as the files' footers have them."""
        return max(self.raw(name).count() for name in ("lineitem", "events"))

    def _line(self, *cols: str) -> DataFrame:
        return self.raw("lineitem").selectExpr(*[f"{LINE[c]} AS {c}" for c in cols])

    @staticmethod
    def _agg(exprs: dict[str, str]) -> list:
        return [F.expr(e).alias(n) for n, e in exprs.items()]

    @cached_property
    def bars(self) -> DataFrame:
        # Nearly every line is a bar of its own, so adding lines up before the shuffle would only fill memory with them.
        lines = self._line("ticker", "suppkey", "date", "q", "c", "ln", "px").repartition(
            parts(self.spark), "ticker", "date")
        daily = lines.groupBy("ticker", "date")
        return daily.agg(*self._agg(BAR)).selectExpr(
            "ticker", "date", "open", "high", "low", "close",
            "close * CAST(100 - suppkey % 5 AS DOUBLE) / 100 AS closeadj", "close * 2 AS closeunadj", "volume", "n_rows",
        )

    @cached_property
    def monthly(self) -> DataFrame:
        rows = self._line("ticker", "date", "q", "c", "dp")
        return rows.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(*self._agg(MONTH))

    @cached_property
    def filings(self) -> DataFrame:
        rows = self._line("ticker", "date", "q", "c", "dp", "tp", "ln", "flag")
        return rows.groupBy("ticker", F.expr(DIMENSION).alias("dimension"), F.expr(FILED).alias("datekey")).agg(
            F.max("date").alias("lastupdated"), *self._agg(FIELDS)
        )

    @cached_property
    def filings_raw(self) -> DataFrame:
        rows = self._line("ticker", "date", "c", "dp", "flag", "status")
        keys = ["ticker", F.expr(DIMENSION).alias("dimension"), F.expr(FILED).alias("datekey"), "status"]
        return rows.groupBy(*keys).agg(
            F.max("date").alias("lastupdated"),
            *self._agg({"revenue": LEVELS["revenue"], "netinc": LEVELS["netinc"]}),
        )

    @cached_property
    def caps(self) -> DataFrame:
        return self.bars.selectExpr("ticker", "date", "close * volume * 1000 AS marketcap")

    @cached_property
    def calendar(self) -> DataFrame:
        return self._line("date").distinct()

    @cached_property
    def month_ends(self) -> DataFrame:
        from pitlane.operators.panel import month_end_dates

        return month_end_dates(self.calendar)

    @cached_property
    def scores(self) -> DataFrame:
        return self.monthly.select("month", "ticker", "score").join(F.broadcast(self.month_ends), "month").select(
            "date", "ticker", "score"
        )

    @cached_property
    def actions(self) -> DataFrame:
        ev = self.raw("events").selectExpr(
            "CONCAT('U', CAST(user_id AS STRING)) AS ticker", "CAST(ts AS DATE) AS date", "event_type"
        ).where("event_type IN ('signup', 'error') OR (event_type = 'purchase' AND date >= DATE '2024-01-28')")
        return ev.selectExpr(
            "ticker", "date",
            "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'current' END AS action",
        ).distinct()

    @cached_property
    def index_actions(self) -> DataFrame:
        rows = self._line("ticker", "date", "flag", "dp", "ln").where(
            "(flag = 'A' AND dp >= 5) OR (flag = 'R' AND dp >= 8)"
        )
        return rows.selectExpr(
            "ticker", "date", "CASE WHEN flag = 'A' THEN 'added' ELSE 'removed' END AS action"
        ).distinct()

    @cached_property
    def members(self) -> DataFrame:
        from pitlane.operators.universe import membership_spells

        return membership_spells(self.index_actions).select("ticker", "start_date", "end_date")

    @cached_property
    def benchmark_levels(self) -> DataFrame:
        return self.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
            F.expr(
                "CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / CAST(COUNT(*) AS DOUBLE)"
            ).alias("level")
        )

    @cached_property
    def sectors(self) -> DataFrame:
        joined = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.where("s_suppkey % 11 <> 0").selectExpr(
            "CONCAT('S', CAST(s_suppkey AS STRING)) AS ticker", "n_name AS sector"
        )

    @cached_property
    def tickers(self) -> DataFrame:
        named = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
            "CONCAT('S', CAST(s_suppkey AS STRING)) AS ticker",
            "CASE s_suppkey % 3 WHEN 0 THEN 'Domestic Common Stock' WHEN 1 THEN 'Domestic Common Stock Primary Class' "
            "ELSE 'ADR Common Stock' END AS category",
            "CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS sector",
        )
        listed = self._line("ticker", "date").groupBy("ticker").agg(
            F.min("date").alias("firstpricedate"),
            F.when(F.max("date") < F.lit("2001-10-15").cast("date"), F.max("date")).alias("lastpricedate"),
        )
        return named.withColumn("table", F.explode(F.array(F.lit("SF1"), F.lit("SEP")))).join(
            listed, "ticker", "left"
        ).select("ticker", "table", "category", "sector", "firstpricedate", "lastpricedate")
