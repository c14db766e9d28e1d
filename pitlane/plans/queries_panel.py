"""Features, labels and normalisation of the monthly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.operators.panel import (
    FEATURES, LEVEL_FIELDS, count_known, cross_sections, deflator_drops, enough_features, features_at, market_caps_at,
    rank_normalise, scale_by_assets, section_sizes,
)
from pitlane.operators.universe import members_on, sector_codes
from pitlane.plans.fixtures import Tables, with_ctes
from pitlane.plans.queries_sources import r6, rounded
from pitlane.plans.registry import query
from pitlane.session import cut

MIN_NAMES = 5


def feature_rows(t: Tables) -> DataFrame:
    capped = market_caps_at(members_on(t.month_ends, t.members), t.caps)
    return features_at(capped, t.filings)


def panel(t: Tables, target: str = "cap", **kw) -> DataFrame:
    return cross_sections(
        t.month_ends, t.members, t.caps, t.filings, target=target, min_names=MIN_NAMES,
        prices=t.bars if target == "ret" else None, **kw,
    )


@query(
    "features", "H1 H2 C7 M9",
    with_ctes(
        "features",
        body="SELECT ticker, date, marketcap, " + ", ".join(f"{r6(f)} AS {f}" for f in FEATURES) + " FROM features",
    ),
)
def features(t: Tables) -> DataFrame:
    return rounded(feature_rows(t), *FEATURES)


@query(
    "features_enough", "B6",
    with_ctes("enough", body="SELECT ticker, date FROM enough"),
)
def features_enough(t: Tables) -> DataFrame:
    return enough_features(cut(count_known(feature_rows(t)))).select("ticker", "date")


_SCALED = [f for f in LEVEL_FIELDS if f not in ("eps", "epsdil", "assets")]


@query(
    "features_scaled", "H3 H11",
    with_ctes(
        "features",
        body="SELECT ticker, date, " + ", ".join(f"{r6(f'CASE WHEN assets > 0 THEN {f} / assets END')} AS {f}" for f in _SCALED)
        + f", {r6('CASE WHEN assets > 0 THEN LN(assets) END')} AS assets, {r6('eps')} AS eps, {r6('roe')} AS roe FROM features",
    ),
)
def features_scaled(t: Tables) -> DataFrame:
    rows = scale_by_assets(feature_rows(t)).select("ticker", "date", *_SCALED, "assets", "eps", "roe")
    return rounded(rows, *_SCALED, "assets", "eps", "roe")


def _panel_sql(label: str, keep: str = "TRUE") -> str:
    return with_ctes(
        "enough",
        body=f"""SELECT ticker, date, n_names, {r6('y - AVG(y) OVER (PARTITION BY date)')} AS target, {r6('roe')} AS roe FROM (
 SELECT z.*, COUNT(*) OVER (PARTITION BY date) AS n_names FROM (SELECT e.*, {label} AS y FROM enough e WHERE {keep}) z) w
 WHERE n_names >= {MIN_NAMES}""",
    )


def _panel_out(p: DataFrame) -> DataFrame:
    return rounded(p.select("ticker", "date", "n_names", "target", "roe"), "target", "roe")


@query("panel_market_cap", "I8 H4 B7 E7", _panel_sql("LN(marketcap)"))
def panel_market_cap(t: Tables) -> DataFrame:
    return _panel_out(panel(t, "cap"))


@query("panel_market_to_book", "I8 H4 B9", _panel_sql("LN(marketcap) - LN(equity)", "equity > 0"))
def panel_market_to_book(t: Tables) -> DataFrame:
    return _panel_out(panel(t, "mb"))


@query("panel_market_to_assets", "I8 H4 B9", _panel_sql("LN(marketcap) - LN(assets)", "assets > 0"))
def panel_market_to_assets(t: Tables) -> DataFrame:
    return _panel_out(panel(t, "ma"))


@query(
    "panel_forward_return", "I8 H4 C5 E7",
    with_ctes(
        "enough", "bars",
        body=f"""SELECT ticker, date, n_names, {r6('y - AVG(y) OVER (PARTITION BY date)')} AS target, {r6('roe')} AS roe FROM (
 SELECT x.*, COUNT(*) OVER (PARTITION BY date) AS n_names, CASE WHEN date - d0 <= 10 AND d1 > d0 AND p0 <> 0 THEN p1 / p0 - 1 END AS y FROM (
 SELECT e.*, b.date AS d1, b.close AS p1 FROM (SELECT q.*, b.date AS d0, b.close AS p0 FROM (
 SELECT n.ticker, n.date, n.roe, d.nd FROM enough n JOIN (SELECT date, LEAD(date) OVER (ORDER BY date) AS nd FROM month_ends) d ON n.date = d.date) q
 ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND q.date >= b.date) e
 ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.nd >= b.date) x) w WHERE n_names >= {MIN_NAMES}""",
    ),
)
def panel_forward_return(t: Tables) -> DataFrame:
    return _panel_out(panel(t, "ret"))


@query(
    "deflator_drops", "B9",
    with_ctes(
        "enough",
        body="SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE equity IS NULL OR equity <= 0) AS n_dropped FROM enough",
    ),
)
def deflator_drops_query(t: Tables) -> DataFrame:
    return deflator_drops(enough_features(cut(count_known(feature_rows(t)).select("equity", "n_features"))), "mb")


@query(
    "rank_normalised", "E6",
    with_ctes(
        "features",
        body=f"""SELECT ticker, date, feature, {r6('CASE WHEN n < 2 THEN 0.0 ELSE CAST(rn - 1 AS DOUBLE) / (n - 1) * 2 - 1 END')} AS z FROM (
 SELECT ticker, date, feature, ROW_NUMBER() OVER (PARTITION BY date, feature ORDER BY v, ticker) AS rn,
 COUNT(*) OVER (PARTITION BY date, feature) AS n FROM ("""
        + " UNION ALL ".join(f"SELECT ticker, date, CAST({i} AS INTEGER) AS feature, {f} AS v FROM features" for i, f in enumerate(FEATURES))
        + ") l WHERE v IS NOT NULL) r",
    ),
)
def rank_normalised(t: Tables) -> DataFrame:
    rows = cut(feature_rows(t).select("ticker", "date", *FEATURES))
    return rounded(rank_normalise(rows, FEATURES), "z")


@query(
    "panel_with_industry", "C9 A14 I3",
    with_ctes(
        "enough", "tickers",
        body=f"""SELECT p.ticker, p.date, CAST(s.industry AS INTEGER) AS industry FROM (SELECT z.*, COUNT(*) OVER (PARTITION BY date) AS n FROM enough z) p
 LEFT JOIN (SELECT ticker, DENSE_RANK() OVER (ORDER BY sector) - 1 AS industry FROM tickers
 WHERE "table" = 'SF1' AND category LIKE 'Domestic Common Stock%' AND sector IS NOT NULL) s ON p.ticker = s.ticker WHERE n >= {MIN_NAMES}""",
    ),
)
def panel_with_industry(t: Tables) -> DataFrame:
    return panel(t, "cap", sectors=sector_codes(t.tickers)).select("ticker", "date", "industry")


@query(
    "section_sizes", "D38",
    with_ctes(
        "enough",
        body=f"""SELECT MIN(n) AS n_min, LIST_SORT(LIST(n))[CAST(FLOOR(COUNT(*) / 2) AS BIGINT) + 1] AS n_median, MAX(n) AS n_max,
 COUNT(*) AS n_sections FROM (SELECT date, COUNT(*) AS n FROM enough GROUP BY date HAVING COUNT(*) >= {MIN_NAMES}) z""",
    ),
)
def section_sizes_query(t: Tables) -> DataFrame:
    return section_sizes(panel(t, "cap"))
