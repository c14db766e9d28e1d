"""Targets against feature scalings: four fits side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pitlane.operators.models import ablated_scores
from pitlane.operators.panel import FEATURES, feature_table, sections_of
from pitlane.operators.signals import score_returns, signal_months, signal_summary, valuation_error
from pitlane.plans.fixtures import Tables, with_ctes
from pitlane.plans.queries_models import BURN_IN
from pitlane.plans.queries_panel import MIN_NAMES
from pitlane.plans.queries_signals import nw_sql
from pitlane.plans.queries_sources import r6, rounded
from pitlane.plans.registry import query
from pitlane.session import cut

FIGURES = ("median_ape", "mean_ic", "ic_t", "mean_spread", "spread_t")


def cell_panels(t: Tables, features: Sequence[str] = FEATURES) -> dict[str, DataFrame]:
    """The panels of both targets, read from one stored table of the named features."""
    stored = feature_table(t.month_ends, t.members, t.caps, t.filings, features=features)
    return {target: sections_of(stored, target, min_names=MIN_NAMES) for target in ("cap", "mb")}


def cell_table(t: Tables, scores: DataFrame) -> DataFrame:
    """Per cell: valuation error of all scores, and how the scores order the next month's returns."""
    stored, closes = cut(scores), cut(t.bars.select("ticker", "date", "close"))
    pairs = cut(score_returns(stored, closes, by=["cell"]).select("cell", "date", "ticker", "score", "ret"))
    months = cut(signal_months(pairs, by=["cell", "date"], min_names=MIN_NAMES))
    told = signal_summary(months, by=["cell"]).select("cell", "mean_ic", "ic_t", "mean_spread", "spread_t", "n_months")
    errors = valuation_error(stored, by=["cell"]).select("cell", "median_ape")
    return rounded(errors.join(told, "cell").select("cell", *FIGURES, "n_months"), *FIGURES)


_CELL = "SELECT '{cell}' AS cell, ticker, date, {label} AS y, {value} AS v FROM enough e WHERE {keep}"
_LABELS = {"cap": ("LN(marketcap)", "TRUE"), "mb": ("LN(marketcap) - LN(equity)", "equity > 0")}
_VALUES = {"raw": "revenue", "scaled": "CASE WHEN assets > 0 THEN revenue / assets END"}
_NAMES = [f"{target}+{scaling}" for target in _LABELS for scaling in _VALUES]
_RIDGES = f"""WITH u AS ({' UNION ALL '.join(
    _CELL.format(cell=f'{target}+{scaling}', label=label, value=value, keep=keep)
    for target, (label, keep) in _LABELS.items() for scaling, value in _VALUES.items())}),
 p AS (SELECT cell, ticker, date, v, y - AVG(y) OVER (PARTITION BY cell, date) AS y FROM (
  SELECT u.*, COUNT(*) OVER (PARTITION BY cell, date) AS n FROM u) c WHERE n >= {MIN_NAMES}),
 z AS (SELECT cell, ticker, date, y, CASE WHEN v IS NULL OR n < 2 THEN 0.0::DOUBLE ELSE CAST(rn - 1 AS DOUBLE) / (n - 1) * 2 - 1 END AS x FROM (
  SELECT p.*, ROW_NUMBER() OVER (PARTITION BY cell, date, v IS NULL ORDER BY v, ticker) AS rn, COUNT(*) OVER (PARTITION BY cell, date, v IS NULL) AS n FROM p) r),
 s AS (SELECT cell, date, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy,
  ROW_NUMBER() OVER (PARTITION BY cell ORDER BY date) - 1 AS i FROM z GROUP BY cell, date),
 h AS (SELECT cell, date, i, SUM(n) OVER w AS n, SUM(sx) OVER w AS sx, SUM(sy) OVER w AS sy, SUM(sxx) OVER w AS sxx, SUM(sxy) OVER w AS sxy FROM s
  WINDOW w AS (PARTITION BY cell ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT cell, date, sy / n AS my, sx / n AS mx, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0::DOUBLE) AS b FROM h WHERE i >= {BURN_IN}),
 raw AS (SELECT z.cell, z.date, z.ticker, f.my + f.b * (z.x - f.mx) - z.y AS s FROM z JOIN f ON z.cell = f.cell AND z.date = f.date),
 sc AS (SELECT cell, date, ticker, {r6('s - AVG(s) OVER (PARTITION BY cell, date)')} AS score FROM raw),
 nd AS (SELECT cell, date, LEAD(date) OVER (PARTITION BY cell ORDER BY date) AS nd FROM (SELECT DISTINCT cell, date FROM sc) q),
 e0 AS (SELECT q.*, b.date AS d0, b.close AS p0 FROM (SELECT sc.*, nd.nd FROM sc JOIN nd ON sc.cell = nd.cell AND sc.date = nd.date WHERE nd.nd IS NOT NULL) q
  ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND q.date >= b.date),
 e1 AS (SELECT q.*, b.date AS d1, b.close AS p1 FROM e0 q ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND q.nd >= b.date),
 pr AS (SELECT cell, ticker, date, score, ret FROM (SELECT cell, ticker, date, score, CASE WHEN date - d0 <= 10 AND d1 > d0 AND p0 <> 0 THEN p1 / p0 - 1 END AS ret FROM e1) q WHERE ret IS NOT NULL),
 ic AS (SELECT cell, date, COUNT(*) AS n_names, CASE WHEN COUNT(*) >= 3 AND STDDEV_SAMP(rs) * STDDEV_SAMP(rr) > 0 THEN COVAR_SAMP(rs, rr) / (STDDEV_SAMP(rs) * STDDEV_SAMP(rr)) END AS rank_ic FROM (
  SELECT cell, date, RANK() OVER (PARTITION BY cell, date ORDER BY score) + (COUNT(*) OVER (PARTITION BY cell, date, score) - 1) / 2.0 AS rs,
  RANK() OVER (PARTITION BY cell, date ORDER BY ret) + (COUNT(*) OVER (PARTITION BY cell, date, ret) - 1) / 2.0 AS rr FROM pr) r GROUP BY cell, date),
 sp AS (SELECT cell, date, CASE WHEN MAX(n) >= 20 THEN AVG(CASE WHEN rn > n - n // 10 THEN ret END) - AVG(CASE WHEN rn <= n // 10 THEN ret END) END AS decile_spread FROM (
  SELECT cell, date, ret, ROW_NUMBER() OVER (PARTITION BY cell, date ORDER BY score, ticker) AS rn, COUNT(*) OVER (PARTITION BY cell, date) AS n FROM pr) d GROUP BY cell, date),
 mo AS (SELECT ic.cell, ic.date, rank_ic, decile_spread FROM ic JOIN sp ON ic.cell = sp.cell AND ic.date = sp.date WHERE n_names >= {MIN_NAMES}),
 ape AS (SELECT cell, EXP(MEDIAN(ABS(score))) - 1 AS ape FROM sc GROUP BY cell)"""
_CELL_ROW = """SELECT '{cell}' AS cell, (SELECT {ape} FROM ape WHERE cell = '{cell}') AS median_ape, {mean_ic} AS mean_ic, {ic_t} AS ic_t,
 {mean_spread} AS mean_spread, {spread_t} AS spread_t, COUNT(*) AS n_months FROM mo WHERE cell = '{cell}'"""


def _cell_row(cell: str) -> str:
    own = f"(SELECT * FROM mo WHERE cell = '{cell}')"
    return _CELL_ROW.format(
        cell=cell, ape=r6("ape"), mean_ic=r6("AVG(rank_ic)"), mean_spread=r6("AVG(decile_spread)"),
        ic_t=r6(nw_sql(own, "rank_ic")), spread_t=r6(nw_sql(own, "decile_spread")))


@query(
    "signal_cells", "I7 I1 A30 G4",
    with_ctes("enough", "bars", body=_RIDGES + "\n" + " UNION ALL ".join(_cell_row(c) for c in _NAMES)),
)
def signal_cells(t: Tables) -> DataFrame:
    """The four cells of the ablation by a ridge on revenue, which is a level and so changes with the scaling."""
    panels = cell_panels(t, ["revenue", "assets", "equity"])
    return cell_table(t, ablated_scores(panels, ["revenue"], model="ridge", burn_in=BURN_IN))


@query("signal_cells_trees", "I7 I2 G4")
def signal_cells_trees(t: Tables) -> DataFrame:
    """The four cells by boosted trees on all features."""
    return cell_table(t, ablated_scores(cell_panels(t), burn_in=BURN_IN))
