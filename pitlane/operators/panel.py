"""Monthly cross-sections: features known at each date, labels, and their normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.functions.scalar import guarded_div, log_positive
from pitlane.operators.asof import STALE_DAYS, YEAR_LAG_DAYS, asof_join, forward_return, series
from pitlane.operators.ordered import attach
from pitlane.operators.dedupe import last_wins
from pitlane.operators.ranks import ordinal_rank
from pitlane.operators.universe import members_on
from pitlane.session import cut

# The filing fields read, in output order.
LEVEL_FIELDS = (
    "revenue", "gp", "opinc", "ebit", "netinc", "ebitda", "eps", "epsdil", "assets", "liabilities", "equity", "debt",
    "cashneq", "workingcapital", "fcf", "ncfo", "capex", "rnd",
)
RATIO_FIELDS = (
    "roe", "roa", "roic", "ros", "grossmargin", "netmargin", "ebitdamargin", "assetturnover", "currentratio", "de",
    "payoutratio", "divyield", "bvps", "sps", "fcfps",
)
DERIVED = (
    "gross_profitability", "fcf_to_assets", "debt_to_assets", "cash_to_assets", "interest_coverage",
    "accruals_to_assets", "delta_roa", "delta_gross_profitability", "delta_grossmargin", "delta_assetturnover",
    "delta_debt_to_equity", "delta_currentratio", "revenue_growth", "eps_change",
)
FEATURES = (*LEVEL_FIELDS, *RATIO_FIELDS, *DERIVED)
REQUIRED_FIELDS = tuple(sorted({*LEVEL_FIELDS, *RATIO_FIELDS, "intexp"}))
_LAGGED = ("gp", "assets", "roa", "grossmargin", "assetturnover", "de", "currentratio", "revenue", "eps")
UNSCALED_LEVELS = ("eps", "epsdil", "assets")
DEFLATOR = {"mb": "equity", "ma": "assets"}
TARGETS = ("cap", "mb", "ma", "ret")


def month_end_dates(calendar: DataFrame, *, date: str = "date") -> DataFrame:
    """Last date of the calendar in each month."""
    return calendar.groupBy(F.trunc(date, "month").alias("month")).agg(F.max(date).alias("date"))


def next_dates(dates: DataFrame) -> DataFrame:
    """Each date with the one after it. One row per calendar date, so one window is enough."""
    days = dates.select("date").distinct()
    return days.select("date", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("next_date"))


def market_caps_at(keys: DataFrame, caps: DataFrame, *, stale_days: int = STALE_DAYS) -> DataFrame:
    """Market cap as of each key date; names whose cap is missing, old or not positive drop out."""
    read = asof_join(
        keys, series(caps, "marketcap"), ["ticker"], "date", "date", ["marketcap"], tolerance_days=stale_days
    )
    return read.where(F.col("marketcap") > 0)


def features_at(keys: DataFrame, filings: DataFrame, *, dimension: str = "ART") -> DataFrame:
    """The feature catalogue for each ``(ticker, date)``: levels, ratios, and year-on-year changes.

    Reads the latest filing as of the date and as of 365 days earlier. Filings without any known field do not count;
    of several with one key the last wins (by ``lastupdated`` where there is such a column, then by their values).
    """
    order = [c for c in ("lastupdated",) if c in filings.columns]
    asked = filings.where(F.col("dimension") == dimension).select("ticker", "datekey", *order, *REQUIRED_FIELDS)
    filed = last_wins(asked.where(F.coalesce(*REQUIRED_FIELDS).isNotNull()), ["ticker", "datekey"], order).drop(*order)
    now = asof_join(keys, filed, ["ticker"], "date", "datekey", REQUIRED_FIELDS)
    back = now.withColumn("_then", F.date_sub("date", YEAR_LAG_DAYS))
    past = filed.select("ticker", "datekey", *[F.col(c).alias(f"_{c}") for c in _LAGGED])
    both = asof_join(back, past, ["ticker"], "_then", "datekey", [f"_{c}" for c in _LAGGED])

    def change(field: str) -> F.Column:
        return F.col(field) - F.col(f"_{field}")

    profitability = guarded_div("gp", "assets")
    derived = {
        "gross_profitability": profitability,
        "fcf_to_assets": guarded_div("fcf", "assets"),
        "debt_to_assets": guarded_div("debt", "assets"),
        "cash_to_assets": guarded_div("cashneq", "assets"),
        "interest_coverage": guarded_div("ebit", "intexp"),
        "accruals_to_assets": guarded_div(F.col("netinc") - F.col("ncfo"), "assets"),
        "delta_roa": change("roa"),
        "delta_gross_profitability": profitability - guarded_div("_gp", "_assets"),
        "delta_grossmargin": change("grossmargin"),
        "delta_assetturnover": change("assetturnover"),
        "delta_debt_to_equity": change("de"),
        "delta_currentratio": change("currentratio"),
        "revenue_growth": guarded_div("revenue", "_revenue") - 1,
        "eps_change": change("eps"),
    }
    return both.select(*keys.columns, *LEVEL_FIELDS, *RATIO_FIELDS, *[c.alias(n) for n, c in derived.items()])


def count_known(panel: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Adds ``n_features``, how many features are known."""
    return panel.withColumn("n_features", F.array_size(F.array_compact(F.array(*[F.col(c) for c in names]))))


def enough_features(panel: DataFrame, minimum: int = 10) -> DataFrame:
    """Rows with enough known features. Best on a stored ``n_features`` column: a
    filter over all the features themselves is costly to optimise."""
    counted = panel if "n_features" in panel.columns else count_known(panel)
    return counted.where(F.col("n_features") >= minimum)


def scale_by_assets(panel: DataFrame) -> DataFrame:
    """Dollar levels over total assets; assets become their logarithm; undefined when assets are not positive."""
    levels = {f: guarded_div(f, "assets") for f in LEVEL_FIELDS if f not in UNSCALED_LEVELS}
    levels["assets"] = log_positive("assets")
    return panel.select(*[levels[c].alias(c) if c in levels else F.col(c) for c in panel.columns])


def with_target(
    panel: DataFrame, target: str, *, prices: DataFrame | None = None, dates: DataFrame | None = None
) -> DataFrame:
    """Adds the raw label. Rows without a positive deflator drop out; a missing return label stays, as null.

    The return label runs to the next date of ``dates`` (default: the panel's own dates).
    """
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}, got {target!r}")
    if target == "ret":
        if prices is None:
            raise ValueError("the 'ret' target needs prices")
        dated = panel.join(F.broadcast(next_dates(panel if dates is None else dates)), "date", "left")
        return forward_return(dated, prices, out="target").drop("next_date")
    if target == "cap":
        return panel.withColumn("target", F.ln("marketcap"))
    field = DEFLATOR[target]
    return panel.where(F.col(field) > 0).withColumn("target", F.ln("marketcap") - F.ln(field))


def deflator_drops(panel: DataFrame, target: str) -> DataFrame:
    """How many name-months the deflator rule removes."""
    field = DEFLATOR[target]
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(F.col(field) > 0, F.lit(False))).alias("n_dropped")
    )


def demean(df: DataFrame, value: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Subtract the group mean of the known values."""
    return attach(df, by, few=True, _mean=F.avg(value)).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def cross_sections(
    dates: DataFrame,
    membership: DataFrame,
    caps: DataFrame,
    filings: DataFrame,
    *,
    target: str = "cap",
    prices: DataFrame | None = None,
    sectors: DataFrame | None = None,
    dimension: str = "ART",
    min_names: int = 50,
    min_features: int = 10,
) -> DataFrame:
    """Members of each date with their features and the demeaned label, as one long table.

    The feature rows are stored once (see :func:`feature_table`): the labels, the counts per date and all that follows
    read them again.
    """
    if target == "ret" and prices is None:
        raise ValueError("the 'ret' target needs prices")
    stored = feature_table(dates, membership, caps, filings, prices=prices if target == "ret" else None, dimension=dimension)
    return sections_of(stored, target, sectors=sectors, min_names=min_names, min_features=min_features)


def feature_table(
    dates: DataFrame, membership: DataFrame, caps: DataFrame, filings: DataFrame, *, prices: DataFrame | None = None,
    dimension: str = "ART", features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Members of each date with their market value, the named features and how many of all are known, stored once.

    With ``prices`` it has the return to the next date too, worked out on names and dates before they carry features.
    """
    keys = market_caps_at(members_on(dates, membership), caps)
    if prices is not None:
        keys = with_target(keys, "ret", prices=prices, dates=dates)
    counted = count_known(features_at(keys, filings, dimension=dimension))
    return cut(counted.select(*keys.columns, *features, "n_features"))


def sections_of(
    stored: DataFrame, target: str, *, sectors: DataFrame | None = None, min_names: int = 50, min_features: int = 10,
) -> DataFrame:
    """The cross-sections of one target from a :func:`feature_table`, which several targets may share."""
    rows = enough_features(stored, min_features)
    labelled = rows if target == "ret" else with_target(rows, target)
    counted = attach(labelled, ["date"], few=True, n_names=F.count(F.lit(1)), _mean=F.avg("target"))
    panel = (
        counted.where(F.col("n_names") >= min_names)
        .withColumn("target", F.col("target") - F.col("_mean"))
        .drop("_mean")
    )
    if sectors is not None:
        panel = panel.join(sectors.select("ticker", "industry"), "ticker", "left")
    return panel


def rank_normalise(
    panel: DataFrame, features: Sequence[str] = FEATURES, *, by: Sequence[str] = ("date",), name: str = "ticker",
    cuts: int = 8,
) -> DataFrame:
    """Long table ``(by, ticker, feature, z)``: ordinal ranks per date and feature, mapped to [-1, 1].

    Only known values are listed; a missing value counts as 0, as does a lone
    one. Ties go in ticker order. All features share one shuffle.
    """
    ranked = ordinal_rank(_known_values(panel, features, by, name), [*by, "feature"], [F.col("v"), F.col(name)], cuts=cuts, few=True)
    return ranked.select(*by, name, "feature", _scaled_rank(F.col("rn"), F.col("n")).alias("z"))


def _known_values(panel: DataFrame, features: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("v")) for i, f in enumerate(features)])
    return panel.select(*by, name, F.explode(pairs).alias("_f")).select(*by, name, "_f.feature", "_f.v").where(
        F.col("v").isNotNull()
    )


def _scaled_rank(rank: F.Column, n: F.Column) -> F.Column:
    return F.when(n < 2, F.lit(0.0)).otherwise((rank - 1) / F.greatest(n - 1, F.lit(1)) * 2.0 - 1.0)


#: A rank and its feature travel as one number, the feature above this many bits.
RANK_BITS = 40


def rank_vectors(
    panel: DataFrame, features: Sequence[str] = FEATURES, *, by: Sequence[str] = ("date",), name: str = "ticker", cuts: int = 8,
) -> DataFrame:
    """``(by, ticker, x)``: what :func:`rank_normalise` and :func:`feature_vectors` give, for rows with a known value.

    A rank goes back to its row as one small whole number; the sizes of the groups, a few per date, are sent to the rows.
    """
    ranked = ordinal_rank(
        _known_values(panel, features, by, name), [*by, "feature"], [F.col("v"), F.col(name)], total=None, cuts=cuts, few=True)
    code = F.shiftleft(F.col("feature").cast("bigint"), RANK_BITS) + F.col("rn")
    known = ranked.select(*by, name, code.alias("_code")).groupBy(*by, name).agg(F.collect_list("_code").alias("_codes"))
    sizes = panel.groupBy(*by).agg(F.array(*[F.count(f) for f in features]).alias("_sizes"))
    rank_of = F.map_from_arrays(
        F.transform("_codes", lambda c: F.shiftright(c, RANK_BITS).cast("int")),
        F.transform("_codes", lambda c: c.bitwiseAND(F.lit((1 << RANK_BITS) - 1))))
    slots = F.sequence(F.lit(0), F.lit(len(features) - 1))
    z = F.transform(slots, lambda i: F.coalesce(_scaled_rank(F.try_element_at("_r", i), F.get("_sizes", i)), F.lit(0.0)))
    return known.select(*by, name, rank_of.alias("_r")).join(F.broadcast(sizes), list(by)).select(*by, name, z.alias("x"))


def feature_vectors(long: DataFrame, n_features: int, *, by: Sequence[str] = ("date",), name: str = "ticker") -> DataFrame:
    """One array of ``n_features`` values per row; features not listed are 0."""
    known = long.groupBy(*by, name).agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(n_features - 1))
    return known.select(
        *by, name, F.transform(slots, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("x")
    )


def section_sizes(panel: DataFrame) -> DataFrame:
    """Names per date: smallest, upper median, largest. One row per date goes in."""
    per = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.min("n").alias("n_min"),
        F.element_at(F.array_sort(F.collect_list("n")), (F.floor(F.count("n") / 2) + 1).cast("int")).alias("n_median"),
        F.max("n").alias("n_max"),
        F.count("n").alias("n_sections"),
    )
