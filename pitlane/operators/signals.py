"""How well a score orders next-period returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.functions.stats import pearson
from pitlane.operators.asof import forward_return
from pitlane.operators.ranks import exact_median, ordinal_rank, rank_table
from pitlane.operators.universe import keep_members
from pitlane.session import cut

N_DECILES = 10
MIN_NAMES = 30
NW_LAGS = 3


def score_panel(scores: DataFrame, start: str, end: str) -> DataFrame:
    return scores.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def score_returns(
    scores: DataFrame, prices: DataFrame, *, price: str = "close", by: Sequence[str] = (), stale_days: int | None = 10
) -> DataFrame:
    """Scores with the return to the next score date; names without one drop out."""
    days = scores.select(*by, "date").distinct()
    along = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("date")
    dated = scores.join(days.withColumn("next_date", F.lead("date").over(along)), [*by, "date"])
    out = forward_return(dated.where("next_date IS NOT NULL"), prices, price=price, stale_days=stale_days)
    return out.where(F.col("ret").isNotNull()).drop("next_date")


def rank_ic(
    pairs: DataFrame, *, by: Sequence[str] = ("date",), score: str = "score", ret: str = "ret"
) -> DataFrame:
    """Spearman correlation per group with average ranks; null below three names or on a constant side.

    Ranks are joined back by value; where most names share one, the join is split by Spark's skew handling.
    """
    ranked = pairs.select(*by, score, ret)
    for col, name in ((score, "_rs"), (ret, "_rr")):
        ranked = ranked.join(rank_table(pairs, by, col, name=name), [*by, col])
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_names"), pearson("_rs", "_rr", 3).alias("rank_ic"))


def decile_spread(
    pairs: DataFrame, *, by: Sequence[str] = ("date",), score: str = "score", ret: str = "ret", name: str = "ticker",
    n_deciles: int = N_DECILES,
) -> DataFrame:
    """Mean return of the top ``n div 10`` names minus that of the bottom ones; null below two names per decile."""
    ranked = ordinal_rank(pairs, by, [F.col(score), F.col(name)])
    size = F.floor(F.col("n") / n_deciles)
    top = F.avg(F.when(F.col("rn") > F.col("n") - size, F.col(ret)))
    bottom = F.avg(F.when(F.col("rn") <= size, F.col(ret)))
    return ranked.groupBy(*by).agg(
        F.when(F.max("n") >= 2 * n_deciles, top - bottom).alias("decile_spread")
    )


def signal_months(
    pairs: DataFrame, *, by: Sequence[str] = ("date",), min_names: int = MIN_NAMES, n_deciles: int = N_DECILES
) -> DataFrame:
    """One row per date that has enough names: count, rank IC, decile spread.

    ``pairs`` is read several times (see :mod:`pitlane.operators.ranks`).
    """
    ic = rank_ic(pairs, by=by).where(F.col("n_names") >= min_names)
    return ic.join(decile_spread(pairs, by=by, n_deciles=n_deciles), list(by))


def newey_west(months: DataFrame, value: str, *, by: Sequence[str] = (), date: str = "date", lags: int = NW_LAGS) -> DataFrame:
    """Newey-West t-statistic of the mean of a dated series, Bartlett weights ``1 - l / (L + 1)``.

    One row per date goes in, so each series is short whatever the size of the
    cross-sections behind it.
    """
    known = months.where(F.col(value).isNotNull())
    group = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    centred = known.withColumn("_m", F.avg(value).over(group)).withColumn("_d", F.col(value) - F.col("_m"))
    along = group.orderBy(date)
    for lag in range(1, lags + 1):
        centred = centred.withColumn(f"_l{lag}", F.col("_d") * F.lag("_d", lag).over(along))
    total = F.sum(F.col("_d") * F.col("_d"))
    for lag in range(1, lags + 1):
        total = total + 2.0 * (1.0 - lag / (lags + 1.0)) * F.coalesce(F.sum(f"_l{lag}"), F.lit(0.0))
    sums = centred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_months"), F.max("_m").alias("mean"), total.alias("_s"))
    lrv = F.col("_s") / F.col("n_months")
    tstat = F.when((F.col("n_months") >= 2) & (lrv > 0), F.col("mean") / F.sqrt(lrv / F.col("n_months")))
    return sums.select(*by, "n_months", "mean", tstat.alias("nw_t"))


def signal_summary(months: DataFrame, *, by: Sequence[str] = (), lags: int = NW_LAGS) -> DataFrame:
    """Mean IC, hit rate, mean spread and both t-statistics, per signal.

    Undefined months are left out of the means and counted in ``n_undefined``.
    """
    keys = list(by) or ["_all"]
    rows = months if by else months.withColumn("_all", F.lit(0))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.avg("rank_ic").alias("mean_ic"),
        (F.count_if(F.col("rank_ic") > 0) / F.count(F.lit(1))).alias("hit_rate"),
        F.avg("decile_spread").alias("mean_spread"),
        F.count_if(F.col("rank_ic").isNull()).alias("n_undefined"),
    )
    ic = newey_west(rows, "rank_ic", by=keys, lags=lags).select(*keys, F.col("nw_t").alias("ic_t"))
    spread = newey_west(rows, "decile_spread", by=keys, lags=lags).select(*keys, F.col("nw_t").alias("spread_t"))
    out = base.join(ic, keys, "left").join(spread, keys, "left")
    return out if by else out.drop("_all")


def diagnose(
    scores: DataFrame, membership: DataFrame, prices: DataFrame, *, price: str = "close", by: Sequence[str] = (),
    min_names: int = MIN_NAMES, n_deciles: int = N_DECILES,
) -> DataFrame:
    """The whole diagnosis by month: members only, forward returns, IC and spread."""
    own = cut(keep_members(scores, membership))
    pairs = cut(score_returns(own, prices, price=price, by=by).select(*by, "date", "ticker", "score", "ret"))
    return signal_months(pairs, by=[*by, "date"], min_names=min_names, n_deciles=n_deciles)


def rolling_mean_ic(months: DataFrame, window: int, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean IC over the last ``window`` months, full windows only."""
    frame = (
        Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("date").rowsBetween(-(window - 1), 0)
    )
    return months.select(
        *by, "date", F.avg("rank_ic").over(frame).alias("rolling_ic"), F.count(F.lit(1)).over(frame).alias("_n")
    ).where(F.col("_n") == window).drop("_n")


def spread_growth(months: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Growth of 1 in the decile spread; months without a spread are skipped.

    A spread of -100% or worse cannot go through logarithms: the sign and a
    zero are carried apart, so the product stays exact in sign.
    """
    known = months.where(F.col("decile_spread").isNotNull()).withColumn("_g", 1 + F.col("decile_spread"))
    frame = (
        Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    size = F.exp(F.sum(F.when(F.col("_g") != 0, F.ln(F.abs(F.when(F.col("_g") != 0, F.col("_g")))))).over(frame))
    sign = F.when(F.sum((F.col("_g") < 0).cast("int")).over(frame) % 2 == 0, 1.0).otherwise(-1.0)
    dead = F.max((F.col("_g") == 0).cast("int")).over(frame) == 1
    return known.select(*by, "date", F.when(dead, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0))).alias("growth"))


def valuation_error(scores: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Median absolute valuation error ``expm1(median(|score|))``."""
    return exact_median(scores.withColumn("_a", F.abs("score")), by, "_a", few=True).select(
        *by, F.expm1("median").alias("median_ape"), "n"
    )


def prediction_size(scores: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Upper median of the absolute predicted return."""
    return exact_median(scores.withColumn("_a", F.abs("score")), by, "_a", upper=True, name="median_abs", few=True)


