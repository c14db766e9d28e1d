"""The top-K book over time: who is in it, for how long, and how much it changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlane.operators.asof import asof_join, forward_return
from pitlane.operators.panel import next_dates
from pitlane.operators.ranks import top_k
from pitlane.operators.universe import members_on

TOP_K = 20


def scores_at(dates: DataFrame, scores: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """Latest score of every name as of each date, for the members of that date."""
    days = dates.select("date").distinct()
    if membership is not None:
        asked = members_on(days, membership)
    else:
        spells = scores.groupBy("ticker").agg(F.min("date").alias("start_date")).withColumn(
            "end_date", F.lit(None).cast("date")
        )
        asked = members_on(days, spells)
    read = asof_join(asked, scores.select("ticker", F.col("date").alias("_sd"), "score"), ["ticker"], "date", "_sd",
                     ["score"])
    return read.where(F.col("score").isNotNull())


def top_scored(scored: DataFrame, k: int = TOP_K, *, by: Sequence[str] = ("date",)) -> DataFrame:
    """The ``k`` best names per date; equal scores go in ticker order."""
    return top_k(scored, by, [F.col("score").desc(), F.col("ticker")], k)


def top_book(
    dates: DataFrame, scores: DataFrame, membership: DataFrame | None, k: int = TOP_K
) -> DataFrame:
    return top_scored(scores_at(dates, scores, membership), k)


def with_sector(book: DataFrame, sectors: DataFrame) -> DataFrame:
    return book.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Unknown"))
    )


def sector_by_year(book: DataFrame, sectors: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Mean names per month in each sector, one row per year and sector (pivot with ``names``)."""
    months = book.select(F.year("date").alias("year"), "date").distinct().groupBy("year").agg(
        F.count(F.lit(1)).alias("_m")
    )
    held = with_sector(book, sectors).groupBy(F.year("date").alias("year"), "sector").agg(F.count(F.lit(1)).alias("_c"))
    mean = held.join(months, "year").select("year", "sector", (F.col("_c") / F.col("_m")).alias("mean_names"))
    if names is None:
        return mean
    wide = mean.groupBy("year").pivot("sector", list(names)).agg(F.first("mean_names"))
    return wide.na.fill(0.0)


def book_changes(book: DataFrame, k: int = TOP_K) -> DataFrame:
    """Share of the book that is new at each date; the first date has none."""
    days = next_dates(book).where("next_date IS NOT NULL")
    stays = book.select("date", "ticker").join(days, "date").select(F.col("next_date").alias("date"), "ticker", F.lit(1).alias("_s"))
    held = book.select("date", "ticker").join(stays, ["date", "ticker"], "left")
    counts = held.groupBy("date").agg(F.count_if(F.col("_s").isNull()).alias("_new"))
    later = days.select(F.col("next_date").alias("date"))
    return later.join(counts, "date").select("date", (F.col("_new") / F.lit(k)).alias("replaced"))


def turnover_by_year(book: DataFrame, k: int = TOP_K) -> DataFrame:
    changes = book_changes(book, k)
    return changes.groupBy(F.year("date").alias("year")).agg(
        F.avg("replaced").alias("turnover"), F.count(F.lit(1)).alias("n")
    )


def mean_turnover(book: DataFrame, k: int = TOP_K) -> DataFrame:
    return book_changes(book, k).agg(F.avg("replaced").alias("turnover"), F.count(F.lit(1)).alias("n"))


def tenure(book: DataFrame) -> DataFrame:
    return book.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("months"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def most_persistent(book: DataFrame, sectors: DataFrame, n: int = 25) -> DataFrame:
    """Names held longest; ties by ticker. The limit is the report's own length."""
    ranked = tenure(book).orderBy(F.col("months").desc(), "ticker").limit(n)
    return ranked.join(sectors.select("ticker", "sector"), "ticker", "left")


def breadth(book: DataFrame) -> DataFrame:
    per = book.groupBy("ticker").agg(F.count(F.lit(1)).alias("_m"))
    return per.agg(F.count(F.lit(1)).alias("n_names"), F.avg("_m").alias("mean_tenure"))


def sector_share(book: DataFrame, sectors: DataFrame) -> DataFrame:
    """Share of each sector in the book at each date."""
    per = with_sector(book, sectors).groupBy("date", "sector").agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy("date"))
    return per.select("date", "sector", (F.col("_c") / total).alias("share"))


def effective_holdings(weights: DataFrame, *, by: Sequence[str] = ("run_id",), date: str = "date") -> DataFrame:
    """Mean over rebalances of ``1 / sum(w^2)``."""
    per = weights.groupBy(*by, date).agg((F.lit(1.0) / F.sum(F.col("weight") * F.col("weight"))).alias("_e"))
    return per.groupBy(*by).agg(F.avg("_e").alias("effective_holdings"), F.count(F.lit(1)).alias("n_rebalances"))


def month_returns(book: DataFrame, prices: DataFrame, *, price: str = "close", days: int = 30) -> DataFrame:
    """Return over the next 30 days from the latest prices, however old; null when the entry price is 0."""
    dated = book.withColumn("_after", F.date_add("date", days))
    return forward_return(
        dated, prices, after="_after", price=price, stale_days=None, need_later_exit=False, out="next_return"
    ).drop("_after")


def snapshot(book: DataFrame, prices: DataFrame, on: Sequence[str], *, price: str = "close") -> DataFrame:
    """Ranked book with scores and next-month returns on chosen dates."""
    chosen = book.where(F.col("date").isin([F.lit(d).cast("date") for d in on]))
    return month_returns(chosen, prices, price=price)


def tracked(book: DataFrame, prices: DataFrame, names: Sequence[str], *, price: str = "close") -> DataFrame:
    """For chosen names: months held, first and last month, mean next-month return while held."""
    held = month_returns(book.where(F.col("ticker").isin(list(names))), prices, price=price)
    return held.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("months"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("next_return").alias("mean_return"),
    )
