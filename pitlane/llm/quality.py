"""Quality rules with risk-controlled thresholds (operator 7), built-in functions only.

Every document gets counts; each rule is a ratio of two of them that is high in poor text. For every stratum and rule
a grid of cutoffs, fixed beforehand, is tested on the labelled documents: a cutoff is safe if the exact binomial tail
shows, at the level left by the correction for all tests, that it rejects at most ``risk`` of the good documents.
Of the safe cutoffs the one that best parts poor from good is used; a stratum with too few labels gets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.session import cut

#: Column that carries the counts; a struct, so that no column of the input clashes with it.
COUNTS = "__quality_counts"
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.7)
#: Rule: count above, count below, cutoffs.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "word_length": ("word_chars", "n_words", (5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    "symbols": ("n_symbols", "word_chars", _SHARES),
    "dup_lines": ("n_dup_lines", "n_lines", _SHARES),
    "repeat_words": ("n_repeat_words", "n_words", _SHARES),
    "upper": ("n_upper", "word_chars", _SHARES),
}
RISK, DELTA = 0.005, 0.05


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct :data:`COUNTS`; a null text has no words and no lines.

    Repeated three-word windows are found inside the row: windows are sorted with their positions, equal neighbours
    give the positions of repeats, and the words they cover are counted. Documents all of whose windows have
    different hashes have none, and skip the sort.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("long")
    without = lambda chars: long(F.length(body) - F.length(F.translate(body, chars, "")))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({
        "__w": F.array_remove(F.split(body, r"[\x20\x09-\x0D]+", -1), ""),
        "__l": lines,
    })
    words = F.col("__w")
    n = F.size(words)
    grams = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn("__h", F.slice(grams, 1, F.greatest(n - 2, F.lit(0))))
    named = F.transform(
        words, lambda x, i: F.concat_ws(" ", x, F.get(words, i + 1), F.get(words, i + 2), F.lpad(i.cast("string"), 9, "0")))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__g", F.when(repeats, F.sort_array(F.slice(named, 1, F.greatest(n - 2, F.lit(0))))))
    df = df.withColumn("__p", F.transform("__g", lambda x: F.substring_index(x, " ", 3)))
    keys = F.col("__p")
    spots = F.transform("__g", lambda x, i: F.when(
        (F.get(keys, i) == F.get(keys, i - 1)) | (F.get(keys, i) == F.get(keys, i + 1)),
        F.substring_index(x, " ", -1).cast("int")))
    df = df.withColumn("__q", F.array_sort(F.filter(spots, lambda x: x.isNotNull())))
    at = F.col("__q")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    counts = F.struct(
        long(n).alias("n_words"),
        (long(F.length(body)) - without(_SPACE)).alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        long(F.size("__l")).alias("n_lines"),
        long(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        without(_UPPER).alias("n_upper"),
    )
    return df.withColumn(COUNTS, counts).drop("__w", "__l", "__h", "__g", "__p", "__q")


def base_failed() -> Column:
    n, repeated = F.col(f"{COUNTS}.n_words"), F.col(f"{COUNTS}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def _ratio(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.try_divide(F.col(f"{COUNTS}.{above}"), F.col(f"{COUNTS}.{below}"))


def log_factorial(n: Column) -> Column:
    """ln n! for n >= 0: Stirling's series, eight steps up where it is exact to the last digits of a double."""
    z = n.cast("double") + 9.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    top = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series
    steps = F.lit(0.0)
    for j in range(1, 9):
        steps = steps + F.log(n.cast("double") + float(j))
    return top - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), for k < n p; 1 from there on.

    Summed from the largest term down; each term is the one above times a ratio below 1, and the sum ends where what
    is left cannot change a double.
    """
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k)
                + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.lit(50) + (40 * F.sqrt(n * p)).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, j: Column) -> Column:
        i = (k - j + 1).cast("double")
        term = state["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")),
                        start, add)["total"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum: the cutoff of each rule, null where none is safe.

    ``counted`` has doc_id, stratum and :data:`COUNTS`; ``labels`` has doc_id and quality (1 good, 0 poor). Documents
    that fail the base rules, and rows without an id or a label, take no part. The level ``delta`` is divided by
    strata x rules x cutoffs. Ties between cutoffs go to the higher.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    rows = counted.where(~base_failed()).select("doc_id", "stratum", *[_ratio(r).alias(r) for r in RULES]).join(
        marks, "doc_id")
    over = [F.sum((F.col(rule) > c).cast("long")).alias(f"{rule}_{i}")
            for rule, (_, _, grid) in RULES.items() for i, c in enumerate(grid)]
    by = rows.groupBy("stratum", "quality").agg(F.count("*").alias("n"), *over)
    cells = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"),
                      F.coalesce(F.col(f"{rule}_{i}"), F.lit(0)).alias("k"))
             for rule, (_, _, grid) in RULES.items() for i, c in enumerate(grid)]
    flat = by.select("stratum", "quality", "n", F.inline(F.array(*cells)))
    good, poor = F.col("quality") == 1, F.col("quality") == 0
    tests = flat.groupBy("stratum", "rule", "cutoff").agg(
        F.sum(F.when(good, F.col("n"))).alias("n"), F.sum(F.when(good, F.col("k"))).alias("k"),
        F.sum(F.when(poor, F.col("n"))).alias("n_poor"), F.sum(F.when(poor, F.col("k"))).alias("k_poor"),
    ).where("n IS NOT NULL")
    tests = tests.withColumn("tests", F.count("*").over(Window.partitionBy(F.lit(0))))
    gain = F.coalesce(F.try_divide(F.col("k_poor"), F.col("n_poor")), F.lit(0.0)) - 10 * F.col("k") / F.col("n")
    safe = tests.where(binomial_tail(F.col("k"), F.col("n"), risk) * F.col("tests") <= delta)
    best = safe.where("k_poor > 0").groupBy("stratum", "rule").agg(
        F.max(F.struct(gain.alias("gain"), F.col("cutoff"))).alias("best")).where("best.gain > 0")
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("best.cutoff"))


def verdict(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` (with stratum) with base_failed and kept: no base failure, and no ratio above its cutoff."""
    named = limits.select(F.col("stratum").alias("__stratum"), F.struct(*RULES).alias("__limits"))
    joined = counted.join(named, F.col("stratum") == F.col("__stratum"), "left")
    above = F.lit(False)
    for rule in RULES:
        above = above | F.coalesce(_ratio(rule) > F.col(f"__limits.{rule}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~above).drop("__stratum", "__limits")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang).

    The stratum is the language; a null one is a stratum of its own. Repeated rows are judged alike, one by one.
    """
    counted = cut(with_counts(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")).drop("text"))
    limits = cut(cutoffs(counted, labels, risk, delta))
    return verdict(counted, limits).select("doc_id", f"{COUNTS}.*", "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all their columns."""
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum"), body)
    counted = cut(with_counts(rows).drop("text"))
    limits = cut(cutoffs(counted, labels, risk, delta))
    return verdict(counted, limits).where("kept").select("__doc.*")
