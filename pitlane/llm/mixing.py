"""Mixing to target weights with soft membership (operator 4).

A classifier trained on the labelled table gives every document a posterior over domains. The rates r >= 0 at which
documents are taken bring the expected token totals of the domains, sum of r n p, to their targets; of all such rates
they are the ones nearest to 1, by squares weighted with tokens. They are r = max(0, 1 - p z) for one vector z of as many
numbers as domains, the minimum of a convex function: z is all the state there is, a round sums a stored table of
posteriors once, and the rate of any document follows from its posterior alone. A round is a proximal Newton step: a
penalty on leaving the last round's z steadies it and does not move the optimum. Targets that no rates can meet are
reported; the penalty is then on leaving z = 0, so that rates stay moderate.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.llm import words
from pitlane.llm.kept import forget
from pitlane.session import cut

DOMAINS = ("clean", "poor", "toxic")
#: Shares of all tokens that the mix should have.
TARGETS = {"clean": 0.90, "poor": 0.04, "toxic": 0.06}
#: Labelled rows of each domain the classifier learns from at most, drawn by the hash of their ids.
SAMPLE = 4000
BUCKETS, WORDS_USED = 1 << 14, 400
#: Rounds at most, the weight of the penalty in the first, the parts of a step that are tried, and how near a share must be.
ROUNDS, PENALTY, STEPS, NEAR = 60, 1e-3, (1, 1 / 2, 1 / 8, 1 / 32), 1e-6
#: Targets that need rates this far from 1, as root mean square over the tokens, count as out of reach.
FAR = 100
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!", np.uint8))
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)


def domain(quality: Column, toxic: Column) -> Column:
    """The domain a pair of labels stands for; null where a label is missing."""
    return (F.when(toxic == 1, F.lit("toxic")).when(quality.isNull() | toxic.isNull(), F.lit(None))
            .when(quality == 0, F.lit("poor")).otherwise(F.lit("clean")))


def _numbers(piece: words.Piece) -> np.ndarray:
    """Per row: symbol and upper-case bytes per byte, different words per word, bytes per word, log of words."""
    n = np.diff(np.concatenate([[0], piece.stop]))
    size = np.maximum(np.diff(piece.bounds), 1)
    row = np.repeat(np.arange(piece.rows), n)
    sums = [np.concatenate([[0], np.cumsum(t[piece.raw])]) for t in (_SYMBOLS, _UPPER)]
    order = np.lexsort((piece.hashes, row))
    first = np.ones(len(row), bool)
    first[1:] = (piece.hashes[order][1:] != piece.hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    different = np.bincount(row[order][first], minlength=piece.rows)
    return np.column_stack([
        *[np.diff(s[piece.bounds]) / size for s in sums],
        different / np.maximum(n, 1), np.minimum(size / np.maximum(n, 1), 50) / 10, np.log1p(n) / 10])


@dataclass(frozen=True)
class Classifier:
    """Softmax regression on the presence of chosen word buckets and a few ratios; ``seen`` tells the domains that had
    an example."""

    buckets: np.ndarray
    weights: np.ndarray
    seen: np.ndarray

    def posteriors(self, piece: words.Piece) -> np.ndarray:
        place = np.full(BUCKETS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        at = place[(piece.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
        row = np.repeat(np.arange(piece.rows), np.diff(np.concatenate([[0], piece.stop])))
        present = np.zeros((piece.rows, len(self.buckets) + 6))
        present[row[at >= 0], at[at >= 0]] = 1
        present[:, -6:-1], present[:, -1] = _numbers(piece), 1
        return _softmax(present @ self.weights)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Learn from at most ``sample`` labelled rows of each domain that are in ``docs``; None if there are none.

    A drawn row stands for as many labelled rows of its domain as were there for each drawn one.
    """
    marks = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain")).where(
        "doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    marks = cut(marks.join(docs.select("doc_id"), "doc_id", "left_semi"))
    there = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}  # a row a domain
    drawn = reduce(DataFrame.unionAll, [marks.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        sample) for d in DOMAINS])
    # at most `sample` rows a domain
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "domain", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in words.pieces(batch.column(2), words.ALNUM, lower=True):
                found = [np.unique((piece.hashes[piece.begin(r):piece.stop[r]] & np.uint64(BUCKETS - 1)).astype(
                    np.int32)) for r in range(piece.rows)]
                part = batch.slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32())),
                    pa.array(list(_numbers(piece)), pa.list_(pa.float64()))], names=["doc_id", "domain", "b", "x"])

    got = rows.mapInArrow(features, "doc_id long, domain string, b array<int>, x array<double>").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "domain"], kind="stable").drop_duplicates("doc_id")
    y = np.array([DOMAINS.index(d) for d in got["domain"]])
    weight = np.array([there.get(d, 0) for d in DOMAINS]) / np.maximum(np.bincount(y, minlength=len(DOMAINS)), 1)
    return fit(list(got["b"]), np.vstack(got["x"]), y, weight[y])


def fit(buckets: list[np.ndarray], numbers: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None,
        rounds: int = 400) -> Classifier:
    """Softmax regression by gradient steps with momentum, on the buckets that part the domains best; ``weight`` is how
    many rows each one stands for."""
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    row = np.repeat(np.arange(len(y)), [len(b) for b in buckets])
    bucket = np.concatenate(buckets).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    share = np.bincount(y, minlength=len(DOMAINS)) / len(y)
    seen = np.stack([np.bincount(bucket, weights=y[row] == d, minlength=BUCKETS) for d in range(len(DOMAINS))])
    total = seen.sum(axis=0)
    expected = total * share[:, None]
    lean = np.abs(seen - expected) / np.sqrt(expected * (1 - share[:, None]) + 0.5)
    chosen = np.sort(np.argsort(-lean.max(axis=0), kind="stable")[:WORDS_USED])
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen) + 6))
    at = place[bucket]
    x[row[at >= 0], at[at >= 0]] = 1
    x[:, -6:-1], x[:, -1] = numbers, 1
    aim = np.eye(len(DOMAINS))[y]
    weights, speed = np.zeros((x.shape[1], len(DOMAINS))), np.zeros((x.shape[1], len(DOMAINS)))
    scale = 4.0 / (np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 / len(y))
    for k in range(rounds):
        ahead = weights + 0.9 * speed
        slope = x.T @ ((_softmax(x @ ahead) - aim) * weight[:, None]) / len(y) + 1e-4 * ahead
        speed = 0.9 * speed - 0.25 * scale * slope
        weights = weights + speed
    return Classifier(chosen, weights, share > 0)


@dataclass
class Mix:
    """What the solver learnt: the vector z, the totals reached, the targets, and the domains that miss theirs."""

    model: Classifier | None
    z: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    reached: np.ndarray | None = None
    targets: np.ndarray | None = None
    missed: tuple[str, ...] = ()


def rates(posteriors: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The rate of each document."""
    return np.maximum(0.0, 1.0 - posteriors @ z)


def _posteriors(model: Classifier, piece: words.Piece) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(np.concatenate([[0], piece.stop])).astype(np.int64), model.posteriors(piece)


def solve(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> Mix:
    """Train the classifier and find the steps that bring the mix of ``docs`` to ``targets`` (shares of all tokens).

    Ends when every share is met to :data:`NEAR`, or after :data:`ROUNDS` rounds; a warning and ``missed`` then name the
    domains that are not. A domain without a labelled example has no target, the others share what it does not hold.
    Without labelled rows or without tokens every rate is 1.
    """
    targets = targets or TARGETS
    model = train(docs, labels)
    if model is None:
        return Mix(None)
    k = len(DOMAINS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in words.pieces(batch.column(0), words.ALNUM, lower=True):
                n, p = _posteriors(model, piece)
                yield pa.RecordBatch.from_arrays([pa.array(n), *[pa.array(p[:, d]) for d in range(k)]],
                                                 names=["n", *DOMAINS])

    scored = cut(docs.select("text").mapInArrow(score, "n long, " + ", ".join(f"{d} double" for d in DOMAINS)))
    columns = ["n", "square", *DOMAINS, *[f"{a}_{b}" for a in DOMAINS for b in DOMAINS]]

    def totals(tries: list[np.ndarray]) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
        """At the rates of each z: tokens, squared rates, expected tokens by domain, Gram matrix of the rows not at 0."""
        names = [f"{c}_{i}" for i in range(len(tries)) for c in columns]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(tries), len(columns)))
            for batch in batches:
                n, *p = (c.to_numpy() for c in batch.columns)
                p = np.column_stack(p)
                for i, z in enumerate(tries):
                    r = rates(p, z)
                    free = (p * (n * (r > 0))[:, None]).T @ p
                    sums[i] += [n.sum(), n @ r ** 2, *((n * r) @ p), *free.ravel()]
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(names, sums.ravel(), strict=True)})

        parts = scored.mapInArrow(add, ", ".join(f"{c} double" for c in names))
        got = np.array([float(x or 0) for x in parts.agg(*[F.sum(c) for c in names]).first()])
        return [(t[0], t[1], t[2:k + 2], t[k + 2:].reshape(k, k)) for t in got.reshape(len(tries), -1)]

    mix = Mix(model)
    seen = model.seen
    start = totals([mix.z])[0]
    n, _, now, _ = start
    if not n:
        return Mix(None)
    wanted = np.array([targets[d] for d in DOMAINS]) * seen
    mix.targets = np.where(seen, (n - now[~seen].sum()) * wanted / max(wanted.sum(), 1e-12), now)

    def search(recentre: bool) -> bool:
        """Go down from z = 0; the penalty is on leaving the last z, each round less, or else on leaving 0."""
        mix.z, at, weight = np.zeros(k), start, PENALTY * n
        value = at[1] / 2
        for _ in range(ROUNDS):
            mix.reached = at[2]
            slope = np.where(seen, mix.targets - at[2] + (0 if recentre else weight * mix.z), 0)
            if np.abs(slope).max() <= NEAR * n:
                return True
            step = np.linalg.solve(at[3] * np.outer(seen, seen) + weight * np.eye(k), slope)
            tries = [mix.z - step * part for part in STEPS]
            found = totals(tries)
            values = [f[1] / 2 + mix.targets @ z + (0 if recentre else weight / 2 * (z @ z))
                      for f, z in zip(found, tries, strict=True)]
            best = int(np.argmin(values))
            if values[best] < value:
                mix.z, at, value = tries[best], found[best], values[best]
                weight = weight / 4 if recentre else weight
                if recentre and value < n / 2 * (1 - FAR ** 2):  # all rates that meet the targets are so far from 1
                    return False
            elif recentre:
                weight *= 16
            else:
                break
        mix.reached = at[2]
        return False

    if not search(recentre=True):
        search(recentre=False)
        off = np.abs(mix.reached - mix.targets) > NEAR * n
        mix.missed = tuple(d for d, s, o in zip(DOMAINS, seen, off, strict=True) if s and o)
        shares = [f"{d} {g / n:.4f} instead of {t / n:.4f}" for d, g, t in
                  zip(DOMAINS, mix.reached, mix.targets, strict=True) if d in mix.missed]
        warnings.warn("shares of tokens that no rates bring to their targets: " + ", ".join(shares), stacklevel=3)
    return mix


def copies(rate: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each document is taken: its rate rounded up or down by a draw from its hash."""
    draw = words.mix(hashes.view(np.uint64)) >> np.uint64(11)
    return np.floor(rate + draw.astype(np.float64) / float(1 << 53)).astype(np.int64)


def _apply(docs: DataFrame, mix: Mix, build, schema) -> DataFrame:
    """Run ``build(rows, n, posteriors, rates, copies)`` over the rows; the columns it gets end with the draw's hash."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch.column(at), words.ALNUM, lower=True):
                rows = batch.slice(piece.first, piece.rows)
                n = np.diff(np.concatenate([[0], piece.stop])).astype(np.int64)
                p = mix.model.posteriors(piece) if mix.model else np.full((piece.rows, len(DOMAINS)), 1 / len(DOMAINS))
                rate = rates(p, mix.z)
                yield build(rows, n, p, rate, copies(rate, rows.column(rows.num_columns - 1).to_numpy()))

    # Copies of a text are drawn apart by their ids, rows without an id by their texts.
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select("*", draw.alias("__draw")).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens (words), the posteriors, rate, and copies taken.

    A null or empty text has no tokens; its posterior is that of an empty text.
    """
    docs = docs.select("doc_id", "text")
    mix = solve(docs, labels, targets)

    def build(rows, n, p, rate, taken) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(n), *[pa.array(p[:, d]) for d in range(len(DOMAINS))], pa.array(rate),
             pa.array(taken)], names=["doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"])

    schema = "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double, copies long"
    return _apply(docs, mix, build, schema)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all its columns."""
    mix = solve(docs.select("doc_id", "text"), labels, targets)

    def build(rows, n, p, rate, taken) -> pa.RecordBatch:
        return rows.drop_columns(["__draw"]).take(pa.array(np.repeat(np.arange(rows.num_rows), taken)))

    return _apply(docs, mix, build, docs.schema)
