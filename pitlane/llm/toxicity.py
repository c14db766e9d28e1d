"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Each is made of the letter sequences that
are much more frequent in its class than in the other, followed by a common part of the words that most ordinary texts
share, so that ordinary words compress alike. A window is a word with the spaces around it, after a lead-in that both dictionaries
hold: the lead-in makes the fixed bytes of a frame the same for both, and even a short match shows. Its distance is
the bytes it takes with the ordinary dictionary less those it takes with the toxic one. A logistic curve over a few
statistics of a text's distances, fitted on labelled texts that the dictionaries have not seen, gives the score.

Only the text is used. Dictionaries and curve are fitted on a bounded sample of labelled rows, on their whole texts:
tasks count sequences and words and measure texts, the driver sees counts, the sequences chosen and the statistics.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.session import cut

#: Labelled rows of each class used at most, drawn by the hash of their ids.
SAMPLE = 2500
LEVEL, COMMON_BYTES, OWN_BYTES = 9, 1024, 3072
LEAD_IN = b"<0123456789|ABCDEFGHIJKLMNOPQRSTUVWXYZ|~!@^&()_+{}:;?/,.=-0987654321>"
#: zstandard looks for no match that begins in the last eight bytes of its input; these follow every window.
LEAD_OUT = bytes(range(1, 9))
#: Distances that a worker remembers, of words of up to so many bytes.
REMEMBERED, SHORT = 200_000, 64
#: Bytes of a sequence, short and long; the texts of a class it must be in; how much more frequent it must be there; and a bound on the
#: probability of such counts were it as frequent in both classes.
GRAMS, LEAST, RATIO, CHANCE = (5, 8), 5, 4, 1e-5
#: Counts that a task holds before it puts them out.
HELD = 200_000
THRESHOLD = 0.3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def _grams(words: list[bytes]) -> set[bytes]:
    """The sequences within the words of a text; a word's ends count as spaces."""
    padded = {b" " + w + b" " for w in words}
    return {w[i:i + n] for w in padded for n in GRAMS for i in range(len(w) - n + 1)}


def _frequent(own: Column, n: int, other: Column, m: int) -> Column:
    """Whether a sequence in ``own`` of n texts of a class and ``other`` of m of the other one marks the first class."""
    share, there = n / (n + m), own / (own + other)
    apart = there * F.log(there / share) + F.when(other > 0, (1 - there) * F.log((1 - there) / (1 - share))).otherwise(0)
    return (own >= LEAST) & (own * m > RATIO * (other + 1) * n) & ((own + other) * apart > float(-np.log(CHANCE)))


def _marked(words: list[bytes], chosen: set[bytes]) -> bytes:
    """The different stretches of the words that chosen sequences cover, one after the other."""
    out = []
    for w in dict.fromkeys(words):
        padded = b" " + w + b" "
        start = end = -1
        for i in range(len(padded)):
            size = next((n for n in reversed(GRAMS) if padded[i:i + n] in chosen), 0)
            if not size:
                continue
            if start >= 0 and i >= end:
                out.append(padded[start:end])
                start = -1
            start, end = (i if start < 0 else start), max(end, i + size)
        if start >= 0:
            out.append(padded[start:end])
    return b"".join(dict.fromkeys(out))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary. A sample of fewer than 9 bytes is repeated, since zstandard takes no shorter ones; where the samples
    are too few or too small to train on, the dictionary is those that most texts have, the most frequent last."""
    kept = [s * (8 // len(s) + 1) for s in samples if s]
    try:
        return zstandard.train_dictionary(size, kept).as_bytes()
    except zstandard.ZstdError:
        out = b""
        for s, _ in sorted(Counter(s for s in samples if s).items(), key=lambda x: (-x[1], x[0])):
            if s not in out and len(s) + len(out) <= size:
                out = s + out
        return out


@dataclass(frozen=True)
class Detector:
    """Both dictionaries and the curve; without a curve the score is the share of toxic labels."""

    ordinary: bytes
    toxic: bytes
    curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    prior: float

    def scorer(self):
        """A function from texts to scores; compressors are not shared between processes."""
        curve = self.curve
        if curve is None:
            return lambda texts: np.full(len(texts), self.prior)
        measure = _measure(self.ordinary, self.toxic)
        mean, scale, weights = curve

        def score(texts: list[str | None]) -> np.ndarray:
            x = (np.array([measure(_words(t)) for t in texts]).reshape(-1, len(mean)) - mean) / scale
            return _logistic(np.column_stack([x, np.ones(len(x))]) @ weights)

        return score


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _measure(ordinary: bytes, toxic: bytes):
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content + LEAD_IN, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False)

    with_ordinary, with_toxic = compressor(ordinary), compressor(toxic)
    known: dict[bytes, int] = {}

    def distance(word: bytes) -> int:
        if (d := known.get(word)) is None:
            window = LEAD_IN + b" " + word + b" " + LEAD_OUT
            d = len(with_ordinary.compress(window)) - len(with_toxic.compress(window))
            if len(word) <= SHORT:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = d
        return d

    def measure(words: list[bytes]) -> list[float]:
        d = np.sort(np.array([distance(w) for w in words] or [0], float))[::-1]
        return [d[0], d[:3].mean(), d[:10].mean(), d.mean(), np.log1p(len(d)),
                *[np.log1p((d >= k).sum()) for k in (1, 2, 3, 4, 5, 6)], *[(d >= k).mean() for k in (1, 2, 3, 4, 5)],
                (d < 0).mean(), (d < -2).mean()]

    return measure


def _texts_with(rows: DataFrame, part: dict[int, tuple[int, bool]], found) -> DataFrame:
    """item, ordinary, toxic: in how many learning texts of each class ``found`` has an item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            items = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(items, pa.binary()), *[pa.array([c[i] for i in items], pa.int64()) for c in seen]],
                names=["item", "ordinary", "toxic"])
            for c in seen:
                c.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                label, learn = part.get(doc, (0, False))
                if learn:
                    seen[label].update(found(_words(text.as_py())))
                    if len(seen[0]) + len(seen[1]) > HELD:
                        yield out()
        yield out()

    return rows.select("doc_id", "text").mapInArrow(count, "item binary, ordinary long, toxic long").groupBy("item").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _per_text(rows: DataFrame, wanted: set[int], make, kind: str, arrow: pa.DataType) -> dict[int, object]:
    """By id, in their order, what ``make()`` gives for the words of each wanted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = make()
        for batch in batches:
            got = [(doc, value(_words(text.as_py()))) for doc, text in
                   zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if doc in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()),
                                              pa.array([v for _, v in got], arrow)], names=["doc_id", "value"])

    table = rows.select("doc_id", "text").mapInArrow(run, f"doc_id long, value {kind}").toArrow()
    return dict(sorted(zip(*[c.to_pylist() for c in table.columns], strict=True)))


def _common(texts_with: DataFrame) -> bytes:
    """The words that ordinary texts share most, by the bytes they stand for, until the common part is full."""
    worth = F.col("ordinary") * F.length("item")
    top = texts_with.where("ordinary > 0").where(F.length("item").between(2, SHORT)).orderBy(worth.desc(), "item").limit(
        COMMON_BYTES).select("item").toArrow()  # a word a byte at most
    out = b" "
    for word in top.column(0).to_pylist():
        if b" " + word + b" " not in out and len(out) + len(word) < COMMON_BYTES:
            out += word + b" "
    return out


def fit(rows: DataFrame, prior: float) -> Detector:
    """Fit on stored ``rows`` (doc_id, toxic, text), an id once. Of texts that are the same the first id's counts. Two
    thirds of the texts make the dictionaries, every third one the curve; both classes in both parts."""
    ids = rows.select("doc_id", "toxic", F.sha2("text", 256).alias("hash")).toPandas().sort_values("doc_id")
    ids = ids.drop_duplicates("hash")
    doc, toxic = ids["doc_id"].to_numpy(), ids["toxic"].to_numpy()
    turn = np.empty(len(ids), int)
    for label in (0, 1):
        turn[toxic == label] = np.arange((toxic == label).sum())
    learn = turn % 3 > 0
    sizes = [int((learn & (toxic == label)).sum()) for label in (0, 1)]
    y = toxic[~learn]
    if min(sizes) < 5 or len(set(y.tolist())) < 2:
        return Detector(b"", b"", None, prior)
    part = {int(d): (int(t), bool(b)) for d, t, b in zip(doc, toxic, learn, strict=True)}
    common = _common(_texts_with(rows, part, set))
    a, b = F.col("ordinary"), F.col("toxic")
    marks = (_frequent(a, sizes[0], b, sizes[1]), _frequent(b, sizes[1], a, sizes[0]))
    frequent = _texts_with(rows, part, _grams).withColumn("label", F.when(marks[0], 0).when(marks[1], 1)).where(
        "label IS NOT NULL").select("item", "label").toArrow()
    chosen: tuple[set[bytes], set[bytes]] = (set(), set())
    for item, label in zip(*[c.to_pylist() for c in frequent.columns], strict=True):
        chosen[label].add(item)
    own = []
    for label in (0, 1):
        texts = {d for d, (t, used) in part.items() if used and t == label}
        own.append(_dictionary(list(_per_text(rows, texts, lambda c=chosen[label]: lambda w: _marked(w, c), "binary",
                                              pa.binary()).values()), OWN_BYTES))
    held = {d for d, (_, used) in part.items() if not used}
    found = _per_text(rows, held, lambda: _measure(own[0] + common, own[1] + common), "array<double>", pa.list_(pa.float64()))
    x = np.array([found[d] for d in doc[~learn].tolist()])
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b, pull = np.zeros(z.shape[1]), 1e-3 * weight.sum()
    for _ in range(60):
        p = _logistic(z @ b)
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + pull * np.eye(len(b))
        step = np.linalg.solve(curve, z.T @ (weight * (p - y)) + pull * b)
        b = b - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return Detector(own[0] + common, own[1] + common, (mean, scale, b), prior)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Detector:
    """Fit on at most :data:`SAMPLE` rows of each class, whole texts, none of them held out. Rows without an id or label are not
    used; an id with both labels counts as toxic."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}  # two rows
    if not totals:
        return Detector(b"", b"", None, 0.0)
    prior = totals.get(1, 0) / sum(totals.values())
    order = F.xxhash64("doc_id")
    drawn = marks.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE).unionAll(
        marks.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE))
    rows = docs.where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")  # at most twice SAMPLE rows
    return fit(cut(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))), prior)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), over the whole text.

    A null or empty text counts as one window of distance 0. A row without an id is not held out. Without labels of both
    classes every score is the share of toxic ones.
    """
    detector = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = detector.scorer()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scorer(part.column(2).to_pylist()), pa.float64())],
                    names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
