"""Benchmark decontamination with a generalised suffix automaton (operator 1).

The items' words form one suffix automaton: its states are the word sequences that occur in some item, and running a
text through it gives, after every word, the longest match that ends there. A window is 13 consecutive words of an
item, or all words of a shorter one; a match of 13 words or more ends in the window made of its last 13, and the
shorter windows are found along the suffix links. Words are compared by 64-bit hashes.

Items are taken in blocks of bounded size, one automaton each, broadcast as text and built once per worker. A block
is one map over the documents; what the blocks find is carried along in the row, so there is no shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.llm import words
from pitlane.llm.kept import keep
from pitlane.session import cut

WINDOW = 13
#: Characters of item text in one block (an item longer than that is a block of its own).
BLOCK_CHARS = 2_000_000
#: Blocks scanned in one stage; further ones start from a stored table.
BLOCKS_PER_STAGE = 4
#: Column that carries what was found; a struct, so that no column of the input clashes with it.
FOUND = "__contamination"
_FIELDS = "n_words long, starts array<int>, ends array<int>, items array<string>"


class Automaton:
    """The suffix automaton of some items, given as (name, words as integers)."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for w in item:
                last = self._extend(last, w)
        n = len(self.next)
        #: The state of the last ``window`` words of a match that is at least as long.
        self.window_state = [-1] * n
        self.window_items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        self.shortest = window
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.window_state[s] = s if self.length[up] < window else self.window_state[up]
        for name, item in items:
            state = 0
            for i, w in enumerate(item):
                state = self.next[state][w]
                if i >= window - 1:
                    self.window_items.setdefault(self.window_state[state], set()).add(name)
            if 0 < len(item) < window:
                self.short.setdefault(state, {}).setdefault(len(item), set()).add(name)
                self.shortest = min(self.shortest, len(item))
        #: The nearest state up the suffix links, itself included, that holds short items; -1 if none does.
        self.up = [-1] * n
        for s in order:
            self.up[s] = s if s in self.short else self.up[self.link[s]] if self.link[s] > 0 else -1

    def _copy(self, p: int, q: int, w: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, w)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, w)
        return new

    def matches(self, text: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """Start, end (exclusive) and items of every window that occurs in ``text``."""
        state = size = 0
        for i, w in enumerate(text):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            found = self.next[state].get(w)
            if found is None:
                continue
            state, size = found, size + 1
            if size >= self.window and self.length[state] >= self.window:
                yield i + 1 - self.window, i + 1, self.window_items[self.window_state[state]]
            s = self.up[state]
            while s > 0:
                for length, names in self.short[s].items():
                    if length <= size:
                        yield i + 1 - length, i + 1, names
                s = self.up[self.link[s]] if self.link[s] > 0 else -1


class Matcher:
    """Finds the windows of a block of items, given as (name, text), in pieces of text."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        known: dict[int, int] = {}
        coded = []
        for piece in words.pieces(pa.array([t for _, t in items], pa.string()), words.ALNUM, lower=True):
            for r in range(piece.rows):
                keys = piece.hashes[piece.begin(r):piece.stop[r]].tolist()
                coded.append((items[piece.first + r][0], [known.setdefault(k, len(known)) for k in keys]))
        self.automaton = Automaton(coded, window)
        order = np.array(sorted(known), np.uint64)
        self.keys, self.codes = order, np.array([known[k] for k in order.tolist()], np.int64)

    def find(self, piece: words.Piece) -> dict[int, tuple[set[tuple[int, int]], set[str]]]:
        """By row: the word spans and the items found. Only runs of known words long enough for a window are run."""
        if not len(self.keys) or not len(piece.hashes):
            return {}
        at = np.minimum(np.searchsorted(self.keys, piece.hashes), len(self.keys) - 1)
        known = self.keys[at] == piece.hashes
        n = len(known)
        head = np.zeros(n + 1, bool)
        head[piece.stop] = True
        head[0] = True
        begin = np.flatnonzero(known & (head[:n] | ~np.concatenate([[False], known[:-1]])))
        end = np.flatnonzero(known & (head[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = end - begin >= self.automaton.shortest
        codes, out = self.codes[at], {}
        for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            for start, stop, names in self.automaton.matches(codes[b:e].tolist()):
                row = int(np.searchsorted(piece.stop, b, side="right"))
                spans, items = out.setdefault(row, (set(), set()))
                base = b - piece.begin(row)
                spans.add((base + start, base + stop))
                items |= names
        return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items in id order, a block at a time; no more than a block is on the driver."""
    block, size = [], 0
    rows = items.where("text IS NOT NULL").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").orderBy("item", "text")
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    yield block


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the struct :data:`FOUND`: n_words, the joined word spans and the items found.

    A null text has no words. Items that share an id are one item; an item without an id is named ''. With no items
    nothing is found.
    """
    start = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("starts"),
                     F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("items"))
    df = docs.withColumn(FOUND, start)
    for k, block in enumerate(_blocks(items)):
        if k and k % BLOCKS_PER_STAGE == 0:
            df = cut(df)
        df = _scan(df, block, window)
    return df


def _scan(df: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(block)
    columns, key = list(df.columns), uuid.uuid4().hex
    text, found = columns.index("text"), columns.index(FOUND)
    kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                      ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = keep(("items", key), lambda: Matcher(held.value, window))
        for batch in batches:
            for piece in words.pieces(batch.column(text), words.ALNUM, lower=True):
                rows = batch.slice(piece.first, piece.rows)
                before = rows.column(found)
                counts = np.diff(np.concatenate([[0], piece.stop]))
                starts, ends, names = (before.field(f).to_pylist() for f in ("starts", "ends", "items"))
                for row, (spans, items) in matcher.find(piece).items():
                    spans = joined([*zip(starts[row], ends[row], strict=True), *spans])
                    starts[row], ends[row] = [s for s, _ in spans], [e for _, e in spans]
                    names[row] = sorted(items.union(names[row]))
                now = pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [now if i == found else c for i, c in enumerate(rows.columns)], names=columns)

    return df.mapInArrow(scan, df.schema)


def _n_hit() -> Column:
    sizes = F.zip_with(F.col(f"{FOUND}.starts"), F.col(f"{FOUND}.ends"), lambda a, b: (b - a).cast("long"))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)


def contaminated(share: float = 0.05) -> Column:
    """A window was found and the hit words are at least ``share`` of all."""
    return (_n_hit() > 0) & (_n_hit() * round(1 / share) >= F.col(f"{FOUND}.n_words"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    names = F.col(f"{FOUND}.items")
    return find(docs.select("doc_id", "text"), items).select(
        "doc_id", f"{FOUND}.n_words", _n_hit().alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:bounds[a][0]])
        at = bounds[b - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, items: DataFrame, share: float = 0.05, length: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows, and without the spans of at least ``length`` words in the others.

    ``n_chars``, where there is such a column, follows the text. Rows without spans are passed on as they are.
    """
    columns, schema = docs.columns, docs.schema
    kept = find(docs, items).where(~contaminated(share))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(columns))
            starts, ends = found.field("starts").to_pylist(), found.field("ends").to_pylist()
            data = dict(zip(columns, batch.columns, strict=False))
            hit = [i for i, s in enumerate(starts) if any(b - a >= length for a, b in zip(s, ends[i], strict=True))]
            if hit:
                text = data["text"].to_pylist()
                for i in hit:
                    text[i] = without_spans(
                        text[i], [(a, b) for a, b in zip(starts[i], ends[i], strict=True) if b - a >= length])
                data["text"] = pa.array(text, batch.schema.field("text").type)
                if "n_chars" in data:
                    size = data["n_chars"].to_pylist()
                    for i in hit:
                        size[i] = len(text[i])
                    data["n_chars"] = pa.array(size, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(data.values()), names=columns)

    return kept.mapInArrow(remove, schema)
