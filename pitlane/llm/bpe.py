"""Byte-level BPE (operator 13): encoding by merge ranks and decoding, for pre-tokens of any length.

A pre-token is a linked list of ids. Every adjacent pair that merges waits in the bucket of its rank, by the position
of its left part. A hierarchical bitmap marks the buckets in use; find-first-set down its levels names the lowest
rank, whose leftmost position is merged next. Entries whose pair has changed meanwhile are skipped when they come up,
so a merge costs the bitmap's few levels however long the pre-token is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.llm.kept import keep

#: Pre-tokens in each of a worker's two generations of memory, and the longest of them in characters; others are merged
#: each time they occur.
REMEMBERED, SHORT = 1 << 19, 48
#: Longest text, in characters, whose pre-tokens are listed at once; pre-tokens in a run of a longer one; ids that leave
#: a task at once.
LISTED, RUN, PIECE = 1 << 18, 1 << 16, 1 << 20
#: Bits of a word of the bitmap.
WORD = 8


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Memory(dict):
    """Ids of pre-tokens as bytes. Full, it becomes the old generation; what is asked for again is taken over from
    there, so frequent pre-tokens stay."""

    def __init__(self, merge: Callable[[bytes], list[int]], limit: int = REMEMBERED) -> None:
        super().__init__()
        self.merge, self.limit, self.old = merge, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.merge(piece.encode())).tobytes()
        if len(piece) <= SHORT:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """A vocabulary with its merges.

    The queue of a merge: ``buckets`` has a heap of positions per rank, ``words`` a bit per rank in words of 2^WORD
    bits, and a last word has a bit per word that is not zero. All are empty again when a merge ends. The queue is
    worked in place, since a call for every entry would take as long as the entry itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks lack some single bytes")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        #: Every split of a token into two tokens: as many entries as the vocabulary has such splits.
        self.pairs = {(left, right): rank for token, rank in ranks.items() for i in range(1, len(token))
                      if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        size = max(ranks.values()) + 1
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.words = [0] * ((size >> WORD) + 1)
        self.bits = [1 << i for i in range(max(1 << WORD, len(self.words)))]
        self.word = [rank >> WORD for rank in range(size)]
        self.bit = [self.bits[rank & (1 << WORD) - 1] for rank in range(size)]
        self.pattern = regex.compile(pattern)
        self.memory = _Memory(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        pair, buckets, words, bits, word, bit = self.pairs.get, self.buckets, self.words, self.bits, self.word, self.bit
        ids = [self.byte[b] for b in piece]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        top = 0
        for i, rank in enumerate(map(pair, pairwise(ids))):
            if rank is not None:
                buckets[rank].append(i)
                words[word[rank]] |= bit[rank]
                top |= bits[word[rank]]
        while top:
            # Find-first-set: the lowest word in use, its lowest rank, and of that the leftmost position.
            at = (top & -top).bit_length() - 1
            low = words[at] & -words[at]
            rank = (at << WORD) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[at] ^= low
                if not words[at]:
                    top ^= bits[at]
            j = right[i]
            if j >= n or pair((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (after := pair((rank, ids[k]))) is not None:
                    heappush(buckets[after], i)
                    words[word[after]] |= bit[after]
                    top |= bits[word[after]]
            if (p := left[i]) >= 0 and (before := pair((ids[p], rank))) is not None:
                heappush(buckets[before], p)
                words[word[before]] |= bit[before]
                top |= bits[word[before]]
        return [t for t in ids if t >= 0]

    def _runs(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LISTED:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(found, RUN)):
            yield run

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. The pre-tokens of a long one are taken in runs, so that only its ids grow with it."""
        known = self.memory.__getitem__
        return np.frombuffer(b"".join([b"".join(map(known, run)) for run in self._runs(text)]), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


def _model(key: tuple, ranks: dict[bytes, int], pattern: str) -> ByteBpe:
    """This worker's vocabulary, kept for its next tasks."""
    return keep(("ranks", key), lambda: ByteBpe(ranks, pattern))


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum([0] + [len(x) for x in lists]), pa.int32()),
        pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the text of every row as ids.

    The vocabulary is read on the driver and broadcast; its file bounds its size. A null or empty text has an empty
    list; rows that repeat an id are encoded each on its own; other columns are ignored; an empty table gives no rows.
    One map, no shuffle; a task holds a batch, one text and its ids.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model((ranks_path, pattern), shared.value, pattern)
        for batch in batches:
            names, lists, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(doc_id.as_py())
                lists.append(bpe.encode(text.as_py() or ""))
                size += len(lists[-1])
                if size >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _lists(lists)], names=["doc_id", "ids"])
                    names, lists, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _lists(lists)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        turn, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, data: the bytes of every row's ids (those of a cut-off text need not be whole characters).

    Null ids give null, an empty list gives no bytes; an id outside the vocabulary raises KeyError.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model((ranks_path, pattern), shared.value, pattern)
        for batch in batches:
            data = [bpe.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(turn, "doc_id long, ids array<int>, data binary")


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts and digests of every row's ids and of the bytes decoded from them."""
    found = decode(encode(docs, ranks_path, pattern), ranks_path, pattern)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"))
