"""Token-ID files: patched frame-of-reference blocks (operator 9).

A file holds the ids of consecutive documents. Ids are cut into blocks of 128. A block stores its minimum, the
differences from it packed at the width that holds a set share of them, and the rest as exceptions (position and
whole difference). A block index gives the byte at which each block starts, so any range of ids is read by decoding
only its blocks.

Layout, little-endian::

    magic 8 bytes | u64 ids, documents, blocks
    i64 document id, u8 "has an id" and u64 end (in ids) of each document
    u64 start of each block, counted from the first, and the end of the last
    blocks: u32 minimum | u8 width | u8 exceptions | packed differences | u8 positions | u32 differences
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.llm import words
from pitlane.llm.kept import keep
from pitlane.session import cut, shared_folder

BLOCK = 128
MAGIC = b"PFORIDS1"
END_ID = 2
_BITS = np.uint32(1) << np.arange(32, dtype=np.uint32)


# ---------------------------------------------------------------- the format


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Blocks of ``ids`` and where each starts (one more entry: the end)."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return b"", np.zeros(1, np.uint64)
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[:len(ids)] = ids
    padded[len(ids):] = ids[-1]
    grid = padded.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    at = int(np.ceil(share * BLOCK)) - 1
    bound = np.partition(delta, at, axis=1)[:, at]
    width = np.searchsorted(_BITS, bound, side="right").astype(np.int64)
    over = delta >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    over[width == 32] = False
    n_over = over.sum(axis=1)
    sizes = 6 + width * (BLOCK // 8) + 5 * n_over
    starts = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    out = np.zeros(starts[-1], np.uint8)
    head = starts[:-1]
    out[head[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[head + 4] = width
    out[head + 5] = n_over
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                bits = (delta[part][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
                packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
                out[head[part][:, None] + 6 + np.arange(w * BLOCK // 8)] = packed
    block, where = np.nonzero(over)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    base = head[block] + 6 + width[block] * (BLOCK // 8)
    out[base + rank] = where
    spot = base + n_over[block] + 4 * rank
    out[spot[:, None] + np.arange(4)] = delta[block, where].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype(np.uint64)


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` (the last entry is the end), padding included."""
    n_blocks = len(starts) - 1
    head = starts[:-1].astype(np.int64)
    low = data[head[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, n_over = data[head + 4].astype(np.int64), data[head + 5].astype(np.int64)
    grid = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                packed = data[head[part][:, None] + 6 + np.arange(w * BLOCK // 8)]
                bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
                full = np.zeros((len(part), BLOCK, 32), np.uint8)
                full[:, :, :w] = bits
                grid[part] = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
    block = np.repeat(np.arange(n_blocks), n_over)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    base = head[block] + 6 + width[block] * (BLOCK // 8)
    spot = base + n_over[block] + 4 * rank
    grid[block, data[base + rank]] = data[spot[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (grid + low[:, None]).ravel()


def encode_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents, their ends counted in ids, and all their ids."""
    body, starts = encode_blocks(ids)
    counts = np.array([len(ids), len(doc_ids), len(starts) - 1], "<u8")
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, counts.tobytes(), keys.tobytes(), known.tobytes(), ends.astype("<u8").tobytes(),
                     starts.astype("<u8").tobytes(), body])


class TokenFile:
    """A file's documents, and its ids by range."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, n_docs, n_blocks = (int(x) for x in np.frombuffer(content, "<u8", 3, 8))
        at = 32
        keys = np.frombuffer(content, "<i8", n_docs, at)
        known = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [int(k) if h else None for k, h in zip(keys, known, strict=True)]
        at += 9 * n_docs
        self.ends = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.starts = np.frombuffer(content, "<u8", n_blocks + 1, at)
        self.data = np.frombuffer(content, np.uint8, offset=at + 8 * (n_blocks + 1))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive) of the file; only their blocks are decoded."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        return decode_blocks(self.data, self.starts[a:b + 1])[start - a * BLOCK:stop - a * BLOCK]


# ---------------------------------------------------------------- tokens


class WordEncoder:
    """A tokenizer applied word by word, remembering the ids of recent words.

    Right for tokenizers that never join characters across ASCII white space (their pre-tokenizer drops it). About
    ``limit`` words are remembered, some 60 bytes each; then the half used least is forgotten, which costs time and changes
    nothing else.
    New words are encoded as one text, parted by a mark whose id is known; those that hold the mark go one by one.
    """

    MARK = "\x01"

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.mark = self._ids([self.MARK])[0]
        #: Hashes of known words, sorted, and the entry of each; entry 0 is the end of a document.
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.used, self.flat = np.zeros(1, np.int64), np.array([END_ID], np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, and how many each has."""
        if len(self.mark) != 1 or any(self.MARK in t for t in texts):
            found = self._ids(texts)
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts), 2048):
            ids = np.array(self._ids([f" {self.MARK} ".join([*texts[a:a + 2048], ""])])[0], np.uint32)
            marks = np.flatnonzero(ids == self.mark[0])
            sizes.append(np.diff(np.concatenate([[-1], marks])) - 1)
            parts.append(np.delete(ids, marks))
        return np.concatenate(parts), np.concatenate(sizes)

    def _forget(self) -> None:
        best = np.sort(np.argsort(-self.used[self.entry], kind="stable")[:self.limit // 2])
        keep = self.entry[best]
        size = self.size[keep]
        stop = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[keep] - stop + size, size) + np.arange(int(size.sum()))]
        self.keys, self.entry = self.keys[best], np.arange(1, len(best) + 1)
        self.begin = np.concatenate([[0], 1 + stop - size])
        self.size = np.concatenate([[1], size])
        self.used = np.concatenate([[0], self.used[keep] // 2])
        self.flat = np.concatenate([np.array([END_ID], np.uint32), flat])

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        flat, size = self._encoded(texts)
        if len(size) != len(keys):
            raise ValueError("the tokenizer joins words across white space")
        new = np.arange(len(self.begin), len(self.begin) + len(keys))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(keys), np.int64)])
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, at, keys), np.insert(self.entry, at, new)

    def encode(self, piece: words.Piece) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row ended by ``END_ID``, and where each row ends."""
        keys, first, back = np.unique(piece.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            data = piece.data.tobytes()
            where = first[new]
            self._learn(keys[new], [data[a:b].decode() for a, b in zip(
                piece.starts[where].tolist(), piece.ends[where].tolist(), strict=True)])
        entry = self.entry[np.searchsorted(self.keys, keys)]
        self.used[entry] += 1
        entry = np.insert(entry[back], piece.stop, 0)
        size = self.size[entry]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(self.begin[entry] - stop + size, size) + np.arange(total)]
        return ids, stop[piece.stop + np.arange(piece.rows)]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    return keep(("words", path), lambda: WordEncoder(path))


# ---------------------------------------------------------------- Spark


def write_token_files(docs: DataFrame, vocabulary: str, ids_per_file: int = 1 << 22) -> tuple[str, DataFrame]:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; the folder and its list of files.

    A null text is empty, a null doc_id comes first, rows that repeat an id follow each other by text, other columns
    are ignored; an empty table gives no files. Rows are range-partitioned by id and sorted inside the partitions; a
    task streams them into files of about ``ids_per_file`` ids named by partition and number. A task that runs again
    writes the same files again; each is written aside and then moved.
    """
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words_to_ids = encoder(vocabulary)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate([h[1] for h in held])
            shift = np.cumsum([0] + [len(h[1]) for h in held[:-1]])
            ends = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=True)])
            content = encode_file([d for h in held for d in h[0]], ends, ids)
            name = f"ids-{part:06d}-{number:06d}.pfor"
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path)
            aside = f"{path}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as out:
                out.write(content)
            store.move(aside, f"{path}/{name}")
            number += 1
            n_docs = len(ends)
            held.clear()
            return pa.RecordBatch.from_pydict({"file": [name], "n_ids": [len(ids)], "n_docs": [n_docs]})

        size = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for piece in words.pieces(batch.column(1), words.NON_SPACE, lower=False):
                ids, ends = words_to_ids.encode(piece)
                held.append((doc_ids[piece.first:piece.first + piece.rows], ids, ends))
                size += len(ids)
                if size >= ids_per_file:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return folder, cut(rows.mapInArrow(write, "file string, n_ids long, n_docs long"))


def read_token_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    ``start`` counts the ids of all documents before it: within its file, plus those of the files before (a running
    sum over the list of files, one small row each).
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                found = TokenFile(content.as_py())
                for a in range(0, len(found.ends), 4096):
                    ends = found.ends[a:a + 4096]
                    begin = int(found.ends[a - 1]) if a else 0
                    ids = found.ids(begin, int(ends[-1])).astype("<u4", copy=False)
                    starts = np.concatenate([[begin], ends[:-1]])
                    crc = [zlib.crc32(ids[s - begin:e - begin]) for s, e in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py().rpartition("/")[2]] * len(ends)), pa.array(found.doc_ids[a:a + 4096],
                         pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                         pa.array(crc, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    if not files.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    content = (spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.pfor").load(folder)
               .select("path", "content"))
    found = content.mapInArrow(decode, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "file").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` as token files and read them back, one row per document."""
    folder, files = write_token_files(docs, vocabulary)
    return read_token_files(docs.sparkSession, folder, files)
