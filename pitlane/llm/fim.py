"""Fill-in-the-middle (operator 11): a text is cut at two unit bounds and its parts are put in another order.

A text's UTF-8 bytes fall into blocks of fixed size. A Fenwick tree over the blocks holds, per block, how many units
end in it and how many code points begin in it. A cut after a given number of units is found by a binary-lifting
descent to its block and a look at that block alone; the same descent adds up the code points before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block.
BLOCK = 4096
#: Bytes of text that leave a task at once.
PIECE = 8 << 20
#: The marks before prefix, suffix and middle. No mark ends as another begins, so a part that holds none of them cannot
#: run together with a mark into another one, and the first mark found is the one that was put there.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _line_ends(data: np.ndarray) -> np.ndarray:
    return data == 0x0A


def _word_ends(data: np.ndarray) -> np.ndarray:
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    space[:-1] &= ~space[1:]
    return space


def _point_ends(data: np.ndarray) -> np.ndarray:
    last = np.ones(len(data), bool)
    last[:-1] = (data[1:] & 0xC0) != 0x80
    return last


#: Units by name, as a mask of the bytes that end one. What follows the last end is a unit too.
UNITS = {"line": _line_ends, "word": _word_ends, "point": _point_ends}


class BlockTree:
    """Fenwick tree over the blocks of one text: column 0 counts the units that end in a block, column 1 the code
    points that begin in it."""

    def __init__(self, data: np.ndarray, unit: str = "line", block: int = BLOCK) -> None:
        self.data, self.block = data, block
        self.ends = UNITS[unit](data)
        starts = np.arange(0, len(data), block)
        self.blocks = len(starts)
        self.tree = np.zeros((self.blocks + 1, 2), np.int64)
        if self.blocks:
            self.tree[1:, 0] = np.add.reduceat(self.ends, starts, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64)
        step = 1
        while step <= self.blocks:
            # Nodes whose lowest bit is ``step`` hand what they hold to the node above; each has one such child a level.
            child = np.arange(step, self.blocks + 1, 2 * step)
            child = child[child + step <= self.blocks]
            self.tree[child + step] += self.tree[child]
            step *= 2
        self.ended = int(self.before(self.blocks)[0])
        self.n = self.ended + int(len(data) > 0 and not self.ends[-1])

    def before(self, blocks: int) -> np.ndarray:
        """Units ended and code points begun in the first ``blocks`` blocks."""
        total = np.zeros(2, np.int64)
        while blocks:
            total += self.tree[blocks]
            blocks &= blocks - 1
        return total

    def cut(self, units: int) -> tuple[int, int]:
        """The byte after the first ``units`` units and the number of code points before it."""
        if units <= 0:
            return 0, 0
        if units > self.ended:
            return len(self.data), int(self.before(self.blocks)[1])
        at, rest, points = 0, units, 0
        for bit in reversed(range(self.blocks.bit_length())):
            up = at + (1 << bit)
            if up <= self.blocks and self.tree[up, 0] < rest:
                at = up
                rest -= int(self.tree[up, 0])
                points += int(self.tree[up, 1])
        begin = at * self.block
        stop = begin + int(np.flatnonzero(self.ends[begin:begin + self.block])[rest - 1]) + 1
        return stop, points + int(np.count_nonzero((self.data[begin:stop] & 0xC0) != 0x80))


def draws(seed: int, doc_id: int) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]


def _turned(doc_id: int | None, data: bytes, unit: str, seed: int, rate: int, spm_rate: int, block: int) -> tuple:
    tree = BlockTree(np.frombuffer(data, np.uint8), unit, block)
    if doc_id is None or not data or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return tree.n, "plain", None, None, data
    h1, h2, h3, h4 = draws(seed, doc_id)
    if h3 % 100 >= rate:
        return tree.n, "plain", None, None, data
    a, b = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (left, before), (right, until) = tree.cut(a), tree.cut(b)
    prefix, middle, suffix = data[:left], data[left:right], data[right:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_rate:
        return tree.n, "spm", before, until - before, b"".join((s, suffix, p, prefix, m, middle))
    return tree.n, "psm", before, until - before, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50,
              block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: each row's text in its fill-in-the-middle order.

    ``rate`` of 100 texts are turned, ``spm_rate`` of 100 of those suffix first; both, and the two cuts, follow from
    the seed and the id, so a task that runs again gives the same rows. A null text is empty. Plain stay: empty
    texts, texts that hold a mark, rows without an id. Rows that repeat an id are turned each on its own, by the same
    draws; equal draws give an empty middle. Other columns are ignored; an empty table gives none. One map, no
    shuffle; a task holds a batch and one text more.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; one of {', '.join(UNITS)}")
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            ids, n, form, prefix, middle, output = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                held.append((doc_id, *_turned(doc_id, data, unit, seed, rate, spm_rate, block)))
                size += len(data)
                if size >= PIECE:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(turn, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: parts are told apart by the first mark that follows them."""
    def parts(text: Column, inner: str, last: str) -> tuple[Column, Column, Column]:
        body = F.substr(text, F.lit(len(inner) + 1))
        first = F.substring_index(body, inner, 1)
        rest = F.substr(body, F.char_length(first) + F.lit(len(inner) + 1))
        second = F.substring_index(rest, last, 1)
        return first, second, F.substr(rest, F.char_length(second) + F.lit(len(last) + 1))

    prefix, suffix, middle = parts(output, SUFFIX, MIDDLE)
    spm_suffix, spm_prefix, spm_middle = parts(output, PREFIX, MIDDLE)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output))


def report(docs: DataFrame) -> DataFrame:
    """Digests of every row's output and of the text rebuilt from it."""
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
