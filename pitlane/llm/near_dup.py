"""MinHash near-duplicates by a multi-index Hamming join (operator 8).

A document's set of word shingles gets a signature of 40 components of 21 bits. Documents with a Jaccard similarity
of 0.8 differ in 8 components on average and in 20 or more with a probability of about 1e-5, so pairs within a
signature distance of 19 are candidates. The signature is split into 10 chunks of 4 components; by the pigeonhole
principle two signatures within 19 differ in at most one component of some chunk, so a key for every chunk and every
component left out of it finds all such pairs. Candidates are confirmed on the full sets (64-bit shingle hashes).

Documents with equal sets are one class from the start. Buckets are not expanded into pairs: every class is first
compared with one leader, the member that shares most, and confirmed links are joined into components. Only then are
pairs compared, inside blocks of a bucket, whose members are still in different components; a pair is looked at in the
first bucket it shares, and passed on only if its signatures are near and two upper bounds of the intersection allow a
link: the shingles that other candidates hold too, and the sizes of both sets by 256 bins of the hash. So a group of near copies costs about a pass, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.llm import words
from pitlane.llm.graph import components
from pitlane.llm.kept import forget
from pitlane.session import cut

CHUNKS, PER_CHUNK, BITS = 10, 4, 21
SIZE = CHUNKS * PER_CHUNK
DISTANCE = 2 * CHUNKS - 1
#: Rows of a bucket that are compared with as many others in one step.
BLOCK = 4096
SHINGLE = 4
BINS = 256

_ONE = np.uint64(1)
_MULTIPLY = words.mix(np.arange(1, SIZE + 1, dtype=np.uint64)) | _ONE
_ADD = words.mix(np.arange(1001, SIZE + 1001, dtype=np.uint64))
_OPEN = np.full(BINS, 255, np.uint8)
_PLACE = words.mix(np.arange(2001, 2001 + 16, dtype=np.uint64)) | _ONE


def shingles(piece: words.Piece, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, and the number of them up to the end of each row.

    A row of fewer words has one shingle, all of them; a row of none has none.
    """
    count = np.diff(np.concatenate([[0], piece.stop]))
    n = len(piece.hashes)
    row = np.repeat(np.arange(piece.rows), count)
    place = np.arange(n) - np.repeat(piece.stop - count, count)
    use = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    here = place < np.repeat(use, count)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        reach = np.repeat(np.minimum(count, size), count) > j
        shifted = np.zeros(n, np.uint64)
        shifted[:n - j] = piece.hashes[j:]
        total += np.where(reach, shifted * _PLACE[j], np.uint64(0))
    total = words.mix(total + np.repeat(np.minimum(count, size), count).astype(np.uint64))[here]
    row = row[here]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    first = np.ones(len(total), bool)
    first[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    total, row = total[first], row[first]
    return total, np.searchsorted(row, np.arange(piece.rows), side="right")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for piece in words.pieces(batch.column(1), words.NON_SPACE, lower=True):
            found, stop = shingles(piece)
            n = np.diff(np.concatenate([[0], stop]))
            full = np.flatnonzero(n)
            sketch = np.zeros((piece.rows, SIZE), np.uint32)
            sums = np.zeros((2, piece.rows), np.uint64)
            if len(full):
                begin = (stop - n)[full]
                for k in range(SIZE):
                    low = np.minimum.reduceat(found * _MULTIPLY[k] + _ADD[k], begin)
                    sketch[full, k] = words.mix(low) & np.uint64((1 << BITS) - 1)
                for k in range(2):
                    sums[k, full] = np.add.reduceat(words.mix(found ^ _ADD[k]), begin)
            data = pa.py_buffer(sketch.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(piece.first, piece.rows), pa.array(n, pa.int64()),
                pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                pa.Array.from_buffers(pa.binary(4 * SIZE), piece.rows, [None, data]).cast(pa.binary()),
            ], names=["doc_id", "n_shingles", "d1", "d2", "sig"])


def _sketch(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SIZE)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            sketch = _sketch(part.column(1)).astype(np.uint64)
            found = []
            for c in range(CHUNKS):
                for left_out in range(PER_CHUNK):
                    key = np.uint64(c * PER_CHUNK + left_out + 1)
                    total = np.full(len(sketch), key)
                    for j in range(PER_CHUNK):
                        if j != left_out:
                            total = words.mix(total * _PLACE[j] + sketch[:, c * PER_CHUNK + j])
                    found.append(total.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(found)), pa.array(np.repeat(np.arange(SIZE, dtype=np.int32), len(sketch))),
                pa.array(np.tile(np.asarray(part.column(0)), SIZE))], names=["key", "slot", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for piece in words.pieces(batch.column(1), words.NON_SPACE, lower=True):
            found, stop = shingles(piece)
            edges = np.concatenate([[0], stop]) * 8
            data = found.astype("<u8").tobytes()
            row = np.repeat(np.arange(piece.rows), np.diff(np.concatenate([[0], stop])))
            bins = np.bincount(row * BINS + (found >> np.uint64(56)).astype(np.int64), minlength=piece.rows * BINS)
            bins = bins.reshape(piece.rows, BINS)
            full = bins.max(axis=1) > 255  # a bin that does not fit a byte bounds nothing
            bins = np.where(full[:, None], 255, bins).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(piece.first, piece.rows),
                pa.array([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                pa.array([None if f else b.tobytes() for f, b in zip(full, bins, strict=True)], pa.binary()),
            ], names=["id", "set", "bins"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every shingle of every set."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            data = [np.frombuffer(x, "<i8") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(data)), pa.array(np.repeat(np.asarray(part.column(0)), [len(x) for x in data]))],
                names=["h", "id"])


def similar(a: bytes, b: bytes) -> bool:
    """100 |a and b| >= 80 |a or b| of two sorted sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if 100 * min(len(x), len(y)) < 80 * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similar(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = (_sketch(batch.column(2)) != _sketch(batch.column(3))).sum(axis=1) if batch.num_rows else np.zeros(0)
        yield batch.select(["a", "b"]).filter(pa.array(far <= DISTANCE))


def _first_slot(differ: np.ndarray) -> np.ndarray:
    """The first key that pairs share, from where their components differ: a chunk, and the component left out."""
    misses = differ.sum(axis=2)
    chunk = np.argmax(misses <= 1, axis=1)
    row = np.arange(len(differ))
    left_out = np.where(misses[row, chunk] == 1, np.argmax(differ[row, chunk], axis=1), 0)
    return np.where(misses[row, chunk] <= 1, chunk * PER_CHUNK + left_out, -1)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the distance and of different components, from rows sorted by (key, i, j).

    A group holds at most about :data:`BLOCK` rows of one block and as many of those to compare with them.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        sides = rows.column("side").to_numpy()
        ids, comps, main, n, shared = (rows.column(c).to_numpy() for c in ("id", "comp", "main", "n", "shared"))
        sketch = _sketch(rows.column("sig").combine_chunks())
        bins = np.array([np.frombuffer(x, np.uint8) if x else _OPEN for x in rows.column("bins").to_pylist()])
        slot = rows.column("slot")[0].as_py()
        own, others = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        a, b = [], []
        for o in others:
            fit = own[(comps[own] != comps[o]) & ((comps[own] == main[own]) | (ids[own] > ids[o]))]
            most = np.minimum(shared[fit], shared[o])
            fit = fit[100 * most >= 80 * (n[fit] + n[o] - most)]
            differ = (sketch[fit] != sketch[o]).reshape(-1, CHUNKS, PER_CHUNK)
            near = (differ.sum(axis=(1, 2)) <= DISTANCE) & (_first_slot(differ) == slot)
            fit = fit[near]
            most = np.minimum(shared[fit], shared[o])
            if (bins[o] < 255).any():
                both = np.minimum(bins[fit], bins[o]).sum(axis=1, dtype=np.int64)
                most = np.where((bins[fit] < 255).any(axis=1), np.minimum(most, both), most)
            fit = fit[100 * most >= 80 * (n[fit] + n[o] - most)]
            a.append(np.full(len(fit), ids[o]))
            b.append(ids[fit])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        marks = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
        new = np.zeros(rows.num_rows, bool)
        for m in marks:
            new[1:] |= m[1:] != m[:-1]
        cuts = np.flatnonzero(new).tolist()
        for s, e in zip([0, *cuts[:-1]], cuts, strict=False):
            yield pairs(rows.slice(s, e - s))
        held = rows.slice(cuts[-1] if cuts else 0)
    if held is not None and held.num_rows:
        yield pairs(held)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")


def _alone(sets: DataFrame) -> DataFrame:
    """id, alone: how many shingles of each set no other set here holds. Those can be in no intersection."""
    held = sets.mapInArrow(_spread, "h long, id long").groupBy("h").agg(
        F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return held.groupBy("id").agg(F.count("*").alias("alone"))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    A null or empty text has an empty set and is linked with nothing. A row without an id cannot be named: its
    component is null and it is kept. Rows that repeat an id are judged by their own texts; texts whose smallest id is
    the same one are linked. An empty table gives none.
    """
    marked = cut(docs.select("doc_id", "text").mapInArrow(
        _signatures, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"))
    same = ["n_shingles", "d1", "d2"]
    classes = cut(marked.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("id"), F.min("sig").alias("sig")))
    by_id = classes.select("id", "sig", F.col("n_shingles").alias("n"))  # an id that leads several texts has several rows
    keys = classes.select("id", "sig").mapInArrow(_keys, "key long, slot int, id long")
    buckets = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(keys.join(buckets, "key").distinct())
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = members.join(weights, "id").select("key", "id", "weight")
    tops = weighed.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("id")).alias("low"))).alias("top"))
    leaders = weighed.join(tops, "key").groupBy("id").agg(F.max("top").alias("top"))
    first = leaders.select((-F.col("top.low")).alias("a"), F.col("id").alias("b")).where("a <> b")
    bodies = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    wanted = weights.select("id")
    sets = cut(bodies.join(wanted, bodies["doc_id"] == wanted["id"], "left_semi").mapInArrow(
        _sets, "id long, set binary, bins binary").where("length(set) > 0"))

    signed = lambda name, as_: by_id.select(F.col("id").alias(name), F.col("sig").alias(as_))
    near = first.join(signed("a", "x"), "a").join(signed("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(
        _near, "a long, b long")
    links = cut(_confirmed(near, sets))
    comps = cut(components(links))

    placed = members.join(comps, "id", "left").select("key", "slot", "id", F.coalesce("comp", "id").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"),
                         F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("others"))
    open_rows = cut(placed.join(mixed, "key"))
    here = sets.join(open_rows.select("id").distinct(), "id", "left_semi")
    alone = _alone(here.select("id", "set"))
    several = by_id.groupBy("id").count().where("count > 1")  # of their texts it is not known which holds what
    alone = alone.join(several, "id", "left_anti")
    known = (by_id.join(alone, "id", "left")
             .join(here.select("id", "bins").join(several, "id", "left_anti"), "id", "left")
             .select("id", "sig", "n", "bins", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")))
    spread = open_rows.withColumns({"h": F.xxhash64("id"), "own": F.pmod(F.xxhash64("id"), F.col("blocks"))})
    steps = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = spread.select("key", "slot", "id", "comp", "main", F.lit(0).alias("side"), F.col("own").alias("i"),
                        F.explode(steps("others")).alias("j"))
    others = spread.where("comp <> main").select(
        "key", "slot", "id", "comp", "main", F.lit(1).alias("side"), F.explode(steps("blocks")).alias("i"),
        F.pmod(F.xxhash64("h"), F.col("others")).alias("j"))
    rows = own.unionAll(others).join(known.where("100 * shared >= 80 * n"), "id").select(
        "key", "i", "j", "slot", "side", "id", "comp", "main", "n", "shared", "sig", "bins")
    rest = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _across, "a long, b long").distinct()
    more = cut(_confirmed(rest, sets))

    final = cut(components(links.unionAll(more)))
    named = classes.join(final, "id", "left").select(*same, F.coalesce("comp", "id").alias("component_id"))
    return (marked.select("doc_id", *same).join(named, same, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document is not the first of its component."""
    gone = link(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
