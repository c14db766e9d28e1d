"""Perplexity under a Brown class bigram model (operator 3).

Counts are taken over every word of every training text, and exchange clustering gives every word a class. The most
frequent words are exchanged one by one on the driver. All others start in a class of their own kind, and tasks move each
to the class that raises the likelihood of the class bigrams most, judged by the classes of its neighbours: frequent words
in a few rounds, rare words once, when the frequent ones have theirs. A text's probability is the product of class
transitions and of words given their classes; both are smoothed, a word with c occurrences as c + 0.5. A word that
training has not may be of any class: the probability is summed over the classes it could have.

Frequent words go with the model to every task; rare ones are joined with the table of theirs. A word is a 64-bit hash of
its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.llm import words
from pitlane.session import cut

#: Classes of words. Two more hold the words without a class so far and the end of a text.
CLASSES = 64
REST, END, PLACES = CLASSES, CLASSES + 1, CLASSES + 2
REAL = np.array([*range(CLASSES), END])
#: Words exchanged on the driver, and words that travel with the model.
OWN, HEAD = 1024, 1 << 17
SWEEPS, ROUNDS, PRIOR = 8, 2, 5.0
#: Counts of a frequent word: neighbours after it by class, neighbours before it by class, itself after itself.
CELLS = 2 * PLACES + 1
#: Words judged at a time in a task.
BLOCK = 128


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c of every word of ``docs`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch.column(0), words.NON_SPACE, lower=True):
                keys, n = np.unique(piece.hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "c"])

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Sorted hashes of frequent words with their counts and classes, log10 of transitions and of the classes' totals,
    and the sizes N and V and the number of ends."""

    head: np.ndarray
    head_count: np.ndarray
    place: np.ndarray
    move: np.ndarray
    total: np.ndarray
    n: int
    v: int
    ends: int

    def bridges(self) -> Callable[[int], np.ndarray]:
        """Of a number m, log10 of the probability that from one class m unseen words lead to another class."""
        step, emit = np.zeros((PLACES, PLACES)), np.zeros(PLACES)
        step[np.ix_(REAL, REAL)] = 10.0 ** self.move[np.ix_(REAL, REAL)]
        emit[:CLASSES] = 0.5 / 10.0 ** self.total[:CLASSES]
        squares = [_scaled(emit[:, None] * step, 0.0)]
        known: dict[int, np.ndarray] = {}

        def bridge(m: int) -> np.ndarray:
            if m not in known:
                if len(known) > 256:
                    known.clear()
                whole, shift, bit = step, 0.0, 0
                while m >> bit:
                    if bit == len(squares):
                        squares.append(_scaled(squares[-1][0] @ squares[-1][0], 2 * squares[-1][1]))
                    if m >> bit & 1:
                        whole, shift = _scaled(whole @ squares[bit][0], shift + squares[bit][1])
                    bit += 1
                known[m] = np.log10(np.maximum(whole, 1e-300)) + shift
            return known[m]

        return bridge


def _scaled(x: np.ndarray, shift: float) -> tuple[np.ndarray, float]:
    """``x`` divided by its largest entry, and ``shift`` plus log10 of that entry."""
    top = x.max()
    return x / top, shift + float(np.log10(top))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _with_ends(values: np.ndarray, piece: words.Piece, end) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows with an end after each, and where each row begins."""
    stop = piece.stop
    begin = np.concatenate([[0], stop[:-1] + np.arange(1, len(stop))]) if len(stop) else np.zeros(0, np.int64)
    return np.insert(values, stop, end), begin


def _before(values: np.ndarray, begin: np.ndarray, end) -> np.ndarray:
    """The value before each; texts begin after an end."""
    shifted = np.concatenate([[end], values[:-1]])
    shifted[begin] = end
    return shifted


def _numbers(piece: words.Piece, head: np.ndarray, values: np.ndarray, rest: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every word and end the value of its frequent word, ``rest`` where it has none."""
    at, there = _lookup(head, piece.hashes)
    found = np.full(len(at), rest, np.int64)
    found[there] = values[at[there]]
    return _with_ends(found, piece, end)


def _nonzero(seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = np.flatnonzero(seen)
    for a in range(0, len(at), 65536):
        yield at[a:a + 65536], seen[at[a:a + 65536]].astype(np.int64)


def transitions(docs: DataFrame, own: np.ndarray) -> DataFrame:
    """cell, n: how often type ``cell // types`` is followed by type ``cell % types``: the words ``own``, any other, the end."""
    n_own = len(own)
    types = n_own + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(types * types, np.int64)
        for batch in batches:
            for piece in words.pieces(batch.column(0), words.NON_SPACE, lower=True):
                now, begin = _numbers(piece, own, np.arange(n_own), n_own, n_own + 1)
                seen += np.bincount(_before(now, begin, n_own + 1) * types + now, minlength=types * types)
        for cell, n in _nonzero(seen):
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _dense(cells: DataFrame, side: int) -> np.ndarray:
    """Counts (cell, n) as a square table on the driver; ``side`` is bounded by the parameters."""
    table = np.zeros(side * side)
    for batch in cells.select(F.col("cell").cast("int"), "n").toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.reshape(side, side)


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """What classes add to the log likelihood of a corpus whose class transitions are ``table``."""
    return float(_xlog(table).sum() - _xlog(table.sum(axis=0)).sum() - _xlog(table.sum(axis=1)).sum())


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, pinned: int = 1) -> np.ndarray:
    """The class of each type: types move one by one to the class that raises the likelihood of the class bigrams most.

    ``counts[a, b]`` is how often type b follows type a. The last ``pinned`` types keep classes of their own, numbered
    from ``classes``. Types that never occur go to class 0. Ends after a sweep without moves.
    """
    n_types, free = len(counts), len(counts) - pinned
    size = counts.sum(axis=1) + counts.sum(axis=0)
    order = np.argsort(-size[:free], kind="stable")
    order = order[size[order] > 0]
    place = np.zeros(n_types, np.int64)
    place[order] = np.arange(len(order)) % classes
    place[free:] = classes + np.arange(pinned)
    flipped = np.ascontiguousarray(counts.T)
    member = np.zeros((n_types, classes + pinned))
    member[np.arange(n_types), place] = 1
    right, left = counts @ member, flipped @ member  # by type: what follows it, what precedes it
    table = member.T @ right
    cols, rows = table.sum(axis=0), table.sum(axis=1)
    every = np.arange(classes + pinned)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = place[w], counts[w, w]
            r, before = right[w].copy(), left[w].copy()
            r[a] -= own
            before[a] -= own
            n_right, n_left = r.sum() + own, before.sum() + own
            table[a] -= r
            table[:, a] -= before
            table[a, a] -= own
            rows[a] -= n_right
            cols[a] -= n_left
            gain = (_xlog(table + r) - _xlog(table)).sum(axis=1) + (_xlog(table.T + before) - _xlog(table.T)).sum(axis=1)
            diagonal = table[every, every]
            gain += _xlog(diagonal + r + before + own) - _xlog(diagonal + r) - _xlog(diagonal + before) + _xlog(diagonal)
            gain -= _xlog(rows + n_right) - _xlog(rows) + _xlog(cols + n_left) - _xlog(cols)
            gain[classes:] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * (abs(gain[a]) + 1):
                b = a
            table[b] += r
            table[:, b] += before
            table[b, b] += own
            rows[b] += n_right
            cols[b] += n_left
            if b != a:
                moved += 1
                place[w] = b
                right[:, a] -= flipped[w]
                right[:, b] += flipped[w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if not moved:
            break
    return place


def best_classes(table: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray, now: np.ndarray,
                 classes: int = CLASSES) -> np.ndarray:
    """The class of each of some words that raises the likelihood most, each word judged as if it alone moved.

    ``table`` has the transitions between classes with every word in class ``now``; ``right`` and ``left`` (words x
    classes) count the classes after and before each word, ``itself`` how often it follows itself. Classes from
    ``classes`` on take no word; of equal classes the first, unless ``now`` is one.
    """
    at = np.arange(len(now))
    gain = np.zeros(right.shape)
    for one, other, side in ((right, left, table), (left, right, table.T)):
        word, k = np.nonzero(one)
        n, a = one[word, k], now[word]
        base = side[:, k].T.copy()
        base[np.arange(len(word)), a] -= n
        same = k == a
        base[same] -= other[word[same]]
        base[same, a[same]] -= itself[word[same]]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            gain[word[first]] += np.add.reduceat(_xlog(base + n[:, None]) - _xlog(base), first)
    own = itself[:, None]
    diagonal = np.tile(np.diagonal(table), (len(now), 1))
    diagonal[at, now] -= right[at, now] + left[at, now] + itself
    gain += _xlog(diagonal + right + left + own) - _xlog(diagonal + right) - _xlog(diagonal + left) + _xlog(diagonal)
    for total, moved in ((table.sum(axis=1), right), (table.sum(axis=0), left)):
        n = moved.sum(axis=1) + itself
        sums = np.tile(total, (len(now), 1))
        sums[at, now] -= n
        gain -= _xlog(sums + n[:, None]) - _xlog(sums)
    gain[:, classes:] = -np.inf
    best = np.argmax(gain, axis=1)
    stay = (now < classes) & (gain[at, best] <= gain[at, now] + 1e-9 * (np.abs(gain[at, best]) + 1))
    return np.where(stay, now, best)


def neighbour_cells(docs: DataFrame, head: np.ndarray, place: np.ndarray) -> DataFrame:
    """word, cell, n: the :data:`CELLS` of each frequent word, and as word -1 the transitions between classes."""
    size = len(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = np.zeros(size * CELLS, np.int32), np.zeros(PLACES * PLACES, np.int64)
        known = np.concatenate([place, [REST, END]])
        for batch in batches:
            for piece in words.pieces(batch.column(0), words.NON_SPACE, lower=True):
                now, begin = _numbers(piece, head, np.arange(size), size, size + 1)
                before = _before(now, begin, size + 1)
                table += np.bincount(known[before] * PLACES + known[now], minlength=PLACES * PLACES)
                same = (before == now) & (now < size)
                after, ahead = (now < size) & ~same, (before < size) & ~same
                cells = np.concatenate([before[ahead] * CELLS + known[now[ahead]],
                                        now[after] * CELLS + PLACES + known[before[after]], now[same] * CELLS + 2 * PLACES])
                at, n = np.unique(cells, return_counts=True)
                seen[at] += n.astype(np.int32)
        for part, shift in ((seen, 0), (table, 1)):
            for at, n in _nonzero(part):
                word, cell = np.divmod(at, CELLS) if not shift else (np.full(len(at), -1), at)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n)],
                                                 names=["word", "cell", "n"])

    return docs.select("text").mapInArrow(count, "word int, cell int, n long").groupBy("word", "cell").agg(F.sum("n").alias("n"))


def contexts(docs: DataFrame, head: np.ndarray, place: np.ndarray) -> DataFrame:
    """h, other, cell, n, with the frequent words in their classes.

    Rows without ``other``: how often rare word h stands between the classes ``cell // PLACES`` and ``cell % PLACES``,
    rare neighbours as REST. Rows with it: how often rare word ``other`` follows h. Rows without h: transitions between
    the classes of frequent words and ends.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = ["h", "other", "cell", "n"], np.zeros(PLACES * PLACES, np.int64)
        for batch in batches:
            for piece in words.pieces(batch.column(0), words.NON_SPACE, lower=True):
                now, begin = _numbers(piece, head, place, REST, END)
                hashes, _ = _with_ends(piece.hashes, piece, np.uint64(0))
                before = _before(now, begin, END)
                frequent = (now != REST) & (before != REST)
                table += np.bincount(before[frequent] * PLACES + now[frequent], minlength=PLACES * PLACES)
                rare = np.flatnonzero(now == REST)
                cell = before[rare] * PLACES + now[rare + 1]
                h, cell, n = _counted(hashes[rare], cell)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int64()),
                                                  pa.array(cell.astype(np.int32)), pa.array(n)], names=names)
                pair = rare[before[rare] == REST]
                h, other, n = _counted(hashes[pair - 1], hashes[pair])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(other.view(np.int64)),
                                                  pa.nulls(len(h), pa.int32()), pa.array(n)], names=names)
        for at, n in _nonzero(table):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()),
                                              pa.array(at.astype(np.int32)), pa.array(n)], names=names)

    return docs.select("text").mapInArrow(count, "h long, other long, cell int, n long")


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[first], np.diff(np.concatenate([first, [len(a)]]))


def _listed(cells: DataFrame, key: str) -> DataFrame:
    """The cells of each word in one row; a word has no more of them than there are pairs of classes."""
    return cells.repartition(key).groupBy(key, "cell").agg(F.sum("n").alias("n")).groupBy(key).agg(
        F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Key of each word of a block, and of every cell the word's place in the block, the cell and its count."""
    for whole in batches:
        for a in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(a, BLOCK)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            yield (batch.column(0).to_numpy(), np.repeat(np.arange(len(sizes)), sizes),
                   batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy())


def moved(cells: DataFrame, table: np.ndarray, place: np.ndarray) -> DataFrame:
    """word, place: the new class of each word of ``cells`` (word, cell, n)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, cell, n in _blocks(batches):
            counts = np.zeros((len(key), CELLS))
            counts[at, cell] = n
            best = best_classes(table, counts[:, :PLACES], counts[:, PLACES:-1], counts[:, -1], place[key])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(best.astype(np.int32))], names=["word", "place"])

    return _listed(cells, "word").mapInArrow(judge, "word int, place int")


def placed(found: DataFrame, table: np.ndarray) -> DataFrame:
    """Of every rare word of :func:`contexts` a row h, c, place, and rows with null h, cell and n: its transitions."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["h", "c", "place", "cell", "n"], np.zeros(PLACES * PLACES)
        for key, at, cell, n in _blocks(batches):
            right, left = np.zeros((len(key), PLACES)), np.zeros((len(key), PLACES))
            np.add.at(left, (at, cell // PLACES), n)
            np.add.at(right, (at, cell % PLACES), n)
            best = best_classes(table, right, left, np.zeros(len(key)), np.full(len(key), REST))
            own = best[at]
            seen += np.bincount(cell // PLACES * PLACES + own, weights=n, minlength=len(seen))
            seen += np.bincount(own * PLACES + cell % PLACES, weights=n, minlength=len(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(right.sum(axis=1).astype(np.int64)), pa.array(best.astype(np.int32)),
                 pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.int64())], names=names)
        for at, n in _nonzero(seen):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), pa.array(at.astype(np.int32)), pa.array(n)],
                                             names=names)

    return _listed(found.where("h IS NOT NULL AND other IS NULL"), "h").mapInArrow(
        judge, "h long, c long, place int, cell int, n long")


def _frequent(counts: DataFrame, head_words: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hashes and counts of the most frequent words, most frequent first: whole powers of two of counts, at most
    ``head_words`` words; and how many words and occurrences there are in all."""
    level = F.floor(F.log2("c")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("n")).collect()
    least, kept = 63, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if kept + r["words"] > head_words:
            break
        least, kept = r["level"], kept + r["words"]
    h, c = (column.to_numpy() for column in counts.where(level >= least).select("h", "c").toArrow().columns)
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order], sum(r["words"] for r in sizes), sum(r["n"] for r in sizes)


def train(docs: DataFrame, own_words: int = OWN, head_words: int = HEAD, rounds: int = ROUNDS,
          watch: Callable[[float], None] | None = None) -> tuple[Model, DataFrame]:
    """The model of ``docs`` (text) and the table of rare words (h, c, place).

    Every word has a class of its own choice: the first ``own_words`` by exchange on the driver, the other frequent ones
    in ``rounds`` rounds over the texts, rare ones by their contexts. What reaches the driver is bounded by the parameters: the
    histogram of counts by power of two, the ``head_words`` words with their classes, and the transitions of the first
    ``own_words``. ``watch`` is told the likelihood of the classes before each round.
    """
    counts = cut(word_counts(docs))
    head, head_count, v, n_words = _frequent(counts, head_words)
    own = min(own_words, len(head))
    order = np.argsort(head[:own])
    classes = exchange(_dense(transitions(docs, head[:own][order]), own + 2), pinned=2)
    place = np.full(len(head), REST)
    place[:own][order] = classes[:own]
    order = np.argsort(head)
    head, head_count, place, first = head[order], head_count[order], place[order], order < own

    for _ in range(rounds if own < len(head) else 0):
        cells = cut(neighbour_cells(docs, head, place))
        table = _dense(cells.where("word = -1"), PLACES)
        if watch:
            watch(likelihood(table))
        word, new = (c.to_numpy() for c in moved(cells.where("word >= 0"), table, place).toArrow().columns)
        turn = place.copy()
        turn[word] = new
        place = np.where(first, place, turn)

    found = cut(contexts(docs, head, place))
    table = _dense(found.where("h IS NULL").groupBy("cell").agg(F.sum("n").alias("n")), PLACES)
    beside = found.where("h IS NOT NULL AND other IS NULL").groupBy("cell").agg(F.sum("n").alias("n"))
    pairs = found.where("other IS NOT NULL")
    whole = _with_rest(table, _dense(beside, PLACES), pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if watch:
        watch(likelihood(whole))
    chosen = cut(placed(found, whole))
    rare = chosen.where("h IS NOT NULL").select("h", "c", "place")
    table += _dense(chosen.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")), PLACES)
    table[REST] = table[:, REST] = 0
    both = pairs.join(rare.select("h", F.col("place").alias("a")), "h").join(
        rare.select(F.col("h").alias("other"), F.col("place").alias("b")), "other")
    table += _dense(both.groupBy((F.col("a") * PLACES + F.col("b")).alias("cell")).agg(F.sum("n").alias("n")), PLACES)
    if watch:
        watch(likelihood(table))

    distinct = np.bincount(place, minlength=PLACES)
    for r in rare.groupBy("place").agg(F.count("*").alias("words")).collect():
        distinct[r["place"]] += r["words"]
    distinct[REAL] += 1  # an unseen word in each class, and the end
    after = table.sum(axis=0)
    share = np.zeros(PLACES)
    share[REAL] = (after[REAL] + 0.5) / (after[REAL].sum() + 0.5 * len(REAL))
    move = (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR)
    move[:, REST] = 1
    total = after + 0.5 * distinct
    total[REST] = 1
    ends = int(after[END])
    return Model(head, head_count, place, np.log10(move), np.log10(total), n_words + ends, v + 1, ends), rare


def _with_rest(table: np.ndarray, beside: np.ndarray, between: int) -> np.ndarray:
    """Transitions with all rare words as one class, from those of frequent words, the classes on both sides of rare
    words, and how often a rare word follows another."""
    whole = table.copy()
    whole[:, REST] += beside.sum(axis=1)
    whole[REST] += beside.sum(axis=0)
    whole[REST, REST] = between
    return whole


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, held_out, text): doc_id, held_out, n_tokens, n_known, base_score, score."""
    half = np.log10(np.arange(1 << 10) + 0.5)

    def log_count(c: np.ndarray) -> np.ndarray:
        return np.where(c < len(half), half[np.minimum(c, len(half) - 1)], np.log10(c + 0.5))

    end = float(np.log10(model.ends + 0.5))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in words.pieces(batch.column(2), words.NON_SPACE, lower=True):
                at, there = _lookup(model.head, piece.hashes)
                place = np.full(len(at), REST)
                place[there] = model.place[at[there]]
                place, begin = _with_ends(place, piece, END)
                before = _before(place, begin, END)
                frequent = place != REST
                log = np.where(frequent & (before != REST), model.move[before, place], 0.0)
                log -= np.where(frequent, model.total[place], 0.0)
                log = np.add.reduceat(log, begin)
                row = np.repeat(np.arange(piece.rows), np.diff(np.concatenate([[0], piece.stop])))
                known = np.bincount(row[there], minlength=piece.rows)
                base = np.bincount(row[there], weights=log_count(model.head_count[at[there]]), minlength=piece.rows) + end
                other = np.flatnonzero(~there)
                spot = other + row[other]
                offsets = pa.array(np.searchsorted(row[other], np.arange(piece.rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (
                    piece.hashes[other].view(np.int64), spot.astype(np.int32), before[spot].astype(np.int8),
                    place[spot + 1].astype(np.int8))]
                part = batch.slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row_id + np.arange(piece.rows)), part.column(0), part.column(1),
                    pa.array(np.diff(np.concatenate([[0], piece.stop])) + 1), pa.array(known + 1), pa.array(base),
                    pa.array(log), *lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "log", "h", "spot", "a", "b"])
                row_id += piece.rows

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bridge = model.bridges()
        # Of the last rare word: its class, or that it is unseen, the class before its run of unseen words and their number.
        place_, unseen_, start_, length_ = 0, False, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row, a, b, c, place = (column.to_numpy() for column in batch.columns)
            unseen, at = place == REST, np.arange(len(row))
            behind = np.concatenate([[unseen_], unseen[:-1]]) & (a == REST)  # an unseen word comes just before
            before = np.where(a == REST, np.concatenate([[place_], place[:-1]]), a)
            first = np.maximum.accumulate(np.where(unseen & ~behind, at, -1))  # -1: the run began in an earlier batch
            start = np.where(first < 0, start_, before[first])
            length = at - first + np.where(first < 0, length_, 1)
            value = np.where(unseen, 0.0, log_count(c) - model.total[place])
            value += np.where(unseen | behind, 0.0, model.move[before, place])
            value += np.where(unseen | (b == REST), 0.0, model.move[place, b])
            source = np.concatenate([[start_], start[:-1]])
            run = np.concatenate([[length_], length[:-1]])
            leaves, enters = unseen & (b != REST), behind & ~unseen
            for where, begin, many, goal in ((leaves, start, length, b), (enters, source, run, place)):
                for m in np.unique(many[where]).tolist():
                    hit = where & (many == m)
                    value[hit] += bridge(m)[begin[hit], goal[hit]]
            place_, unseen_, start_, length_ = int(place[-1]), bool(unseen[-1]), int(start[-1]), int(length[-1])
            cuts = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[cuts]), pa.array(np.add.reduceat(value, cuts)), pa.array(np.add.reduceat(log_count(c), cuts)),
                 pa.array(np.add.reduceat((c > 0).astype(np.int64), cuts))], names=["row", "linked", "counted", "seen"])

    found = cut(docs.select("doc_id", "held_out", "text").mapInArrow(
        measure, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, log double, "
                 "h array<long>, spot array<int>, a array<byte>, b array<byte>"))
    each = found.select("row", F.inline(F.arrays_zip("h", "spot", "a", "b")))
    each = each.join(rare, "h", "left").select(
        "row", "spot", "a", "b", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("place", F.lit(REST)).alias("place"))
    sums = each.repartition("row").sortWithinPartitions("row", "spot").drop("spot").mapInArrow(
        linked, "row long, linked double, counted double, seen long").groupBy("row").agg(
        F.sum("linked").alias("linked"), F.sum("counted").alias("counted"), F.sum("seen").alias("seen"))
    divisor = float(np.log10(model.n + 0.5 * (model.v + 1)))
    nil = F.lit(0.0)
    return found.drop("h", "spot", "a", "b").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("counted", nil) - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("base") + F.col("log") + F.coalesce("linked", nil)).alias("score"))


def report(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text) that are not held out and score all.

    A null text is empty: its only token is the end. A row without an id trains. Repeated rows count each time. Words of
    equal counts are ordered by hash. Other columns are ignored, whatever their names. An empty table has no rows.
    Without training rows all counts are 0 and the scores are those of the smoothing alone.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    model, rare = train(rows.where("NOT held_out"))
    return score(rows, model, rare)


def perplexity(score: Column, n_tokens: Column) -> Column:
    """10 to the mean negative log10 probability of a token."""
    return F.pow(F.lit(10.0), -score / n_tokens)
