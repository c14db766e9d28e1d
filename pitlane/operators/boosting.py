"""Boosted regression trees for many expanding windows, grown at once.

A model belongs to a group (a cell of an ablation, say) and learns from that group's rows of all sections before its
first. Rows are binned once. A pass over them sends each row down the trees that every one of its models has so far and
sums residuals per (model, node, feature, bin) inside the task; the sums of a node meet in one small group, where its
split is chosen. So a level of all trees of all models is one job, and no rows are gathered or stored again: what is
kept between passes are the trees, a few bytes per model, tree and node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models whose sums a task holds at a time, rows it works on at a time, and the most bins two features are added up in together.
HELD, CHUNK, PAIRED = 64, 65_536, 16_384


@dataclass(frozen=True)
class Bins:
    """Upper edges per numeric feature; a feature without edges is nominal, with codes from 0. Bin 0 is "missing"."""

    edges: list[np.ndarray | None]
    width: int

    def of(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.int16)
        for j, (v, edges) in enumerate(zip(columns, self.edges, strict=True)):
            known = ~np.isnan(v)
            if edges is None:
                # A code beyond the width was never seen in training; it counts as missing.
                out[known, j] = np.where(v[known] < self.width - 1, v[known] + 1, 0)
            else:
                out[known, j] = np.searchsorted(edges, v[known]) + 1
        return out


def learn_bins(rows: DataFrame, numeric: Sequence[str], nominal: Sequence[str] = (), bins: int = 64) -> Bins:
    """Edges at the quantiles of ``rows``: one aggregate over all features."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    asked = [F.percentile_approx(F.col(c), shares).alias(c) for c in numeric]
    found = rows.agg(*asked, *[F.max(c).alias(c) for c in nominal]).first()
    edges: list[np.ndarray | None] = [np.unique(np.array(found[c] or [], float)) for c in numeric]
    codes = [int(found[c]) + 2 for c in nominal if found[c] is not None]
    return Bins(edges + [None] * len(nominal), max([bins, *codes]))


@dataclass
class Forest:
    """Trees of all models. ``group`` and ``first`` name a model; ``base`` is its mean label. A tree of depth d has
    2^d - 1 inner nodes, in rows: feature, and for each bin whether it goes left; ``leaf`` are the 2^d values."""

    group: np.ndarray
    first: np.ndarray
    base: np.ndarray
    depth: int
    width: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, m: int, columns: np.ndarray) -> np.ndarray:
        """Predictions of model ``m`` for rows given as columns of bins."""
        out = np.full(columns.shape[1], self.base[m])
        for feature, left, leaf in self.trees:
            out += leaf[m][descend(columns, feature[m], left[m], self.depth)]
        return out


def _right(bins: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which rows do not go left. Where the bins that go left are the first ones, one comparison tells."""
    k = int(left[1:].sum())
    if not left[1:k + 1].all():
        return ~left[bins]
    # Bin 0, missing, is below every other; less one it wraps around and is above them.
    return bins > k if left[0] else bins - bins.dtype.type(1) >= k


def descend(columns: np.ndarray, feature: np.ndarray, left: np.ndarray, levels: int) -> np.ndarray:
    """Which of the 2^levels nodes of a level each row reaches in a tree; ``columns`` holds the bins by feature."""
    at = np.zeros(columns.shape[1], np.uint8 if levels < 8 else np.int64)
    for level in range(levels):
        ways = [_right(columns[feature[i]], left[i]) for i in range((1 << level) - 1, (1 << (level + 1)) - 1)]
        for bit in range(level):
            # Of each pair of nodes the one that the path so far has led to, from the last turn back to the first.
            turned = (at >> bit) & 1 == 1
            # By bits, not by choosing: which way a row goes cannot be foretold, and a processor that guesses is slow.
            ways = [other ^ ((other ^ right) & turned) for other, right in zip(ways[::2], ways[1::2], strict=True)]
        at = 2 * at + ways[0]
    return at


def _small(width: int) -> type:
    """The least type that holds bins below ``width`` and one more."""
    return np.uint8 if width < 256 else np.uint16


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Group, sections, labels and columns of bins of the rows of each group in a batch, in order of sections."""
    section = batch.column("section").to_numpy(zero_copy_only=False)
    grp = batch.column("grp").to_numpy(zero_copy_only=False)
    y = batch.column("target").to_numpy(zero_copy_only=False).astype(float)
    x = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(len(section), -1)
    for g in np.unique(grp):
        own = np.flatnonzero((grp == g) & ~np.isnan(y))
        own = own[np.argsort(section[own], kind="stable")]
        for start in range(0, len(own), CHUNK):
            part = own[start:start + CHUNK]
            yield int(g), section[part], y[part], np.ascontiguousarray(x[part].T.astype(_small(width)))


def _merged(blocks: Iterable[tuple]) -> list[tuple]:
    """The blocks of all batches put together by group, in order of sections and cut anew: a batch has few rows of a group."""
    groups: dict[int, list[tuple]] = {}
    for grp, *block in blocks:
        groups.setdefault(grp, []).append(block)
    out = []
    for grp in sorted(groups):
        section, y, x = (np.concatenate(v, axis=-1) for v in zip(*groups.pop(grp), strict=True))
        order = np.argsort(section, kind="stable")
        for start in range(0, len(order), CHUNK):
            part = order[start:start + CHUNK]
            out.append((grp, section[part], y[part], np.ascontiguousarray(x[:, part])))
    return out


def binned(rows: DataFrame, bins: Bins, features: Sequence[str], keep: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """(keep, grp, section, target, bins): ``rows`` has ``grp`` and ``section`` and the named features."""
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features]
            x = bins.of(columns)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in (*keep, "grp", "section", "target")], lists],
                names=[*keep, "grp", "section", "target", "bins"])

    kept = rows.select(*keep, "grp", "section", "target", *[F.col(f).cast("double").alias(f) for f in features])
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:len(keep)])
    return kept.mapInArrow(turn, f"{head}, grp int, section int, target double, bins array<smallint>")


def _places(x: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, int]:
    """The bins of a chunk's columns, and how many of the first columns come in pairs, one joint bin for two."""
    shared = len(x) // 2 * 2 if nodes * width ** 2 <= PAIRED else 0
    wide = x.astype(np.int64)
    return np.concatenate([wide[:shared:2] * width + wide[1:shared:2], wide[shared:]]), shared


def _sums(rows: DataFrame, forest: Forest, tree: tuple[np.ndarray, np.ndarray], level: int, width: int) -> DataFrame:
    """(model, node, total, count): residual sums and counts of a level's nodes by feature and bin, one row per task.

    A task keeps its bins, a byte or two each, and the sums of ``HELD`` models at a time. A feature's sums of a model are
    one pass over its column of a chunk of rows, small enough to stay near the processor. Two features share a pass where
    the bins of both together are few: their joint sums are then added up along either.
    """
    nodes, feature_bins = 1 << level, width << level
    wanted = np.arange(len(forest.first))
    feature, left = tree

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _merged(part for batch in batches for part in _blocks(batch, width))
        if not held:
            return
        d = len(held[0][3])
        for start in range(0, len(wanted), HELD):
            some = wanted[start:start + HELD]
            total = np.zeros((len(some), d, feature_bins))
            count = np.zeros((len(some), d, feature_bins), np.int64)
            for grp, section, y, x in held:
                ends = np.searchsorted(section, forest.first[some])
                asked = np.flatnonzero((forest.group[some] == grp) & (ends > 0))
                if not len(asked):
                    continue
                place, shared = _places(x, nodes, width)
                for k in asked:
                    m, end = some[k], ends[k]
                    z = x[:, :end]
                    rest = y[:end] - forest.predict(m, z)
                    at = descend(z, feature[m], left[m], level).astype(np.int64)
                    joint = at * width ** 2
                    for j in range(0, shared, 2):
                        flat = place[j // 2, :end] + joint if level else place[j // 2, :end]
                        for out, sums in ((total, np.bincount(flat, rest, nodes * width ** 2)),
                                          (count, np.bincount(flat, minlength=nodes * width ** 2))):
                            both = sums.reshape(nodes, width, width)
                            out[k, j] += both.sum(axis=2).ravel()
                            out[k, j + 1] += both.sum(axis=1).ravel()
                    at *= width
                    for j in range(shared, d):
                        flat = place[j - shared // 2, :end] + at if level else place[j - shared // 2, :end]
                        total[k, j] += np.bincount(flat, rest, feature_bins)
                        count[k, j] += np.bincount(flat, minlength=feature_bins)
            total, count = (np.moveaxis(v.reshape(len(some), d, nodes, width), 2, 1) for v in (total, count))
            which, node = np.nonzero(count.any(axis=(2, 3)))
            if len(which):
                ends = pa.array(np.arange(len(which) + 1) * d * width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[which], pa.int32()), pa.array(node, pa.int32()),
                     pa.ListArray.from_arrays(ends, pa.array(total[which, node].ravel())),
                     pa.ListArray.from_arrays(ends, pa.array(count[which, node].ravel().astype(np.int32)))],
                    names=["model", "node", "total", "count"])

    return rows.mapInArrow(add, "model int, node int, total array<double>, count array<int>")


def best_split(total: np.ndarray, count: np.ndarray, nominal: Sequence[bool], least: int) -> tuple[int, np.ndarray, float, float]:
    """Feature, bins that go left, and the means on both sides of the split that lowers the squared error most.

    Rows are features, columns bins, bin 0 missing: it is tried on either side. The bins of a nominal feature are put
    in order of their means first. Without a split that leaves ``least`` rows on each side all go left.
    """
    width = total.shape[1]
    whole, n = total[0].sum(), count[0].sum()
    order = np.tile(np.arange(1, width), (len(total), 1))
    for f in np.flatnonzero(nominal):
        mean = np.where(count[f, 1:] > 0, total[f, 1:] / np.maximum(count[f, 1:], 1), np.inf)
        order[f] = 1 + np.argsort(mean, kind="stable")
    sums = np.cumsum(np.take_along_axis(total, order, axis=1), axis=1)
    sizes = np.cumsum(np.take_along_axis(count, order, axis=1), axis=1)
    aside = np.array([0.0, 1.0])[None, :, None]
    left, size = sums[:, None] + aside * total[:, :1, None], sizes[:, None] + aside * count[:, :1, None]
    right, other = whole - left, n - size
    fits = (size >= least) & (other >= least)
    gain = np.where(fits, left ** 2 / np.maximum(size, 1) + right ** 2 / np.maximum(other, 1) - whole ** 2 / n, -np.inf)
    best = gain.max()
    if not best > 1e-12:
        return 0, np.ones(width, bool), whole / max(n, 1), whole / max(n, 1)
    # Of equal gains, but for rounding, the first counts: features in order, missing on the right first, fewer bins first.
    f, missing, k = (int(i[0]) for i in np.nonzero(gain >= best * (1 - 1e-9)))
    goes = np.zeros(width, bool)
    goes[order[f, :k + 1]] = True
    goes[0] = bool(missing)
    at = f, missing, k
    return f, goes, left[at] / size[at], right[at] / other[at]


def grow(rows: DataFrame, models: Sequence[tuple[int, int]], bins: Bins, *, n_trees: int, depth: int, rate: float,
         least: int) -> Forest:
    """A forest for every ``(group, first)`` of ``models``, learnt from the rows of its group whose section is before
    ``first`` and whose label is known. ``rows`` is a stored :func:`binned` table.

    To the driver come, per pass, one split for every model and node; the number of months bounds both.
    """
    d, width, k = len(bins.edges), bins.width, len(models)
    group, first = np.array([m[0] for m in models]), np.array([m[1] for m in models])
    means = rows.where(F.col("target").isNotNull() & ~F.isnan("target")).groupBy("grp", "section").agg(
        F.sum("target").alias("y"), F.count("*").alias("n")).toPandas()
    base = np.zeros(k)
    for m in range(k):
        before = means[(means["grp"] == group[m]) & (means["section"] < first[m])]
        base[m] = before["y"].sum() / before["n"].sum() if len(before) else 0.0
    forest = Forest(group, first, base, depth, width, [])
    nominal = [e is None for e in bins.edges]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["total"].to_numpy()), axis=0).reshape(d, width)
        count = np.sum(np.stack(pdf["count"].to_numpy()), axis=0, dtype=float).reshape(d, width)
        feature, goes, left, right = best_split(total, count, nominal, least)
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "node": [pdf["node"].iloc[0]], "feature": [feature],
                             "goes": [goes.tolist()], "lower": [left], "upper": [right]})

    for _ in range(n_trees):
        feature, goes = np.zeros((k, (1 << depth) - 1), np.int64), np.ones((k, (1 << depth) - 1, width), bool)
        leaf = np.zeros((k, 1 << depth))
        for level in range(depth):
            sums = _sums(rows, forest, (feature.copy(), goes.copy()), level, width)
            for r in sums.groupBy("model", "node").applyInPandas(
                    choose, "model int, node int, feature int, goes array<boolean>, lower double, upper double").collect():
                inner = r.node + (1 << level) - 1
                feature[r.model, inner], goes[r.model, inner] = r.feature, r.goes
                if level == depth - 1:
                    leaf[r.model, 2 * r.node:2 * r.node + 2] = rate * r.lower, rate * r.upper
        forest.trees.append((feature, goes, leaf))
    return forest


def predict(rows: DataFrame, forest: Forest, keep: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """(keep, grp, target, predicted): every row by the newest model of its group that has not learnt from its section;
    rows before the first model have none and are left out."""
    small = _small(forest.width)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, section = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "section"))
            x = np.ascontiguousarray(
                batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(len(section), -1).T.astype(small))
            out, some = np.zeros(len(section)), np.zeros(len(section), bool)
            for m in np.argsort(forest.first, kind="stable"):
                own = np.flatnonzero((grp == forest.group[m]) & (section >= forest.first[m]))
                later = forest.first[(forest.group == forest.group[m]) & (forest.first > forest.first[m])]
                if len(later):
                    own = own[section[own] < later.min()]
                out[own], some[own] = forest.predict(m, x[:, own]), True
            names = [*keep, "grp", "target"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out)],
                                             names=[*names, "predicted"]).filter(pa.array(some))

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(turn, f"{head}, grp int, target double, predicted double")
