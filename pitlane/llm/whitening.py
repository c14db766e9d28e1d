"""Whitening of embeddings (operator 12) by shifted CholeskyQR.

The centred rows A are never gathered. A pass over them sums the Gram matrix of Q = A R^-1, where the rows are put
through one triangular solve for each factor found so far; its Cholesky factor is the next one, so that Q comes nearer
to orthonormal columns with every pass. The first factor is taken of a slightly shifted Gram matrix, which exists
however ill-conditioned A is. The product R of all factors has A's singular values and right vectors, found without
the loss of half the digits that comes with A'A.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.session import cut

#: Passes at most; two or three do unless some directions hold nothing but rounding.
PASSES = 12
#: Entries whose integer would not fit in 53 bits count as not finite.
LARGEST = float(1 << 53)
#: A direction whose deviation is below this share of the largest one is empty.
EMPTY = 1e-13
_ROWS = 4096
_U = np.finfo(float).eps / 2


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, x: every usable row's entries c as floor(scale * c) + shift.

    Rows whose vector is null or holds a null, infinite or NaN entry go, and so do entries beyond what 53 bits hold.
    """
    c = F.col(vector)
    usable = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) * scale < LARGEST - shift, F.lit(False)))
    return embeddings.where(c.isNotNull() & usable).select(
        "vec_id", F.transform(c, lambda v: F.floor(v.cast("double") * scale) + F.lit(shift)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _slices(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of up to ``_ROWS`` at a time with their vectors as a matrix."""
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, _ROWS)
            yield part, _matrix(part.column(place), len(part.column(place)[0]))


def _sums(fit: DataFrame) -> tuple[int, int, list[int]]:
    """Length, number and exact sums of the vectors of the most frequent length (of equally frequent ones the longest)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(0)])
            for d in np.unique(lengths[lengths > 0]):
                x = _matrix(batch.column(0).filter(pa.array(lengths == d)), int(d))
                # Halves of 30 bits, so that no sum over a batch leaves 64 bits.
                high, low = (x >> 30).sum(axis=0), (x & ((1 << 30) - 1)).sum(axis=0)
                n, total = found.get(int(d), (0, [0] * int(d)))
                found[int(d)] = n + len(x), [t + (int(h) << 30) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        rows = [(d, j, n, str(t)) for d, (n, total) in found.items() for j, t in enumerate(total)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["d", "j", "n", "total"])

    found = (fit.mapInArrow(add, "d long, j long, n long, total string").groupBy("d", "j")
             .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    most = found.where("j = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, 0, []
    totals = {r.j: int(r.total) for r in found.where(F.col("d") == most.d).collect()}
    return most.d, most.n, [totals[j] for j in range(most.d)]


@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list: ``total`` are exact sums of ``n`` vectors, ``components`` are columns by
    falling eigenvalue, ``values`` their eigenvalues, ``trace`` the sum of all eigenvalues."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.total)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - total)^2, exact; null where it leaves 64 bits."""
        near = [t // self.n for t in self.total]
        y, rest = x - np.array(near, np.int64), [t - self.n * m for t, m in zip(self.total, near, strict=True)]
        rough = ((y.astype(float) * self.n - np.array(rest, float)) ** 2).sum(axis=1)
        small = rough < 9e18
        exact = ((np.where(small[:, None], y, 0) * self.n - np.array(rest, np.int64) * small[:, None]) ** 2).sum(axis=1)
        out: list[int | None] = exact.tolist()
        for i in np.flatnonzero(~small):
            whole = sum((self.n * v - r) ** 2 for v, r in zip(y[i].tolist(), rest, strict=True))
            out[i] = whole if whole < 1 << 63 else None
        return out


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n in doubles: whole numbers are taken off exactly before the fraction is."""
    near = np.array([t // n for t in total], np.int64)
    return (x - near) - np.array([(t % n) / n for t in total])


def _solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 for an upper triangular r, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(fit: DataFrame, n: int, total: list[int], factors: list[np.ndarray], last: np.ndarray | None = None) -> np.ndarray:
    """Q'Q over the fit list, where Q is the centred rows through all ``factors`` (and times ``last``)."""
    d = len(total)
    k = d if last is None else last.shape[1]
    upper = np.triu_indices(k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for _, x in _slices(batches, 0):
            q = _centred(x, n, total)
            for r in factors:
                q = _solve(q, r)
            if last is not None:
                q = q @ last
            g += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int64()), pa.array(g[upper])],
                                         names=["cell", "value"])

    cells = fit.where(F.size("x") == d).select("x").mapInArrow(products, "cell long, value double")
    g = np.zeros((k, k))
    for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        g[upper[0][r.cell], upper[1][r.cell]] = r.value
    return g + np.triu(g, 1).T


def _factor(g: np.ndarray, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix; shifted by the error its products may hold, and further while it
    has none."""
    d = len(g)
    least = 11 * (d * (d + 1) + _ROWS * d) * _U * max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    shift = least if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(least, 16 * shift)


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """Mean, components and eigenvalues of the vectors ``x`` of ``fit`` (each counts once per row); None without any.

    Vectors of another length than the most frequent one are left out. Of the table only sums over it reach the
    driver: a number per dimension, and a matrix per pass, as large as a vector is long squared. Directions without
    any spread have no component, so there may be fewer components than dimensions. Equal eigenvalues may give any
    basis of their directions.
    """
    d, n, total = _sums(fit.select("x"))
    if not d:
        return None
    factors: list[np.ndarray] = []
    product = np.eye(d)
    while len(factors) < PASSES:
        g = _gram(fit, n, total, factors)
        spread = np.linalg.eigvalsh(g)
        if not g.any() or factors and np.all((abs(spread - 1) < 1e-12) | (spread <= _U ** 2)):
            break
        factors.append(_factor(g, shifted=not factors or spread[0] < 0.5))
        product = factors[-1] @ product
    if not factors:
        return Whitening(n, total, np.zeros((d, 0)), np.zeros(0), 0.0)
    _, s, right = np.linalg.svd(product)
    keep = s > EMPTY * s[0]
    right = right[keep] * np.where(right[keep][np.arange(keep.sum()), abs(right[keep]).argmax(axis=1)] < 0, -1, 1)[:, None]
    values = s ** 2 / n
    return Whitening(n, total, right.T, values[keep], float(values[keep].sum()))


def whiten(vectors: DataFrame, model: Whitening, components: int = 16) -> DataFrame:
    """vec_id, deviation, whitened: every vector on the first ``components`` components, each over its deviation.

    Vectors of another length than the model's are left out. One map.
    """
    first = Whitening(model.n, model.total, model.components[:, :components], model.values[:components], model.trace)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, 1):
            z = first.apply(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]) if z.size else np.zeros(len(x) + 1),
                                                      pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(first.deviation(x), pa.int64()), lists],
                                             names=["vec_id", "deviation", "whitened"])

    return vectors.where(F.size("x") == len(model.total)).select(F.col("vec_id").cast("long"), "x").mapInArrow(
        turn, "vec_id long, deviation long, whitened array<double>")


def identity_error(fit: DataFrame, model: Whitening, components: int = 16) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, from a pass over it."""
    scaled = (model.components / np.sqrt(model.values))[:, :components]
    g = _gram(fit, model.n, model.total, [], scaled) / model.n
    return float(abs(g - np.eye(len(g))).max())


def report(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """One row for each usable vector and component, the components fitted on each distinct integer vector once.

    Null vectors and vectors with null or non-finite entries have no rows (a null vec_id stays); repeated rows count
    once in the fit and come out each. Without two different vectors there is no component and no row, as with an
    empty table. Other columns are ignored. The distinct vectors are counted map-side first, so one that fills a third
    of the rows is no hot key, and are stored once for all passes.
    """
    vectors = integer_vectors(embeddings)
    fit = cut(vectors.select("x").distinct())
    model = fit_whitening(fit)
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], empty)
    error = identity_error(fit, model, components)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:components]])
    found = whiten(vectors, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
