"""Whitening of embeddings from a covariance in two passes.

Vectors are brought to integers, ``x = floor(64 c) + 1000000``, and fitted over their distinct values, so copies count once.  The first pass adds exact integer
sums; they give the mean as an exact fraction.  The second pass adds products of vectors that were centred before (the whole part of the mean is taken off in
integers, so nothing is lost to the size of ``x``): a matrix product a batch, one matrix a task, merged by ``treeAggregate``.  LAPACK's symmetric solver gives
the components, largest eigenvalue first; a third pass measures the covariance of the whitened fit list.  Mean and components, a few numbers a dimension,
go to all tasks, and every row is projected where it lies.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; empty vectors have no component and give no row; vectors of different lengths are
whitened apart, each length with a fit of its own (the error reported is the largest of all); a direction whose eigenvalue is below ``RANK`` of the first
(such as that of a constant entry) is within the rounding of the covariance and is no component, so a single or constant vector has none; entries beyond 2^62 / 64
count as that; a ``deviation`` beyond 64 bits is null; null and repeated ids are rows of their own; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch

#: Entries are multiplied, floored and shifted by these.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Least share of the first eigenvalue that a component holds.
RANK = 1e-10
LIMIT = 1 << 62
#: Vectors taken at once.
ROWS = 4_096


@dataclass
class Fit:
    """Of one length: ``n`` distinct vectors, their sums without ``SHIFT``, and after the second pass the components (columns) and their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What the whole part of the mean leaves, times ``n``."""
        return [s % self.n for s in self.sums]

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum over the entries of the square of ``n x - sum``; whole numbers of any size."""
        off, rest, n = y - self.whole, self.rest, self.n
        most = int(np.abs(off.astype(np.float64)).max(initial=0)) + 1
        if most * most * len(rest) >= LIMIT or most * n * len(rest) >= LIMIT:
            off = off.astype(object)
        r = np.array(rest, off.dtype)
        squares, mixed, last = (off * off).sum(axis=1), (off * r).sum(axis=1), sum(x * x for x in rest)
        found = [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed, strict=True)]
        return [x if x < 1 << 63 else None for x in found]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (self.centred(y) @ self.axes) / np.sqrt(self.values)


def vectors_of(column: pa.Array):
    """Row numbers and matrix of the vectors of each length that are whole and finite."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        for some in np.array_split(rows, -(-len(rows) // ROWS)):
            found = flat[starts[some][:, None] + np.arange(dim)]
            good = np.isfinite(found).all(axis=1)
            if good.any():
                yield some[good], found[good]


def integers(vectors: np.ndarray) -> np.ndarray:
    """``x`` without ``SHIFT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -LIMIT, LIMIT).astype(np.int64)


def coded(rows: DataFrame, vector: str) -> DataFrame:
    """``dim, code``: each vector's integers as bytes, four an entry where they fit."""

    def run(batches):
        for batch in batches:
            for _, found in vectors_of(batch.column(0)):
                y = integers(found)
                dims, codes = pa.array(np.full(len(y), y.shape[1], np.int32)), [None] * len(y)
                short = (y == y.astype(np.int32)).all(axis=1)
                for rows, kind in ((short, "<i4"), (~short, "<i8")):
                    for i, raw in zip(np.flatnonzero(rows), y[rows].astype(kind), strict=True):
                        codes[i] = raw.tobytes()
                yield pa.RecordBatch.from_arrays([dims, pa.array(codes, pa.binary())], names=["dim", "code"])

    return rows.select(vector).mapInArrow(run, "dim int, code binary")


def decoded(batch: pa.RecordBatch):
    """Length and integers of the coded vectors of a batch."""
    codes = batch.column(1)
    lengths, dims = codes.cast(pa.large_binary()), batch.column(0).to_numpy()
    sizes = pc.binary_length(lengths).to_numpy()
    for dim in np.unique(dims).tolist():
        for width in (4, 8):
            rows = np.flatnonzero((dims == dim) & (sizes == dim * width))
            for some in np.array_split(rows, -(-len(rows) // ROWS)) if len(rows) else ():
                yield dim, np.frombuffer(b"".join(codes.take(pa.array(some)).to_pylist()), f"<i{width}").reshape(-1, dim).astype(np.int64)


def summed(codes: DataFrame, terms) -> dict[int, tuple]:
    """For each length the number of vectors and the sums of ``terms(dim, integers)``: arrays added up in a task, the tasks' merged as a tree."""

    def run(batches):
        import pickle

        found: dict = {}
        for batch in batches:
            for dim, y in decoded(batch):
                merge(found, {dim: (len(y), *terms(dim, y))})
        for dim, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([pickle.dumps(own)])], names=["dim", "own"])

    def merge(a: dict, b: dict) -> dict:
        for dim, own in b.items():
            a[dim] = tuple(x + y for x, y in zip(a[dim], own, strict=True)) if dim in a else own
        return a

    def add(a: dict, row) -> dict:
        import pickle

        return merge(a, {row["dim"]: pickle.loads(row["own"])})

    return codes.mapInArrow(run, "dim int, own binary").rdd.treeAggregate({}, add, merge)


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[dict[int, Fit], float]:
    """The fit of each length, and the largest entry of the whitened covariance less the identity."""
    scratch = Scratch(rows.sparkSession, "whitening")
    codes = scratch.keep(coded(rows, vector).distinct(), "distinct")

    def halves(_, y):
        """Sums of the upper and the lower 31 bits; Python's numbers, which have no end."""
        return (y >> 31).sum(axis=0).astype(object) * (1 << 31) + (y & ((1 << 31) - 1)).sum(axis=0).astype(object),

    fits = {dim: Fit(n, [int(s) for s in sums]) for dim, (n, sums) in summed(codes, halves).items()}

    def products(dim, y):
        c = fits[dim].centred(y)
        return (c.T @ c,)

    for dim, (n, total) in summed(codes, products).items():
        own, covariance = fits[dim], total / n
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        values, axes = values[::-1], axes[:, ::-1]
        own.trace = float(np.trace(covariance))
        taken = min(components, int((values > max(values[0], 0.0) * RANK).sum()))
        axes = axes[:, :taken]
        own.values, own.axes = values[:taken], axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(taken)] < 0, -1.0, 1.0)

    def squares(dim, y):
        w = fits[dim].whitened(y)
        return w.sum(axis=0), w.T @ w

    error = 0.0
    for n, ones, pairs in summed(codes, squares).values():
        mean = ones / n
        error = max(error, float(np.abs(pairs / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0)))
    return fits, error


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``key, n, deviation, whitened, explained, identity_error`` of each vector that remains; whitened and explained are arrays by component."""
    fits, error = fit(rows, vector, components)
    sent = rows.sparkSession.sparkContext.broadcast(fits)  # a fit is dim x components numbers, whatever the number of rows

    def run(batches):
        for batch in batches:
            for at, found in vectors_of(batch.column(1)):
                own, y = sent.value[found.shape[1]], integers(found)
                w, k = own.whitened(y), len(own.values)
                lists = lambda a, k=k, m=len(y): pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(a).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(y), own.n)), pa.array(own.deviation(y), pa.int64()), lists(w), lists(np.tile(own.values / own.trace, (len(y), 1)) if k else w), pa.array(np.full(len(y), error))],
                    names=[key, "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
