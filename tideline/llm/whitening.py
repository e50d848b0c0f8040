"""Whitening of embeddings by pairwise merged moments.

Each partition works out its count, mean and centred scatter, batch by batch, and Chan's
formula merges two such triples into that of the rows of both; ``treeReduce`` does so over
partitions, so that what any task or the driver holds is a few square matrices of the
dimension. The driver takes the eigenvectors of the covariance; a second pass merges the
moments of the whitened rows in the same way, and tells how far their covariance is from the identity.
Entries are whole numbers, so sums and deviations are exact.

Defined results: a vector that is null or empty, or holds null or non-finite entries, is
left out, and so is one of another length than the most frequent (the longest of those); equal
rows and rows with null ids count as any other; other columns are ignored; components with no
variance (an eigenvalue under ``LEAST_SHARE`` of the trace) give no rows, so that equal vectors
alone give an empty result, as an empty table does. Entries beyond ``LARGEST``, and deviations
that no long holds, raise ``OverflowError``: a wrapped sum would be a wrong one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import ship_package

SCALE, SHIFT = 1024.0, 100_000
LARGEST = 2**40
LEAST_SHARE = 1e-13
BATCH = 4096


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def none(cls, dims: int) -> Moments:
        return cls(0, [0] * dims, np.zeros(dims), np.zeros((dims, dims)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        """Those of a block of rows; of whole numbers, the sums are exact."""
        if not len(rows):
            return cls.none(rows.shape[1])
        mean = rows.mean(axis=0, dtype=np.float64)
        centred = rows - mean
        # what rounding left in the mean is taken out of the scatter again
        rest = centred.mean(axis=0)
        sums = [int(x) for x in rows.sum(axis=0)] if rows.dtype == np.int64 else [0] * rows.shape[1]
        return cls(len(rows), sums, mean + rest, centred.T @ centred - len(rows) * np.outer(rest, rest))

    def merge(self, other: Moments) -> Moments:
        """Chan's formula: the moments of the rows of both."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + apart * (other.n / n), scatter)

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


@dataclass
class Whitening:
    """A fitted transformation: eigenvalues fall, eigenvectors are rows with their largest entry positive."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def of(cls, moments: Moments, most: int) -> Whitening:
        dims = len(moments.sums)
        if not moments.n:
            return cls(0, moments.sums, np.zeros(0), np.zeros((0, dims)), 0.0)
        values, vectors = np.linalg.eigh(moments.covariance)
        trace = float(np.trace(moments.covariance))
        order = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > LEAST_SHARE * trace]
        chosen = vectors[:, order].T
        largest = np.abs(chosen).argmax(axis=1)
        return cls(moments.n, moments.sums, values[order], chosen * np.sign(chosen[np.arange(len(order)), largest])[:, None], trace)

    def centred(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact deviations ``n * x - S`` of rows, and their squares' sums."""
        largest = max([int(np.abs(rows).max(initial=0)), *(abs(s) // max(1, self.n) + 1 for s in self.sums)])
        if self.n * largest >= 2**62:
            apart = rows.astype(object) * self.n - np.array(self.sums, object)
        else:
            apart = rows * self.n - np.array(self.sums, np.int64)
        most = max((abs(int(x)) for x in (apart.max(initial=0), apart.min(initial=0))), default=0)
        if most * most * max(1, rows.shape[1]) >= 2**63:
            apart = apart.astype(object)
        totals = (apart * apart).sum(axis=1) if len(rows) else np.zeros(0, np.int64)
        if totals.dtype == object:
            if max(totals, default=0) >= 2**63:
                raise OverflowError("a deviation doesn't fit into a long")
            totals = totals.astype(np.int64)
        return apart, totals

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """Whitened coordinates of deviations."""
        return (apart.astype(np.float64) / self.n) @ self.vectors.T / np.sqrt(self.values)


def usable(vec: str) -> Column:
    """Vectors without null and non-finite entries."""
    x = F.col(vec)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~odd, F.lit(False))


def _blocks(column: pa.Array, dims: int) -> np.ndarray:
    """A list column, without nulls, as rows of whole numbers."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    if np.abs(entries).max(initial=0) >= LARGEST / SCALE:
        raise OverflowError(f"an entry beyond {LARGEST / SCALE:g}")
    return np.floor(SCALE * entries).astype(np.int64) + SHIFT


def merged(rows: DataFrame, vec: str, dims: int, model: Whitening | None = None) -> Moments:
    """Moments of the vectors, or of their whitened coordinates, by a tree over the partitions."""
    width = dims if model is None else len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.none(width)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                block = _blocks(batch.column(0).slice(at, BATCH), dims)
                total = total.merge(Moments.of(block if model is None else model.whitened(model.centred(block)[0])))
        if total.n:
            row = [[total.n], [[str(x) for x in total.sums]], [total.mean.tobytes()], [total.scatter.tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["n", "sums", "mean", "scatter"])

    def one(row) -> Moments:  # noqa: ANN001
        return Moments(row.n, [int(x) for x in row.sums], np.frombuffer(row.mean), np.frombuffer(row.scatter).reshape(width, width))

    partial = rows.select(vec).mapInArrow(run, "n bigint, sums array<string>, mean binary, scatter binary").rdd.map(one)
    if not partial.getNumPartitions():
        return Moments.none(width)
    none = rows.sparkSession.sparkContext.parallelize([Moments.none(width)], 1)
    return none.union(partial).treeReduce(Moments.merge, depth=3)


def fit(vectors: DataFrame, vec: str = "embedding", most: int = 8) -> tuple[Whitening, DataFrame]:
    """A transformation fitted to all usable vectors, and the rows that have these."""
    ship_package(vectors.sparkSession)
    good = vectors.where(usable(vec))
    # one row for each length that occurs, of which the first is asked for
    length = good.groupBy(F.size(vec).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = length["dims"] if length else 0
    good = good.where(F.size(vec) == dims)
    return Whitening.of(merged(good, vec, dims) if dims else Moments.none(0), most), good


def identity_error(model: Whitening, good: DataFrame, vec: str = "embedding") -> float:
    """The largest entry, by absolute value, of the whitened rows' covariance minus the identity."""
    if not len(model.values):
        return 0.0
    moments = merged(good, vec, model.vectors.shape[1], model)
    return float(np.abs(moments.covariance - np.eye(len(model.values))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", most: int = 8) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and component.

    The model is fitted and verified when this is called; the rows themselves are worked out without a shuffle.
    """
    model, good = fit(vectors, vec, most)
    error = identity_error(model, good, vec)
    dims = model.vectors.shape[1]
    kind = vectors.schema[id_col].dataType.simpleString()
    shares = model.values / model.trace if len(model.values) else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows if width else 0, BATCH):
                part = batch.slice(at, BATCH)
                apart, totals = model.centred(_blocks(part.column(1), dims))
                rows = part.num_rows
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * width, model.n, np.int64)),
                    pa.array(np.repeat(totals, width)),
                    pa.array(model.whitened(apart).reshape(-1)),
                    pa.array(np.tile(shares, rows)),
                    pa.array(np.full(rows * width, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return good.select(id_col, vec).mapInArrow(
        run, f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
