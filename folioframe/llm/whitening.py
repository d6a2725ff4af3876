"""Operator 11: whitening of embeddings by a covariance of two passes.

A component c of a vector becomes the integer x = floor(256 * c), held within 64 bits. The model is
fitted on the distinct x vectors, each once. The first pass adds them up in integers, so the mean
is exact whatever the order; the second adds outer products of the centred rows, one matrix product
a batch. Both are merged by ``treeAggregate``; LAPACK's symmetric solver gives the components, and a
broadcast projection whitens every row.

Scale: the distinct vectors are found by a hash aggregation, so a vector that a third of the rows
share is collapsed before the shuffle; they are written once, packed to the narrowest integers, and
read by the passes. A task hands on one matrix of d x d doubles, and no task or driver holds more
than a few of them. The projection is a map.

Edge cases: rows whose vector is null, or holds a null or non-finite entry, are dropped, and so are
empty vectors and those of another length than most distinct vectors have (of two such lengths the
greater counts). Null and repeated ids are kept as they are. Directions without variance (an
eigenvalue within rounding of zero) are no components, so a table of one distinct vector gives no rows,
and an empty table none. A deviation beyond 64 bits is null. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, release, scratch, table

COMPONENTS = 4
SCALE = 256
LEAST, MOST = -(2.0**63), 2.0**63


@dataclass
class Model:
    """Count, exact sums, mean, eigenvalues and components (as columns) of the distinct integer vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float = 0.0


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * c) as 64-bit integers; what lies beyond them becomes the nearest one."""
    scaled = np.floor(values * SCALE)
    inside = (scaled >= LEAST) & (scaled < MOST)
    out = np.where(inside, scaled, 0).astype(np.int64)
    out[scaled >= MOST] = np.iinfo(np.int64).max
    out[scaled < LEAST] = np.iinfo(np.int64).min
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: a digit for the width, then its entries as the narrowest integers that hold them."""
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    left = np.ones(len(x), dtype=bool)
    for width in (1, 2, 4, 8):
        info = np.iinfo(f"i{width}")
        fits = np.flatnonzero(left & (low >= info.min) & (high <= info.max))
        left[fits] = False
        for at, row in zip(fits.tolist(), x[fits].astype(f"<i{width}")):
            out[at] = b"%d" % width + row.tobytes()
    return out


def unpacked(rows: pa.Array, size: int) -> np.ndarray:
    """The integer rows that :func:`packed` made bytes of."""
    values = rows.to_pylist()
    out = np.empty((len(values), size), dtype=np.int64)
    for width in (1, 2, 4, 8):
        at = [k for k, v in enumerate(values) if v[0] == 48 + width]
        if at:
            out[at] = np.frombuffer(b"".join(values[k][1:] for k in at), dtype=f"<i{width}").reshape(len(at), size)
    return out


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not empty and whose entries are all finite numbers."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole)


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, integer rows) of an Arrow column of vectors, one pair for each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.r_[0, np.cumsum(sizes)]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def distinct(rows: DataFrame, vector: str) -> DataFrame:
    """``size`` and packed ``x`` of every distinct integer vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(packed(x), pa.binary())], ["size", "x"])

    return usable(rows.select(vector), vector).mapInArrow(run, "size int, x binary").distinct()


def _merged(parts: DataFrame, size: int, work, zero, merge):
    """``work`` over each task's matrices of integer rows, the results merged by treeAggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = work(unpacked(batch.column(0), size))
                total = got if total is None else merge(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    found = parts.select("x").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return found.treeAggregate(zero, merge, merge)


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors, or None if there is no usable one."""
    spark = rows.sparkSession
    bounded_batches(spark)
    kept = scratch(distinct(rows, vector), "vectors")
    sizes = kept.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        release(kept)
        return None
    size = sizes[0]["size"]
    parts = kept.filter(F.col("size") == size)

    def added(x: np.ndarray):
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        return len(x), [(int(h) << 32) + int(v) for h, v in zip(high, low)]

    n, sums = _merged(parts, size, added, (0, [0] * size), lambda a, b: (a[0] + b[0], [u + v for u, v in zip(a[1], b[1])]))
    mean = np.array([s / n for s in sums])  # integers divide to the nearest double
    known = spark.sparkContext.broadcast(mean)

    def outer(x: np.ndarray) -> np.ndarray:
        centred = x - known.value
        return centred.T @ centred

    covariance = _merged(parts, size, outer, np.zeros((size, size)), lambda a, b: a + b) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    some = values > max(values[0], 0) * size * np.finfo(float).eps
    values, axes = values[some][:components], axes[:, some][:, :components]
    model = Model(n, sums, mean, values, axes, float(np.trace(covariance)))
    if len(values):
        shared = spark.sparkContext.broadcast(model)

        def whitened(x: np.ndarray) -> np.ndarray:
            y = _projected(x, shared.value)
            return y.T @ y

        again = _merged(parts, size, whitened, np.zeros((len(values),) * 2), lambda a, b: a + b) / n
        model.error = float(np.abs(again - np.eye(len(values))).max())
    release(kept)
    return model


def _projected(x: np.ndarray, model: Model) -> np.ndarray:
    return (x - model.mean) @ model.axes / np.sqrt(model.values)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact; null where it takes more than 63 bits.

    The differences are taken modulo 2^64, which is exact where they fit; an estimate in doubles
    tells where they and the sum of their squares do.
    """
    rough = ((n * x.astype(np.float64) - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        off = x.view(np.uint64) * np.uint64(n % 2**64) - np.array([s % 2**64 for s in sums], dtype=np.uint64)
        exact = (off * off).sum(axis=1, dtype=np.uint64)
    fits = (rough < 1.5 * 2.0**63) & (exact < np.uint64(2**63))
    return pa.array(exact.view(np.int64), pa.int64(), mask=~fits)


def whiten(rows: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error: a row a component of every usable row."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, vector, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        many = len(m.values)
        explained = m.values / m.trace
        for batch in batches:
            for at, x in _matrices(batch.column(1)):
                if not len(x) or x.shape[1] != len(m.mean):
                    continue
                places = pa.array(np.repeat(np.arange(len(x)), many))
                columns = [
                    batch.column(0).take(pa.array(at)).take(places), np.tile(np.arange(1, many + 1, dtype=np.int32), len(x)), np.full(len(x) * many, m.n),
                    deviations(x, m.n, m.sums).take(places), _projected(x, m).ravel(), np.tile(explained, len(x)), np.full(len(x) * many, m.error),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(rows.select(key, vector), vector).mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first four whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
