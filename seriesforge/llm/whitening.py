"""Embedding whitening: two passes for the covariance, a projection for every row.

1. Entries become integers; the fit list is each distinct integer vector once (Spark's distinct, which
   gathers copies before it deals them out). Its exact sums give the mean.
2. Tasks centre their vectors (exactly, as n * x - S) and add up outer products by one matrix product a
   batch; treeAggregate merges the tasks' sums in levels, so that the driver takes a few matrices only.
3. LAPACK's symmetric eigensolver runs on the driver on one dimension x dimension matrix, and the projection is broadcast.

What the driver and a task hold depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import stored
from seriesforge.llm.vectors import matrix, scaled, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Components whose eigenvalue is less than this share of the trace have no direction of their own.
LEAST_SHARE = 1e-12

ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double"


@dataclass(frozen=True)
class Fit:
    """n vectors with sums S; eigenvalues, falling, and unit eigenvectors as columns; the trace; identity_error."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if x.size and int(np.abs(x).max()) * self.n + int(np.abs(self.sums).max()) >= 1 << 62:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * self.n - self.sums

    def whiten(self, deviation: np.ndarray) -> np.ndarray:
        return (deviation / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = scaled(matrix(b.column("embedding")), SCALE) + SHIFT if b.num_rows else np.zeros((0, 0), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists], ["vec_id", "x"])


def integers(table: DataFrame) -> DataFrame:
    """vec_id and x, the integer vector, of every usable row."""
    return usable(table).mapInArrow(_integers, "vec_id long, x array<long>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for b in batches:
        if b.num_rows:
            x = matrix(b.column("x"))
            total = x.sum(0) if total is None else total + x.sum(0)
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), n]], pa.list_(pa.int64()))], ["sums"])


def exact_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors, and their sums by dimension."""
    rows = fit.select("x").mapInArrow(_sums, "sums array<long>").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not rows:
        return 0, np.zeros(0, np.int64)
    *sums, n = [int(r["s"]) for r in rows]
    return n, np.array(sums, np.int64)


def products(fit: DataFrame, outer) -> np.ndarray:
    """The sum of outer(x) over all batches x: each task adds up its own, treeAggregate merges the tasks'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = outer(matrix(b.column("x")))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def merged(a, b):
        return b if a is None else a if b is None else a + b

    parts = fit.select("x").mapInArrow(add, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    levels = max(2, round(np.log(max(2, parts.getNumPartitions())) / np.log(32)))
    flat = parts.treeAggregate(None, merged, merged, depth=levels)
    side = int(np.sqrt(len(flat)))
    return flat.reshape(side, side)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit on distinct vectors x; None if there are none.

    Directions without variance (all of them, if there is one vector) are no components.
    """
    n, sums = exact_sums(fit)
    if not n:
        return None
    plain = Fit(n, sums, np.ones(0), np.ones((len(sums), 0)), 0.0)

    def covariance(x: np.ndarray) -> np.ndarray:
        c = (plain.centred(x) / n).astype(np.float64)
        return c.T @ c

    v = products(fit, covariance) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(v))
    order = order[values[order] > LEAST_SHARE * trace]
    made = Fit(n, sums, values[order], vectors[:, order], trace)
    if not len(order):
        return made

    def identity(x: np.ndarray) -> np.ndarray:
        w = made.whiten(made.centred(x))
        return w.T @ w

    error = float(np.abs(products(fit, identity) / n - np.eye(len(order))).max())
    return Fit(n, sums, made.values, made.vectors, trace, error)


def _project(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    fit: Fit = shared.value
    k = len(fit.values)
    for b in batches:
        if not b.num_rows or not k:
            continue
        d = fit.centred(matrix(b.column("x")))
        most = int(np.abs(d).max())
        if most * most * d.shape[1] < 1 << 63:
            deviation = pa.array(np.einsum("ij,ij->i", d, d))
        else:
            exact = [sum(int(v) ** 2 for v in row) for row in d.tolist()]
            deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
        at = pa.array(np.repeat(np.arange(len(d)), k))
        tiled = lambda v: pa.array(np.tile(v, len(d)))
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id").take(at), tiled(np.arange(1, k + 1, dtype=np.int32)), tiled(np.full(k, fit.n)), deviation.take(at),
             pa.array(fit.whiten(d).ravel()), tiled(fit.values / fit.trace)], ["vec_id", "component", "n", "deviation", "whitened", "explained"])


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For every usable row and component: vec_id, component, n, deviation, whitened, explained and identity_error.

    Rows whose vector is null, holds nulls or non-finite entries, or has a length other than the most frequent, are
    dropped; repeated rows and null vec_ids stay. Fewer components come where the vectors have less directions; none if
    all are equal. deviation is null where it doesn't fit 64 bits. An empty table gives no rows.
    """
    spark = table.sparkSession
    x = integers(table)
    fit = stored(x.select("x").distinct(), "fit")
    made = fit_whitening(fit, components)
    if made is None:
        return spark.createDataFrame([], ROWS + ", identity_error double")
    shared = spark.sparkContext.broadcast(made)
    return x.mapInArrow(lambda it: _project(it, shared), ROWS).withColumn("identity_error", F.lit(made.identity_error))
