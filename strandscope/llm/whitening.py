"""Embedding whitening by TSQR: the R factor of all centred rows, without their covariance.

Rows are centred with exact integer sums. Every task folds its rows into one
triangular factor, blocks of rows at a time; factors are then stacked and
factored again in a tree of ``fan_in`` branches until one is left. Its right
singular vectors are the eigenvectors of the covariance, and its squared
singular values, over the number of rows, the eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

SCALE, SHIFT = 64, 1_000_000
#: Rows that are factored at a time.
ROWS = 8_192
#: Singular values below this share of the largest are of dimensions that the rows don't span.
RANK = 1e-9


def integer_vectors(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, floor(64 c) + 1,000,000 of each entry c, of the rows whose vector has only finite entries.

    Vectors of another length than the most frequent one (of equally frequent
    ones, the longer) can't be compared with the others and are left out too.
    """
    entry = lambda c: F.isnull(c) | F.isnan(c) | (F.abs(c) == float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("c")).where(F.col("c").isNotNull() & ~F.exists("c", entry))
    sizes = rows.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return rows.where(F.size("c") == size).select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Whitening:
    """``axes`` are rows, one for each component by falling ``eigenvalues``; ``n`` rows with per-dimension ``sums`` were fitted."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes.T / np.sqrt(self.eigenvalues)


def _tree(parts: DataFrame, schema: str, merge: Callable[[list[dict]], dict], fan_in: int) -> list:
    """Merge rows of (node, ...), one for each task, ``fan_in`` at a time and round by round; the last row, if there is one, is returned."""
    nodes = max(1, parts.rdd.getNumPartitions())
    while nodes > 1:
        nodes = -(-nodes // fan_in)

        def fold(table: pa.Table) -> pa.Table:
            return pa.Table.from_pylist([merge(table.to_pylist())], table.schema)

        parts = parts.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node").applyInArrow(fold, schema)
    return parts.collect()


_FACTOR = "node long, n long, factor binary"


def _r(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def fit(vectors: DataFrame, components: int = 32, *, fan_in: int = 8) -> Whitening | None:
    """Fit to all ``vectors`` (of ``integer_vectors``); None without any. What reaches the driver is one row of sums and one factor, of the vectors' length squared."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column("x")).sum(axis=0)
                n, sums = n + batch.num_rows, own if sums is None else sums + own
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.int64()))], names=["n", "sums"])

    partial = vectors.select("x").mapInArrow(add, "n long, sums array<long>")
    totals = partial.select("n", F.posexplode("sums").alias("dimension", "value")).groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).orderBy("dimension").collect()
    if not totals:
        return None
    n, sums = totals[0]["n"], np.array([r["value"] for r in totals], np.int64)
    width = len(sums)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((0, width)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("x").slice(at, ROWS))
                r, seen = _r(np.vstack([r, (n * x - sums) / n])), seen + len(x)
        if seen:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "n", "factor"])

    def stack(rows: list[dict]) -> dict:
        rows.sort(key=lambda x: x["factor"])  # whatever order they came in
        held = np.vstack([np.frombuffer(x["factor"], np.float64).reshape(-1, width) for x in rows])
        return {"node": rows[0]["node"], "n": sum(x["n"] for x in rows), "factor": _r(held).tobytes()}

    (last,) = _tree(vectors.select("x").mapInArrow(factor, _FACTOR), _FACTOR, stack, fan_in)
    r = np.frombuffer(last["factor"], np.float64).reshape(-1, width)
    _, s, axes = np.linalg.svd(r, full_matrices=False)
    kept = [i for i in range(min(components, len(s))) if s[i] > RANK * s[0]]
    return Whitening(n, sums, axes[kept], s[kept] ** 2 / n, float((s**2).sum() / n))


_MOMENTS = "node long, n long, mean array<double>, products array<double>"


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of rows together."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def identity_error(whitened: DataFrame, *, fan_in: int = 8) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, from its rows, centred before they are multiplied."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch.column("whitened"))
                mean = w.mean(axis=0)
                own = len(w), mean, (w - mean).T @ (w - mean)
                held = own if held is None else _joined(held, own)
        if held:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.list_(pa.float64())), pa.array([held[2].ravel()], pa.list_(pa.float64()))], names=["node", "n", "mean", "products"])

    def merge(rows: list[dict]) -> dict:
        rows.sort(key=lambda x: x["mean"])
        width = len(rows[0]["mean"])
        held = None
        for x in rows:
            own = x["n"], np.array(x["mean"]), np.array(x["products"]).reshape(width, width)
            held = own if held is None else _joined(held, own)
        return {"node": rows[0]["node"], "n": held[0], "mean": held[1].tolist(), "products": held[2].ravel().tolist()}

    found = _tree(whitened.select("whitened").mapInArrow(measure, _MOMENTS), _MOMENTS, merge, fan_in)
    if not found or not found[0]["mean"]:
        return None
    width = len(found[0]["mean"])
    return float(np.abs(np.array(found[0]["products"]).reshape(width, width) / found[0]["n"] - np.eye(width)).max())


_ROWS = "vec_id long, deviation long, whitened array<double>"


def whiten(embeddings: DataFrame, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", fan_in: int = 8) -> tuple[DataFrame, Whitening | None, float | None]:
    """Rows of vec_id, deviation and whitened (one value for each component), the fit, and the measured error of its identity.

    Rows whose vector is null or has a null or non-finite entry, or another
    length than most, are left out; repeated rows and rows without an id are
    fitted and returned each. ``deviation`` is exact, and null where it needs
    more than 64 bits. There are as many components as were asked for, at most
    as many as dimensions that the rows span: none for a single row or equal
    ones, which then have no values. An empty table has no rows and no fit.
    Other columns are not read.
    """
    spark = embeddings.sparkSession
    space = Workspace(spark)
    vectors = integer_vectors(embeddings, id_col=id_col, vector_col=vector_col)
    fitted = fit(vectors, components, fan_in=fan_in)
    if fitted is None:
        return spark.createDataFrame([], _ROWS), None, None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            apart = fitted.n * x - fitted.sums
            fits = (apart.astype(np.float64) ** 2).sum(axis=1) < 9.2e18
            far = (np.where(fits[:, None], apart, 0) ** 2).sum(axis=1)
            yield pa.record_batch([batch.column("vec_id"), pa.array(far, pa.int64(), mask=~fits), pa.array(list(fitted.project(x)), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    rows = space.table(vectors.mapInArrow(project, _ROWS), "whitened")
    return rows, fitted, identity_error(rows, fan_in=fan_in)
