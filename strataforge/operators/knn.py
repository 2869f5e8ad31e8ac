"""Distances to a bank of vectors: k-th neighbours, prototypes, class Gaussians."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.session import fresh_path

#: Bank rows that a worker compares with at once (at 1,024 components about 80 MB).
BANK_ROWS = 10_000
#: Distances that a worker holds at once (8 MB; it needs about four times that).
DISTANCES = 1 << 20
#: Distances that a task should make, and parts that rows are dealt to at most: their work is far more than their bytes.
WORK, PARTS = 20_000_000, 192


def _matrix(column: pa.Array) -> np.ndarray:
    if not column.null_count and isinstance(column, pa.ListArray) and len(column):
        flat = column.flatten()  # without a Python object for each number
        if not flat.null_count and len(set(np.diff(column.offsets.to_numpy()).tolist())) == 1:
            return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)
    return np.array(column.to_pylist(), np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _bank_blocks(folder: str, rows: int) -> Iterator[np.ndarray]:
    """Unit vectors of a bank in the shared folder, a block at a time."""
    place, root = fs.FileSystem.from_uri(folder)
    for info in sorted(place.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with place.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=["v"]):
                    if batch.num_rows:
                        yield unit_rows(_matrix(batch.column(0)))


def _least(x: np.ndarray, bank: np.ndarray, k: int, near: np.ndarray | None) -> np.ndarray:
    """The k least squared distances of each row so far (all, while they are fewer)."""
    d = x @ bank.T
    d *= -2.0
    d += 2.0
    np.maximum(d, 0.0, out=d)
    if d.shape[1] > k:
        d.partition(k - 1, axis=1)
        d = d[:, :k]
    if near is None:
        return d.copy()
    d = np.concatenate([near, d], axis=1)
    return np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d


def kth_distance(rows: DataFrame, bank: DataFrame, k: int, id_col: str, vector: str, bank_rows: int = BANK_ROWS) -> DataFrame:
    """``(id, knn)``: the Euclidean distance of each row to its k-th nearest bank row, both at unit length.

    The bank is written to the shared folder and never passes the driver: each task reads it in blocks, and of a row
    keeps k distances. Distances are made for slices of rows, and a file of the bank has a block at most (a reader
    holds a file's column as it is stored), so that a worker's memory does not grow with either table. One answer for each row, repeated ids included. A bank of under k rows is refused.
    """
    spark = rows.sparkSession
    folder = fresh_path(spark, "bank")
    bank.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).write.option("maxRecordsPerFile", bank_rows).parquet(folder)
    n = spark.read.parquet(folder).count()
    if n < k:
        raise ValueError(f"k = {k} needs a bank of at least k rows ({n})")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, near = unit_rows(_matrix(batch.column(1))), None
            for b in _bank_blocks(folder, bank_rows):
                found = [_least(x[at : at + step], b, k, None if near is None else near[at : at + step]) for step in [max(1, DISTANCES // len(b))] for at in range(0, len(x), step)]
                near = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(near.max(axis=1)))], names=["id", "knn"])

    kind = dict(rows.dtypes)[id_col]
    each = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = min(PARTS, -(-rows.count() * n // WORK))
    return (each.repartition(parts) if parts > 1 else each).mapInArrow(nearest, f"id {kind}, knn double")


@dataclass
class Gaussians:
    """Class means with one shared precision, and the background's."""

    means: np.ndarray
    precision: np.ndarray
    background_mean: np.ndarray
    background_precision: np.ndarray

    def distance(self, z: np.ndarray) -> np.ndarray:
        own = np.stack([_quadratic(z, m, self.precision) for m in self.means])
        return own.min(axis=0) - _quadratic(z, self.background_mean, self.background_precision)


def _quadratic(z: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    d = z - mean
    return ((d @ precision) * d).sum(axis=1)


def fit_gaussians(bank: DataFrame, label: str, vector: str, epsilon: float = 1e-3) -> Gaussians:
    """Sums and products of unit vectors are made by partition and added up; the driver gets classes x (D + D x D) numbers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = np.array(batch.column(0).to_pylist()), unit_rows(_matrix(batch.column(1)))
            for c in np.unique(y):
                z = x[y == c]
                n, s, p = sums.get(c, (0, 0, 0))
                sums[c] = n + len(z), s + z.sum(axis=0), p + z.T @ z
        for c, (n, s, p) in sums.items():
            m = np.concatenate([s, p.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([int(c)] * len(m), pa.int32()), pa.array(np.arange(len(m), dtype=np.int32)), pa.array([n] * len(m), pa.int64()), pa.array(m)], names=["c", "i", "n", "m"])

    added = bank.select(F.col(label).cast("int"), vector).mapInArrow(moments, "c int, i int, n bigint, m double").groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    table = added.toArrow().sort_by([("c", "ascending"), ("i", "ascending")])
    c, m, n = (table.column(k).to_numpy() for k in ("c", "m", "n"))
    classes = np.unique(c)
    per = m.reshape(len(classes), -1)
    size = n.reshape(len(classes), -1)[:, 0].astype(float)
    d = int((np.sqrt(1 + 4 * per.shape[1]) - 1) / 2)
    s, p = per[:, :d], per[:, d:].reshape(-1, d, d)
    means = s / size[:, None]
    within = (p - size[:, None, None] * means[:, :, None] * means[:, None, :]).sum(axis=0)
    whole, mean = size.sum(), s.sum(axis=0) / size.sum()
    around = p.sum(axis=0) - whole * np.outer(mean, mean)

    def ridged(scatter: np.ndarray, by: float) -> np.ndarray:
        cov = scatter / max(by, 1)
        if not np.trace(cov) > 0:
            raise ValueError("degenerate_score: the features have no spread")
        return np.linalg.inv(cov + epsilon * np.trace(cov) / d * np.eye(d))

    return Gaussians(means, ridged(within, whole - len(classes)), mean, ridged(around, whole - 1))


def mahalanobis(rows: DataFrame, fit: Gaussians, id_col: str, vector: str) -> DataFrame:
    """``(id, maha)``: the relative distance to the nearest class Gaussian."""
    shared = rows.sparkSession.sparkContext.broadcast(fit)

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.distance(unit_rows(_matrix(batch.column(1)))))], names=["id", "maha"])

    return rows.select(F.col(id_col).alias("id"), vector).mapInArrow(distance, f"id {dict(rows.dtypes)[id_col]}, maha double")
