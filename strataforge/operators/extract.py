"""Feature extraction in shards that can be resumed, and perceptual hashes of grey images."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators.gates import shards_left
from strataforge.sources.sinks import exists


def sharded(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """``rows`` with a ``shard`` by a hash of the key: no order and no count over all rows is needed."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def extract(rows: DataFrame, embed: Callable[[np.ndarray], np.ndarray], path: str, identity: dict[str, str], key: str = "image_id", vector: str = "v", shards: int = 64, batch: int = 32) -> int:
    """Writes ``(key, cls)`` for each row below ``path``, a folder for each shard; gives the number of shards done now.

    A shard is done once its features are written and its line is in the state table. A later call
    with the same identity (cache key, digest of the table, number of shards) does only what is
    left; another identity starts anew. Rows go through ``embed`` in batches; a failure costs the shards that are not done.
    """
    spark = rows.sparkSession
    own = {**identity, "shards": str(shards)}
    data, state = f"{path}/features", f"{path}/state"
    held = spark.read.parquet(state) if exists(spark, state) else None
    stamped = sharded(rows, key, shards).withColumns({k: F.lit(v) for k, v in own.items()})
    todo = stamped.select("shard", *own).distinct()
    again = False
    if held is not None:
        again = held.join(todo.select(*own).distinct(), list(own), "left_semi").isEmpty()
        todo = todo if again else shards_left(stamped, held, list(own))
    left = sorted(r["shard"] for r in todo.select("shard").collect())  # at most ``shards`` numbers
    if not left:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                x = np.array(part.column(1).to_pylist(), np.float64)
                y = embed(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(y.astype(np.float32)), pa.list_(pa.float32())), part.column(2)], names=[key, "cls", "shard"])

    chosen = stamped.where(F.col("shard").isin(left)).select(key, vector, "shard").repartition("shard")
    kind = dict(rows.dtypes)[key]
    found = chosen.mapInArrow(run, f"{key} {kind}, cls array<float>, shard int")
    writer = found.write.mode("overwrite").partitionBy("shard")
    # only the folders of the shards at hand are replaced, unless all start anew
    (writer if again or held is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(data)
    todo.write.mode("overwrite" if again else "append").parquet(state)
    return len(left)


def grey_phash(pixels: np.ndarray) -> str:
    """Perceptual hash of a 32 x 32 grey image (S08): signs of its lowest 8 x 8 cosine terms against their median, the first the most significant bit."""
    n = 32
    at = np.arange(n)
    basis = np.cos(np.pi / n * np.outer(at[:8], at + 0.5)) * math.sqrt(2 / n)
    basis[0] = math.sqrt(1 / n)
    low = basis @ np.asarray(pixels, np.float64).reshape(n, n) @ basis.T
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def grey_phashes(images: DataFrame, id_col: str, pixels: str) -> DataFrame:
    """``(id, phash, reason)``: images are arrays of 1,024 grey values; another length or a null is a reason, never a failed task."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, reasons = [], []
            for p in b.column(1):
                v = p.as_py()
                good = v is not None and len(v) == 1024 and None not in v
                hashes.append(grey_phash(np.array(v)) if good else None)
                reasons.append(None if good else "not_an_image" if v is None else "decode_error")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.string()), pa.array(reasons, pa.string())], names=["id", "phash", "reason"])

    kind = dict(images.dtypes)[id_col]
    return images.select(F.col(id_col).alias("id"), pixels).mapInArrow(mark, f"id {kind}, phash string, reason string")
