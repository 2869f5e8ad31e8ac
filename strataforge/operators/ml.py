"""Heads and probes on feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.vectors import dot, literal, unit
from strataforge.operators.knn import unit_rows
from strataforge.operators.ranks import numbered
from strataforge.session import staged

#: Rows that a head trained in one task may have.
TRAIN_ROWS = 200_000


def logistic(train: DataFrame, label: str, vector: str, weight: str | None = None, standardise: bool = False, ridge: float = 1e-3):
    """A multinomial logistic model fitted on the cluster."""
    rows = train.withColumn("__x", array_to_vector(F.col(vector))).withColumn("__y", F.col(label).cast("double"))
    steps, column = [], "__x"
    if standardise:
        steps.append(StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True))
        column = "__z"
    lr = LogisticRegression(featuresCol=column, labelCol="__y", probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r", regParam=ridge, maxIter=200, family="multinomial", standardization=False)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[*steps, lr]).fit(rows)


def apply_logistic(model, rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``pred`` and ``proba``."""
    out = model.transform(rows.withColumn("__x", array_to_vector(F.col(vector))))
    return out.withColumn("pred", F.col("__c").cast("int")).withColumn("proba", vector_to_array("__p")).drop("__x", "__z", "__c", "__p", "__r")


def prototypes(train: DataFrame, label: str, vector: str, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k unit prototypes of each class by spherical k-means, one class at a time on the cluster.

    A round is a pass over the rows that sums by nearest prototype; the driver holds
    classes x k vectors.
    """
    spark = train.sparkSession
    rows = staged(train.select(F.col(label).cast("int").alias("y"), F.col(vector).alias("v")), "prototype-rows")
    drawn = rows.groupBy("y").agg(F.min(F.struct(F.xxhash64("v", F.lit(seed)).alias("u"), F.col("v"))).alias("s0"), *[F.min(F.struct(F.xxhash64("v", F.lit(seed + 1000 * i)).alias("u"), F.col("v"))).alias(f"s{i}") for i in range(1, k)])
    first = {r["y"]: [np.array(r[f"s{i}"]["v"], float) for i in range(k)] for r in drawn.collect()}
    classes = sorted(first)
    centres = unit_rows(np.array([v for c in classes for v in first[c]])).reshape(len(classes), k, -1)
    place = {c: i for i, c in enumerate(classes)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total = np.zeros(c.shape)
            for batch in batches:
                if batch.num_rows:
                    y = np.array([place[v] for v in batch.column(0).to_pylist()])
                    x = unit_rows(np.array(batch.column(1).to_pylist(), float))
                    near = np.einsum("nd,nkd->nk", x, c[y]).argmax(axis=1)
                    np.add.at(total, (y, near), x)
            at = np.flatnonzero(total.any(axis=-1).ravel())
            flat = total.reshape(-1, c.shape[-1])[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, c.shape[-1]).astype(np.int32)), pa.array(np.tile(np.arange(c.shape[-1], dtype=np.int32), len(at))), pa.array(flat.ravel())], names=["c", "i", "m"])

        table = rows.mapInArrow(sums, "c int, i int, m double").groupBy("c", "i").agg(F.sum("m").alias("m")).toArrow()
        new = centres.reshape(-1, centres.shape[-1]).copy()
        got = np.zeros_like(new)
        got[table["c"].to_numpy(), table["i"].to_numpy()] = table["m"].to_numpy()
        some = got.any(axis=1)
        new[some] = unit_rows(got[some])
        new = new.reshape(centres.shape)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


def prototype_logits(vector: Column, centres: np.ndarray, temperature: float) -> Column:
    """The largest cosine to a class's prototypes, over the temperature, by class."""
    x = unit(vector)
    return F.transform(F.array(*[literal(c) for c in centres]), lambda protos: F.array_max(F.transform(protos, lambda p: dot(x, p))) / F.lit(temperature))


def balanced_draw(rows: DataFrame, label: str, n: int, seed: int, id_col: str) -> DataFrame:
    """``(id, times)``: ``n`` draws with replacement, every class as often as another.

    Of k classes in order the first n mod k get one draw more than the others. The rows of a class are
    numbered by id; a draw's number is a hash of seed, class and draw, so reruns agree, and the draws are dealt out
    by a join on (class, number).
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("__label")).where("__label is not null")
    counts = base.groupBy("__label").agg(F.count(F.lit(1)).alias("__n"))
    classes = numbered(counts, [F.col("__label")], "__k")
    k = counts.count()
    if not k:
        return base.select("id", F.lit(0).cast("bigint").alias("times")).limit(0)
    each = classes.withColumn("__draws", F.lit(n // k) + (F.col("__k") <= n % k).cast("int")).where("__draws > 0")
    draws = each.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.col("__draws"))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "__label", F.col("__draw").cast("string"))), 1, 15)
    place = F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.col("__n")) + 1
    times = draws.groupBy("__label", place.alias("__place")).agg(F.count(F.lit(1)).alias("times"))
    return numbered(base, [F.col("id")], "__place", ["__label"]).join(times, ["__label", "__place"]).select("id", "times")


def focal_loss(p_true: Column, gamma: float) -> Column:
    return -F.pow(1.0 - p_true, F.lit(gamma)) * F.log(F.greatest(p_true, F.lit(1e-12)))


def train_heads(rows: DataFrame, label: str, vector: str, configs: list[dict]) -> DataFrame:
    """Linear heads by AdamW with focal loss and label smoothing, one task for each (config, seed).

    The grid of configs is what is distributed. Of more than ``TRAIN_ROWS`` rows, a sample of about as many is learned
    from, drawn by a hash of label and vector. Returns ``(config, weights)``.
    """
    n = rows.count()
    drawn = F.pmod(F.xxhash64(label, vector), F.lit(1 << 30)) < int(min(1.0, TRAIN_ROWS / max(n, 1)) * (1 << 30))
    slice_ = rows.select(F.col(label).cast("int").alias("y"), F.col(vector).alias("v")).where(F.lit(True) if n <= TRAIN_ROWS else drawn)
    table = slice_.limit(TRAIN_ROWS + TRAIN_ROWS // 10).toArrow()
    y = table["y"].to_numpy()
    x = np.array(table["v"].to_pylist(), float)
    shared = rows.sparkSession.sparkContext.broadcast((x, y))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = shared.value
        c = pdf.iloc[0]
        w = adamw(x, y, float(c["rate"]), float(c["decay"]), float(c["gamma"]), float(c["smoothing"]), int(c["epochs"]), int(c["seed"]))
        return pd.DataFrame({"config": [int(c["config"])], "weights": [w.ravel().tolist()]})

    grid = rows.sparkSession.createDataFrame([(i, c["rate"], c["decay"], c["gamma"], c["smoothing"], c["epochs"], c["seed"]) for i, c in enumerate(configs)], "config int, rate double, decay double, gamma double, smoothing double, epochs int, seed int")
    return grid.groupBy("config").applyInPandas(fit, "config int, weights array<double>")


def adamw(x: np.ndarray, y: np.ndarray, rate: float, decay: float, gamma: float, smoothing: float, epochs: int, seed: int, size: int = 64) -> np.ndarray:
    """(classes, D + 1) weights of a linear head; batches are drawn so that classes weigh alike."""
    rng = np.random.default_rng(seed)
    k = int(y.max()) + 1
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    chance = 1.0 / np.bincount(y, minlength=k)[y]
    chance /= chance.sum()
    target = np.full((len(x), k), smoothing / k)
    target[np.arange(len(x)), y] += 1 - smoothing
    w, m, v, t = np.zeros((k, x.shape[1])), 0.0, 0.0, 0
    for _ in range(epochs):
        for at in np.array_split(rng.choice(len(x), len(x), p=chance), max(1, len(x) // size)):
            z = x[at] @ w.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            log = np.log(np.maximum(p, 1e-12))
            q = 1 - p
            outer = target[at] * (gamma * q ** max(gamma - 1, 0) * log * p - q**gamma) if gamma else -target[at]
            g = ((outer - p * outer.sum(axis=1, keepdims=True)).T @ x[at]) / len(at)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
