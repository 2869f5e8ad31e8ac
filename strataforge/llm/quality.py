"""Operator 3: quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.arrow_text import NOT_SPACE, STEP_BYTES, byte_table, gram_hashes, rows_per_batch, spans, steps, word_hashes

#: Buckets of byte trigrams, latent dimensions, labelled rows that are learned from at most (about), neighbours that vote.
TERMS, LATENT, TRAIN_ROWS, NEIGHBOURS = 2048, 64, 4096, 25
#: Weight of the style terms beside the trigram terms of a text.
STYLE = 0.5

_KINDS = [
    byte_table((0x41, 0x5A)),
    byte_table((0x61, 0x7A)),
    byte_table((0x30, 0x39)),
    byte_table((0x80, 0xFF)),
    byte_table((0x20, 0x20)),
    byte_table((0x0A, 0x0A)),
    byte_table((0x21, 0x21), (0x3F, 0x3F)),
    byte_table((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B)),
    byte_table((0x22, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
]
STYLES = len(_KINDS) + 5
WIDTH = TERMS + STYLES


def term_vectors(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts by hashed byte trigram and style terms) in steps; empty and null texts are all zero."""
    for first, end, data, offsets in steps(texts):
        rows = end - first
        out = np.zeros((rows, WIDTH), np.float32)
        size = np.diff(offsets)
        if len(data):
            n = np.maximum(size, 1)
            counts, kinds = _tallies(data, offsets)
            out[:, :TERMS] = np.log1p(counts)
            out[:, TERMS : TERMS + len(_KINDS)] = kinds / n[:, None]
            start, stop, heads = spans(data, offsets, NOT_SPACE)
            words = np.diff(heads)
            hashes = word_hashes(data, start, stop)
            runs, _, run_heads = gram_hashes(hashes, heads, 3)
            k = TERMS + len(_KINDS)
            out[:, k] = np.minimum(size / np.maximum(words, 1), 40) / 40
            out[:, k + 1] = _distinct(hashes, heads)
            out[:, k + 2] = _distinct(runs, run_heads)
            out[:, k + 3] = np.log1p(words) / 12
            out[:, k + 4] = words > 0
        yield first, end, out


def _tallies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: how often each bucket of byte trigrams and each kind of byte occurs, counted in pieces of bounded size."""
    rows = len(offsets) - 1
    grams, kinds = np.zeros(rows * TERMS, np.int64), np.zeros((rows, len(_KINDS)), np.int64)
    for low in range(0, len(data), STEP_BYTES):
        high = min(low + STEP_BYTES, len(data))
        wide = data[low : high + 2]  # trigrams that begin in this piece
        row = np.searchsorted(offsets, np.arange(low, low + len(wide)), "right") - 1
        for k, table in enumerate(_KINDS):
            kinds[:, k] += np.bincount(row[: high - low][table[data[low:high]]], minlength=rows)
        if len(wide) >= 3:
            x = wide.astype(np.uint32)
            code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
            whole = row[:-2] == row[2:]
            bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - TERMS.bit_length() + 1)
            grams += np.bincount(row[:-2][whole] * TERMS + bucket[whole], minlength=rows * TERMS)
    return grams.reshape(rows, TERMS), kinds


def _distinct(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Share of distinct values in each row; 1 for rows without any."""
    out = np.ones(len(heads) - 1)
    for i in range(len(out)):
        own = hashes[heads[i] : heads[i + 1]]
        if len(own):
            out[i] = len(np.unique(own)) / len(own)
    return out


class Model:
    """A latent space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, label: np.ndarray) -> None:
        self.prior = float(label.mean()) if len(label) else 0.5
        self.label = label.astype(np.float32)
        terms, style = x[:, :TERMS], x[:, TERMS:]
        seen = (terms > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        self.mean = style.mean(axis=0) if len(x) else np.zeros(STYLES, np.float32)
        self.scale = np.maximum(style.std(axis=0), 1e-3) if len(x) else np.ones(STYLES, np.float32)
        weighted = self._weighted(x)
        self.axes = _leading_axes(weighted, min(LATENT, *weighted.shape)) if len(x) else np.zeros((WIDTH, 1), np.float32)
        self.vectors = _unit(weighted @ self.axes)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        terms = _unit(x[:, :TERMS] * self.idf)
        style = (x[:, TERMS:] - self.mean) / self.scale
        some = x[:, -1:] > 0
        return np.concatenate([terms, np.where(some, np.clip(style, -4, 4), 0) * (STYLE / np.sqrt(STYLES))], axis=1).astype(np.float32)

    def scores(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Labels of the k labelled vectors of highest cosine, weighted by it; the labels' mean for texts without terms."""
        if not len(self.label):
            return np.full(len(x), self.prior)
        cosine = _unit(self._weighted(x) @ self.axes) @ self.vectors.T
        k = min(k, len(self.label))
        at = _nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, at, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        score = (weight * self.label[at]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where((total > 1e-9) & x.any(axis=1), score, self.prior), 0.0, 1.0)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """By row the k places of the highest values, of equal ones the first; places are in the order of ids."""
    part = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
    above = cosine > part[:, None]
    level = cosine == part[:, None]
    room = k - above.sum(axis=1)
    take = above | (level & (np.cumsum(level, axis=1) <= room[:, None]))
    return np.nonzero(take)[1].reshape(len(cosine), k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading_axes(x: np.ndarray, k: int) -> np.ndarray:
    """Right singular vectors by subspace iteration from a fixed start."""
    q = np.random.Generator(np.random.PCG64(3)).standard_normal((x.shape[1], min(k + 16, min(x.shape)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k].astype(np.float32)


def quality_part(id_col: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from about ``rows`` labelled ids at most, drawn by a hash of the id.

    Their term vectors are made on the cluster; the driver gets a table of fixed width and a row for
    each drawn id. Of several labels of an id the largest counts; of several texts of an id one, chosen by
    its hash, is learned.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    n = known.count()
    limit = int(min(1.0, rows / max(n, 1)) * (1 << 30))
    drawn = known.where(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1 << 30)) < limit)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("__doc") == F.col("__id"))
    texts = texts.groupBy("__id").agg(F.max("__label").alias("__label"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    rows_per_batch(docs.sparkSession)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x in term_vectors(batch.column(2)):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    table = texts.mapInArrow(vectors, "id bigint, label int, x binary").toArrow().sort_by("id")
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).astype(np.float32).reshape(-1, WIDTH)
    return Model(x, table["label"].to_numpy())


def score_column(spark, model: Model, text: Column) -> Column:
    """A column of scores by a model that is broadcast: ``TRAIN_ROWS`` vectors and the latent axes, about 2 MB."""
    rows_per_batch(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        out = np.zeros(len(x))
        for first, end, terms in term_vectors(x):
            for at in range(0, end - first, 512):
                out[first + at : min(first + at + 512, end)] = shared.value.scores(terms[at : at + 512])
        return pa.array(out)

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels of ids whose crc32 mod ``parts`` is ``held`` are never learned
    from; null ids have no label and are scored. Null, empty and blank texts have the learned labels' mean as score;
    without labels that is 0.5. Texts count whole, however long. Of labelled vectors that are equally near
    at the last place, those of smaller ids vote. Extra columns, whatever their names, are
    ignored; repeated rows are each scored; an empty table gives an empty result.
    """
    model = train(docs, labels.where(quality_part(id_col, parts) != held))
    out = F.coalesce(quality_part(id_col, parts) == held, F.lit(False))
    told = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return told.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
