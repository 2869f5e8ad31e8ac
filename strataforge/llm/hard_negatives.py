"""Operator 12: hard negatives by products in an orthogonal PCA rotation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.llm.topk import integer_matrix, largest_component
from strataforge.session import staged

#: Anchors of one round (their vectors are broadcast, 8 bytes a component), rows of a block, products of one dense array.
ANCHORS, BLOCK, CELLS = 8192, 2048, 1 << 21
#: Pairs that are verified at once, shares of the components after which products are bounded again.
PAIRS, STAGES = 1 << 15, (0.25, 0.5, 0.75)
#: Scores are compared as 20 x negative <= 19 x positive in 64 bits.
LIMIT = 1 << 58


def second_moments(table: DataFrame, width: int) -> np.ndarray:
    """The sum of outer products of all rows, ``width`` x ``width``: each task sends one matrix by its rows, Spark adds them up."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                _, x = integer_matrix(b.column(0).slice(at, BLOCK), width)
                total += x.astype(np.float64).T @ x.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = table.select("v").mapInArrow(outer, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    out = np.zeros((width, width))
    for i, j, x in parts.groupBy("i", "j").agg(F.sum("x")).toArrow().to_pandas().itertuples(index=False):
        out[i, j] = x
    return out


class Rotation:
    """An orthogonal turn into principal axes, largest first, with bounds for products of which only leading components are known."""

    def __init__(self, moments: np.ndarray) -> None:
        scale = max(float(np.abs(moments).max(initial=0.0)), 1.0)
        _, axes = np.linalg.eigh((moments + moments.T) / (2 * scale))
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        width = len(axes)
        self.cuts = sorted({max(1, min(width, round(width * s))) for s in STAGES}) if width > 1 else [1]
        #: Rounding of the turned products, the norms and the axes' own departure from orthogonality, per unit of both norms.
        self.unit = 64 * (width + 1) * np.finfo(np.float64).eps

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Components along the axes, the norm of what follows each cut, and the norm of the whole."""
        y = x.astype(np.float64) @ self.axes
        rest = np.stack([np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in self.cuts], axis=1) if len(y) else np.zeros((0, len(self.cuts)))
        return y, rest, np.sqrt((y**2).sum(axis=1))


def _survivors(rotation: Rotation, a: tuple, x: tuple, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (anchor, row) of the allowed pairs whose product may lie from ``low`` to ``high`` of the anchor.

    The products of the components up to a cut, plus or minus the product of the norms of the rest and the slack
    for rounding, enclose the whole product; pairs whose range misses the anchor's are dropped at each cut.
    """
    (ay, arest, anorm), (xy, xrest, xnorm) = a, x
    first = rotation.cuts[0]
    partial = ay[:, :first] @ xy[:, :first].T
    room = np.outer(arest[:, 0], xrest[:, 0]) + np.outer(anorm * rotation.unit, xnorm)
    i, j = np.nonzero(allowed & (partial + room >= low[:, None]) & (partial - room <= high[:, None]))
    partial = partial[i, j]
    for k in range(1, len(rotation.cuts)):
        b, c = rotation.cuts[k - 1], rotation.cuts[k]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), PAIRS):
            s = slice(at, at + PAIRS)
            partial[s] += np.einsum("ij,ij->i", ay[i[s], b:c], xy[j[s], b:c])
            room = arest[i[s], k] * xrest[j[s], k] + anorm[i[s]] * xnorm[j[s]] * rotation.unit
            keep[s] = (partial[s] + room >= low[i[s]]) & (partial[s] - room <= high[i[s]])
        i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def _products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products of pairs of whole-number vectors."""
    parts = [np.einsum("ij,ij->i", a[i[at : at + PAIRS]], x[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


class _Best:
    """The ``k`` highest scores of each key, ties to the smaller id."""

    def __init__(self, keys: int, k: int) -> None:
        self.k = k
        self.key, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(keys, np.iinfo(np.int64).min)

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(key):
            return
        key, ids, score = np.concatenate([self.key, key]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[key[full]] = score[full]
        self.key, self.id, self.score = key[keep], ids[keep], score[keep]

    def send(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if len(self.key):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.key, self.id, self.score)], names=names)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, anchors: int, wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and whole-number components, in blocks that are smaller the more anchors there are."""
    size = max(16, min(BLOCK, CELLS // max(anchors, 1)))
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            ok, x = integer_matrix(part.column(2), width, wide)
            if len(ok):
                yield part.column(0).to_numpy(zero_copy_only=False)[ok].astype(np.int64), part.column(1).to_numpy(zero_copy_only=False)[ok].astype(np.int64), x


def hard_negatives(rows: DataFrame, anchor_by: int = 50, shift_by: int = 7, positives: int = 5, negatives: int = 3, chunk: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``rows(vec_id, embedding, label)``.

    Components are floor(256 x) and scores their inner products, exact whole numbers. Anchors are the rows whose id ``anchor_by`` divides;
    their positives are the best ``positives`` rows of the same label, ties to the smaller id. For each positive the best
    ``negatives`` rows of other labels with 50 x positive <= 100 x negative <= 95 x positive are
    returned; none are where the positive's score is below 0. Where ``shift_by`` divides the id, the label first
    becomes (label + 1) % 10.

    Rows with a null id, label or vector, or a null or non-finite component take no part; a shorter vector counts as padded with zeros, an empty one
    as all zeros. Rows with the anchor's own id are not among its others. Equal anchor rows are one anchor; rows that repeat an id otherwise
    count one by one. Extra columns are ignored; an empty table gives an empty result. Where products could pass 2^58 (``LIMIT``), a
    ``ValueError`` says so before any work.

    1. Spark adds up the second moments of all rows; their eigenvectors, a matrix of the vectors' width, are the rotation.
    2. For each chunk of anchors, tasks compare their rows with the broadcast anchors: products of the leading
       rotated components, then of more, with bounds for the rest, drop pairs that cannot be among
       the best; whole-number products verify the others. A task sends ``positives`` rows for each anchor at most.
    3. So again for negatives, where the positives' scores bound the range from both sides.

    Work is anchors times rows, as the set of anchors asks; what is shuffled is a few rows for each anchor and task.
    """
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % shift_by == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    table = rows.where("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), F.col("embedding").cast(kind).alias("v")).where(usable)
    largest, width = largest_component(table)
    if largest * largest * max(width, 1) >= LIMIT:
        raise ValueError(f"components of up to {largest} in {width} dimensions: products may pass {LIMIT}")
    wide = largest * largest * max(width, 1) >= 1 << 53
    width = max(width, 1)
    asked = staged(table.where(F.col("vec_id") % anchor_by == 0).select("vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v")).distinct(), "anchors")
    n = asked.count()
    rotation = Rotation(second_moments(table, width))
    parts = max(1, -(-n // chunk))
    out = None
    for c in range(parts):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(parts)) == c).toArrow()
        one = _chunk(table, rotation, own, width, wide, positives, negatives)
        out = one if out is None else out.unionByName(one)
    return out


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chunk(table: DataFrame, rotation: Rotation, own: pa.Table, width: int, wide: bool, positives: int, negatives: int) -> DataFrame:
    sc = table.sparkSession.sparkContext
    vectors = own["v"].combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.int64()))
    a = np.zeros((len(vectors), width), np.int64 if wide else np.float64)
    for i, v in enumerate(vectors.to_pylist()):
        a[i, : len(v)] = v
    aid, alabel = own["vec_id"].to_numpy().astype(np.int64), own["label"].to_numpy().astype(np.int64)
    shared = sc.broadcast((rotation, aid, alabel, a, rotation.turned(a)))
    names = ["anchor", "vec_id", "score"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, aid, alabel, a, turned = shared.value
        best = _Best(len(aid), positives)
        never = np.full(len(aid), np.inf)
        for ids, labels, x in _blocks(batches, width, len(aid), wide):
            allowed = (alabel[:, None] == labels) & (aid[:, None] != ids)
            i, j = _survivors(rotation, turned, rotation.turned(x), best.least, never, allowed)
            best.add(i, ids[j], _products(a, x, i, j))
        yield from best.send(names)

    near = _top(table.mapInArrow(nearest, "anchor bigint, vec_id bigint, score bigint"), ["anchor"], positives)
    near = staged(near.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    held = near.where("positive_score >= 0").toArrow().to_pandas()  # at most ``positives`` rows for each anchor of the chunk
    score = np.full((len(aid), positives), -1, np.int64)
    score[held["anchor"], held["place"] - 1] = held["positive_score"]
    ranges = sc.broadcast(score)

    def harder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, aid, alabel, a, turned = shared.value
        score = ranges.value
        use = score >= 0
        high = np.where(use, np.floor(score * 19 / 20) + 1, -np.inf).max(axis=1, initial=-np.inf)
        best = _Best(score.size, negatives)
        for ids, labels, x in _blocks(batches, width, len(aid), wide):
            # a key is an anchor and one of its positives
            low = np.where(use, np.maximum(score / 2 - 1, best.least.reshape(score.shape)), np.inf).min(axis=1, initial=np.inf)
            allowed = (alabel[:, None] != labels) & (aid[:, None] != ids)
            i, j = _survivors(rotation, turned, rotation.turned(x), low, high, allowed)
            s = _products(a, x, i, j)
            for p in range(score.shape[1]):
                at = score[i, p]
                fit = (at >= 0) & (at <= 2 * s) & (20 * s <= 19 * at) & (s >= best.least[i * score.shape[1] + p])
                best.add(i[fit] * score.shape[1] + p, ids[j[fit]], s[fit])
        yield from best.send(["key", "vec_id", "score"])

    hard = table.mapInArrow(harder, "key bigint, vec_id bigint, score bigint")
    hard = hard.select(F.expr(f"key div {positives}").alias("anchor"), (F.col("key") % positives + 1).cast("int").alias("place"), "vec_id", "score")
    hard = _top(hard, ["anchor", "place"], negatives).select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = table.sparkSession.createDataFrame(pa.table({"anchor": pa.array(range(len(aid)), pa.int64()), "anchor_id": pa.array(aid)}))
    out = hard.join(F.broadcast(near), ["anchor", "place"]).join(F.broadcast(named), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
