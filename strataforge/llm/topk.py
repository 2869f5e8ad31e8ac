"""Operator 8: exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.session import staged

#: Queries of one round (their vectors, about 512 bytes each at 64 components, are broadcast), rows of a block at most, segments of a vector.
QUERIES, BLOCK, SEGMENTS = 8192, 2048, 2
#: Numbers of one array of scores (queries times rows of a block), 8 bytes each.
CELLS = 1 << 21
#: Bound of scores: differences of two of them fit 64 bits too.
LIMIT = 1 << 62


def integer_matrix(vectors: pa.Array, width: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors, and their components floor(256 x) padded to ``width``: doubles, or 64-bit integers if ``wide``."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    x = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # nulls are NaN
    if not valid.all() or len(lengths) == 0 or (lengths != width).any():
        row = np.repeat(np.arange(len(lengths)), lengths)
        column = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        valid = valid & (np.bincount(row[~np.isfinite(x)], minlength=len(lengths)) == 0)
        out = np.zeros((len(lengths), width))
        at = column < width
        out[row[at], column[at]] = x[at]
    else:
        out = x.reshape(-1, width)
        valid = np.isfinite(out).all(axis=1)
    ok = np.flatnonzero(valid)
    return ok, out[ok].astype(np.int64) if wide else out[ok]


def largest_component(table: DataFrame, vector: str = "v") -> tuple[int, int]:
    """A bound of the absolute whole-number components of the usable vectors, and their largest width."""
    largest, width = table.agg(F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))), F.max(F.size(vector))).first()
    return int(Fraction(largest or 0.0) * 256) + 1, int(width or 0)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, queries: int, wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer components of usable rows, in blocks that are smaller the more queries there are."""
    size = max(16, min(BLOCK, CELLS // max(queries, 1)))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            ok, x = integer_matrix(part.column(1), width, wide)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            if len(ok):
                yield ids[ok].astype(np.int64), x


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest of a list of scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _merge(held: list, q: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    if held[q] is not None:
        ids, scores = np.concatenate([held[q][0], ids]), np.concatenate([held[q][1], scores])
    at = _best(scores, ids, k)
    held[q] = ids[at], scores[at]


def _cuts(width: int, segments: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, width, segments + 1).astype(int)
    return list(zip(edges[:-1], edges[1:], strict=True))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", segments: int = SEGMENTS, chunk: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each query with all other rows.

    Components are floor(256 x); scores are whole numbers. Ties go to the
    smaller id; a row with the query's own id is no candidate. Vectors that are null,
    or hold a null or a value that is not finite, and rows with a null id take no part; a shorter vector counts as
    padded with zeros. Products that may pass 2^53 are made in 64-bit integers, and where they may pass ``LIMIT`` a
    ``ValueError`` says so before any work. Query rows with one id and one whole-number vector are one query, with one list; of one id with
    other vectors each has a list. Candidate rows that repeat an id are each a candidate. Extra
    columns are ignored; an empty table gives an empty result. Queries are taken in chunks of
    bounded size, so that only one chunk is broadcast at a time; for each chunk:

    1. The score of a row is the sum of its scores in ``segments`` parts of the
       vector. Each shard (a task's rows) lists the k highest rows by each part, resolves these few in
       full and sends its k best and the least score of each part. The k-th best over all shards
       is a score that the result's last entry reaches at least: the cutoff.
    2. The cutoff, above the sum of least part scores and divided evenly over
       the parts, is broadcast. A row that reaches the cutoff must reach its
       even share in some part, so each shard collects just the rows that do.
    3. What is collected is resolved in full. Of the rows at or above the
       cutoff a shard sends its k best, since no other can be in the result,
       and the lists are merged.

    Work is queries times rows, in dense blocks; what is shuffled is k rows for each shard and query at most.
    """
    # floats stay floats on their way to Python; anything else is taken as doubles
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    table = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).where("vec_id is not null and v is not null").where(usable)
    asked = queries.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    asked = asked.where(usable).select("vec_id", integer_vector(F.col("v")).cast("array<double>").alias("v")).distinct()
    asked = staged(asked, "queries")
    n, width, own = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = max(int(width), 1)
    largest = largest_component(table)[0] * max(int(own or 0), 1) * width
    if largest >= LIMIT:
        raise ValueError(f"scores of up to {largest} do not fit 64 bits")
    wide = largest >= 1 << 53
    parts = max(1, -(-n // chunk))
    out = None
    for c in range(parts):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)) == c).toArrow()
        found = sorted(zip(own["vec_id"].to_pylist(), own["v"].to_pylist(), strict=True))
        q = np.zeros((len(found), width), np.int64 if wide else np.float64)
        for i, (_, v) in enumerate(found):
            q[i, : len(v)] = v
        one = _chunk(table, np.array([i for i, _ in found], np.int64), q, width, k, segments, wide)
        out = one if out is None else out.unionByName(one)
    return out


def _chunk(table: DataFrame, qid: np.ndarray, q: np.ndarray, width: int, k: int, segments: int, wide: bool) -> DataFrame:
    sc = table.sparkSession.sparkContext
    cuts = _cuts(width, segments)
    asked = sc.broadcast((qid, q))
    names = ["part", "query", "vec_id", "score"]

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = asked.value
        held, least = [None] * len(qid), np.full((len(qid), len(cuts)), np.inf)
        for ids, x in _blocks(batches, width, len(qid), wide):
            picked = []
            for s, (a, b) in enumerate(cuts):
                part = q[:, a:b] @ x[:, a:b].T
                least[:, s] = np.minimum(least[:, s], part.min(axis=1))
                m = min(k + 1, len(ids))  # the query's own row may be one of them
                picked.append(np.argpartition(-part, m - 1, axis=1)[:, :m])
            picked = np.concatenate(picked, axis=1)
            for i in range(len(qid)):
                at = np.unique(picked[i])
                at = at[ids[at] != qid[i]]
                _merge(held, i, ids[at], x[at] @ q[i], k)
        yield from _send(held, names)
        if len(qid) and np.isfinite(least).any():
            row, s = np.nonzero(np.isfinite(least))
            yield pa.RecordBatch.from_arrays([pa.array(s + 1, pa.int32()), pa.array(row), pa.array(np.zeros(len(row), np.int64)), pa.array(least[row, s].astype(np.int64))], names=names)

    schema = "part int, query bigint, vec_id bigint, score bigint"
    lists = staged(table.mapInArrow(local_lists, schema), "lists")
    ranked = lists.where("part = 0").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    kth = {r[0]: r[1] for r in ranked.where(F.col("r") == k).select("query", "score").collect()}  # one number for each query of the chunk
    low = {(r[0], r[1]): r[2] for r in lists.where("part > 0").groupBy("query", "part").agg(F.min("score")).collect()}
    cutoff = np.array([kth.get(i, np.iinfo(np.int64).min) for i in range(len(qid))], np.int64)
    base = np.array([[low.get((i, s + 1), 0) for s in range(len(cuts))] for i in range(len(qid))], np.float64).reshape(len(qid), len(cuts))
    # a share may not be too high by rounding
    slack = 8 * np.finfo(np.float64).eps * (np.abs(cutoff.astype(np.float64)) + np.abs(base).sum(axis=1))
    even = sc.broadcast((cutoff, base + ((cutoff - base.sum(axis=1)) / len(cuts) - slack)[:, None]))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = asked.value
        cutoff, share = even.value
        held = [None] * len(qid)
        for ids, x in _blocks(batches, width, len(qid), wide):
            enough = np.zeros((len(qid), len(ids)), bool)
            for s, (a, b) in enumerate(cuts):
                enough |= q[:, a:b] @ x[:, a:b].T >= share[:, s : s + 1]
            for i in np.flatnonzero(enough.any(axis=1)):
                at = np.flatnonzero(enough[i] & (ids != qid[i]))
                scores = x[at] @ q[i]
                keep = scores >= cutoff[i]
                if keep.any():
                    _merge(held, i, ids[at[keep]], scores[keep], k)
        yield from _send(held, names)

    best = table.mapInArrow(resolve, schema)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    names_of = table.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(qid)], "query bigint, query_id bigint")
    return ranked.where(F.col("rank") <= k).join(F.broadcast(names_of), "query").select("query_id", "rank", "vec_id", "score")


def _send(held: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    some = [i for i, h in enumerate(held) if h is not None and len(h[0])]
    if some:
        n = [len(held[i][0]) for i in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(sum(n), np.int32)), pa.array(np.repeat(np.array(some, np.int64), n)), pa.array(np.concatenate([held[i][0] for i in some])), pa.array(np.concatenate([held[i][1] for i in some]).astype(np.int64))],
            names=names,
        )


def divisible(rows: DataFrame, by: int, id_col: str = "vec_id") -> DataFrame:
    return rows.where(F.col(id_col) % by == 0)


def integer_vector(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
