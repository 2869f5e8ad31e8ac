"""Operator 13: exact duplicates by a content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.arrow_text import rows_per_batch
from strataforge.llm.joins import sized
from strataforge.session import staged

#: Leading characters of a text that splitters and sort keys hold; what follows them is ordered by its digest, so that a sampled key stays small however long the text is.
HEAD = 32
#: Texts and bytes that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""

    @F.arrow_udf("string")
    def low(x: pa.Array) -> pa.Array:
        return pc.ascii_lower(x)

    return low(text)


class _Runs:
    """Neighbouring equal texts of one sorted partition, closed as soon as another text follows."""

    def __init__(self, part: int, id_type: pa.DataType) -> None:
        self.part, self.id_type, self.closed = part, id_type, 0
        self.last, self.sha, self.ids = None, None, []

    def take(self, ids: pa.Array, sha: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        if self.last is None:  # the partition's first run may go on from the range before: it is open too
            self.last, self.sha = text[0].as_py(), sha[0].as_py()
        same = np.zeros(n, bool)
        same[0] = text[0].as_py() == self.last
        if n > 1:
            same[1:] = pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        head = int(starts[0]) if len(starts) else n
        if head:
            self.ids.append(ids.slice(0, head))
        if not len(starts):
            return
        yield from self.close(edge=0 if self.closed == 0 else None)
        tail = int(starts[-1])
        if tail > head:  # runs that begin and end in this batch
            begin = starts[:-1]
            size = np.diff(starts)
            yield self._rows(ids.slice(head, tail - head), sha.slice(head, tail - head), ids.take(pa.array(np.repeat(begin, size))), np.repeat(size, size), ~same[head:tail], None, None)
            self.closed += len(begin)
        self.last, self.sha, self.ids = text[tail].as_py(), sha[tail].as_py(), [ids.slice(tail)]

    def close(self, edge: int | None) -> Iterator[pa.RecordBatch]:
        """The open run; its ids are held till here, which are no more than the partition's."""
        if not self.ids:
            return
        ids = pa.concat_arrays(self.ids)
        n = len(ids)
        first = np.zeros(n, bool)
        first[0] = True
        text = None if edge is None else self.last
        yield self._rows(ids, pa.repeat(pa.scalar(self.sha, pa.string()), n), pa.repeat(ids[0], n), np.full(n, n), first, None if edge is None else 2 * self.part + edge, text)
        self.ids = []
        self.closed += 1

    def _rows(self, ids, sha, keep, size, first, edge, text) -> pa.RecordBatch:
        n = len(ids)
        texts = pa.array([text, *[None] * (n - 1)] if text is not None else [None] * n, pa.string())
        columns = [ids, sha, keep, pa.array(size, pa.int64()), pa.array(first), pa.array([edge] * n, pa.int64()), texts]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_sha256", "keep_id", "group_size", "first", "edge", "edge_text"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``: one row for each row of ``docs``.

    Texts are equal if they are identical after A-Z became lower case; null counts
    as empty. ``keep_id`` is the largest id among equal texts, null only if all
    of their ids are null; exactly one row of them is ``kept``, also where rows repeat an id. Extra columns, whatever
    their names, are ignored; an empty table gives an empty result.

    Rows are dealt into ranges of (leading characters, digest, id from the largest, place in the input) by Spark's sampled
    splitters and sorted within them, externally where a range is larger than memory. Equal texts
    stand side by side then, and neighbours are compared in full. As ids and places
    are part of the order, the copies of one text may fill many ranges. Only
    a range's first and last text can go on in another range: these few, two a range, are grouped by their whole
    text, and their sizes and largest ids become those of the group. ``docs`` should come from files or a staged
    table, so that a row keeps its place if a task is run again.
    """
    rows_per_batch(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    rows = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("sha"), F.substring("text", 1, HEAD).alias("head"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("head"), F.col("sha"), F.col("doc_id").desc_nulls_last(), F.col("place")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "sha", "text")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = None
        for b in batches:
            if b.num_rows:
                runs = runs or _Runs(TaskContext.get().partitionId(), b.column(0).type)
                yield from runs.take(b.column(0), b.column(1), b.column(2))
        if runs is not None:
            yield from runs.close(edge=1)

    kind = ranges.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_sha256 string, keep_id {kind}, group_size bigint, first boolean, edge bigint, edge_text string"
    found = staged(ranges.mapInArrow(neighbours, schema), "runs")
    edges = found.where("edge_text is not null").select("edge", "edge_text", "keep_id", "group_size")
    whole = edges.groupBy("edge_text").agg(F.max("keep_id").alias("k"), F.sum("group_size").alias("n"), F.min("edge").alias("first_edge"))
    solved = sized(staged(edges.select("edge", "edge_text").join(whole, "edge_text").select("edge", "k", "n", "first_edge"), "edges"))
    inner = found.where("edge is null").select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")
    outer = found.where("edge is not null").join(solved, "edge")
    outer = outer.select("doc_id", F.col("k").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first") & (F.col("edge") == F.col("first_edge"))).alias("kept"), "text_sha256")
    return inner.union(outer)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id; all columns are kept.

    Of rows that repeat the kept id and text any one stays. An empty table gives an empty result.
    """
    found = staged(exact_duplicates(docs), "exact")
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__set", F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256))
    out = own.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__set") == F.col("__sha")), "left_semi")
    repeats = found.where("not kept and doc_id <=> keep_id").limit(1).count() > 0
    return (out.dropDuplicates(["doc_id", "__set"]) if repeats else out).drop("__set")
