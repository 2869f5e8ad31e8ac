"""Exact duplicates, class maps and feature joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Paths of one digest that may be gathered in an array; more are rows only.
PATHS = 10_000
#: Rows of a class map that may be broadcast.
MAP_ROWS = 100_000


def dedupe(rows: DataFrame, digest: str, order: list[str], path: str, label: str) -> DataFrame:
    """One row for each digest: the first by ``order``, the other paths sorted, and whether all labels agree.

    An aggregation that combines before its shuffle: the whole row is not moved, only what is asked for.
    ``dup_paths`` is null for digests of more than ``PATHS`` rows, of which ``duplicate_paths`` has a row each.
    """
    first = F.min(F.struct(*order, path)).alias("first")
    heads = rows.groupBy(digest).agg(first, F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("n_labels"), F.min(label).alias("label"))
    heads = heads.select(digest, F.col(f"first.{path}").alias(path), "n", "label", (F.col("n_labels") > 1).alias("conflict"))
    some = heads.where((F.col("n") > 1) & (F.col("n") <= PATHS)).select(digest, F.col(path).alias("__first"))
    others = rows.select(digest, path).join(some, digest).where(F.col(path) != F.col("__first"))
    gathered = others.groupBy(digest).agg(F.array_sort(F.collect_list(path)).alias("dup_paths"))
    none = F.when(F.col("n") <= PATHS, F.array().cast("array<string>"))
    return heads.join(gathered, digest, "left").select(digest, path, F.coalesce("dup_paths", none).alias("dup_paths"), "label", "conflict")


def duplicate_paths(rows: DataFrame, digest: str, order: list[str], path: str) -> DataFrame:
    """``(digest, path)`` of all rows but the first of each digest, as rows: no group is gathered."""
    first = rows.groupBy(digest).agg(F.min(F.struct(*order, path))[path].alias("__first"))
    return rows.select(digest, path).join(first, digest).where(F.col(path) != F.col("__first")).select(digest, path)


def map_classes(rows: DataFrame, class_map: DataFrame, raw: str, to: str) -> DataFrame:
    """Left look-up in a class map; null where a label is unmapped."""
    small = class_map.select(F.col(raw).alias("__raw"), to)
    small = F.broadcast(small) if small.limit(MAP_ROWS + 1).count() <= MAP_ROWS else small
    return rows.join(small, F.col(raw) == F.col("__raw"), "left").drop("__raw")


def unmatched(rows: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(other, key, "left_anti")


def audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, state)``: ``missing`` for keys of ``left`` alone, ``unbacked`` for keys of ``right`` alone."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "missing").otherwise("unbacked").alias("state"))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def append_new(table: DataFrame, rows: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """Rows whose identity is in neither ``table`` nor an earlier row; identities compare null-safely."""
    new = first_by(rows, identity, order)
    known = table.select(*[F.col(k).alias(f"__{k}") for k in identity]).distinct()
    on = None
    for k in identity:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = one if on is None else on & one
    return new.join(known, on, "left_anti")


def mismatched(scan: DataFrame, sums: DataFrame, key: str, digest: str) -> DataFrame:
    """Scanned files whose digest differs from a listed one."""
    listed = sums.select(key, F.col(digest).alias("expected"))
    return scan.join(listed, key, "left").where(F.col("expected").isNotNull() & (F.col("expected") != F.col(digest)))


def member_overlap(rows: DataFrame, member: str, digest: str) -> DataFrame:
    """Distinct digests that each pair of members shares (A03). Digest groups hold members, not rows, so copies don't multiply."""
    held = rows.select(F.col(member).alias("a"), digest).distinct()
    by = held.groupBy(digest).agg(F.sort_array(F.collect_set("a")).alias("m")).where(F.size("m") > 1)
    # members of one digest are pairs of a sorted set: the number of members is small and fixed by the recipe
    pairs = by.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
