"""Unions, distinct rows and sorts that keep an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_in_order(parts: list[DataFrame], place: str = "source_no") -> DataFrame:
    """Rows of all parts by name, with the number of their part from 0; a column that a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn(place, F.lit(k)) for k, p in enumerate(parts)])


def distinct_in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``(keys, order)`` of the first row of each key: an aggregation that combines before its shuffle."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__o")).select(*keys, *[F.col(f"__o.{c}").alias(c) for c in order])


def results_order() -> list[Column]:
    """The order in which results are shown: aggregates, which have no seed, before seeds."""
    keys = ("test_manifest", "train_manifest", "backbone_id", "res", "token_type", "head", "coverage", "metric")
    return [*[F.col(k).asc() for k in keys], F.col("seed").asc_nulls_first()]


def by_code_point(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by the code points of strings, which is the order of their UTF-8 bytes."""
    return rows.orderBy(*[F.col(k).asc_nulls_first() for k in keys])


def shown(rows: DataFrame, by: list[str], item: str, most: int) -> DataFrame:
    """By group the number of rows, the first ``most`` distinct items in order, joined, and how many more distinct ones there are.

    Only ``most`` items of a group are ever gathered: each task sends its own first ones.
    """
    top = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.select(*by, item).distinct()
    w = _first(firsts, by, item, most).join(firsts.groupBy(*by).agg(F.count(item).alias("items")), by)
    return top.join(w, by).select(*by, "n", "shown", F.greatest(F.col("items") - most, F.lit(0)).alias("more"))


def _first(rows: DataFrame, by: list[str], item: str, most: int) -> DataFrame:
    from pyspark.sql.window import Window

    # Spark limits each partition to the first rows of a group before its shuffle, since only low ranks are asked for
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(item))).where(F.col("__r") <= most)
    pairs = F.array_sort(F.collect_list(F.struct("__r", item)))
    return ranked.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x[item].cast("string")), ", ").alias("shown"))
