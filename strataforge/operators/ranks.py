"""Row numbers, running sums and order statistics without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.session import staged


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``rows`` with the sums of what stands before each row in its group, 0 at the first.

    Rows are put in ranges of (group, order); sums of whole ranges, a row for each range and
    group, give the offsets, and windows stay within a range. Rows that are equal in ``order`` come
    in any order. Groups compare null-safely.
    """
    by = by or []
    placed = rows.withColumns({f"__x_{k}": c for k, c in sums.items()})
    placed = staged(placed.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__part", F.spark_partition_id()), "ranges")
    whole = placed.groupBy("__part", *by).agg(*[F.sum(f"__x_{k}").alias(f"__s_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = whole.select(F.col("__part").alias("__p"), *[F.col(b).alias(f"__b_{b}") for b in by], *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    within = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({k: F.coalesce(F.sum(f"__x_{k}").over(within), F.lit(0)) for k in sums})
    on = F.col("__part") == F.col("__p")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    out = own.join(start, on).withColumns({k: F.col(k) + F.col(f"__o_{k}") for k in sums})
    return out.select(*rows.columns, *sums)


def numbered(rows: DataFrame, order: list[Column], name: str = "row_no", by: list[str] | None = None) -> DataFrame:
    """``rows`` numbered from 1 by ``order``, which should settle ties, in each group."""
    return running(rows, order, {name: F.lit(1).cast("bigint")}, by).withColumn(name, F.col(name) + 1)


def order_statistics(rows: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, ``(by, n, *points)``; nulls are not counted.

    Values are counted first, so equal ones cost one row; the two values that enclose a
    point are found by their running counts.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(counts, [F.col("__v")], {"__below": F.col("__c")}, by)
    totals = counts.groupBy(*[F.col(b).alias(f"__t_{b}") for b in by]).agg(F.sum("__c").alias("n"))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__t_{b}"))
    ranked = ranked.join(totals, on) if by else ranked.crossJoin(F.broadcast(totals))  # one row of totals
    found = []
    for k, p in points.items():
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda at: (F.col("__below") <= at) & (at < F.col("__below") + F.col("__c"))
        a, b = F.max(F.when(holds(low), F.col("__v"))), F.max(F.when(holds(high), F.col("__v")))
        share = F.max(place - low)
        found.append((a + (b - a) * share).alias(k))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *found)
