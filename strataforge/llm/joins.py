"""Joins of a small-or-large side by its measured size, and joins on keys that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strataforge.session import staged

#: Rows of a staged side (a key of up to 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 100_000
#: A key is hot if more than one in ``HOT`` rows has it, so there are fewer than ``HOT`` hot keys; parts that its rows are dealt to.
HOT, SALTS = 500, 64


def sized(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` (staged, so that counting it is a read of footers) with a broadcast hint if it has few rows."""
    return hinted(side, side.limit(rows + 1).count(), rows)


def hinted(side: DataFrame, n: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side``, of which ``n`` rows were counted as it was staged, with a broadcast hint if they are few."""
    return F.broadcast(side) if n <= rows else side


def without(docs: DataFrame, bad: DataFrame, on: Column) -> DataFrame:
    """Rows of ``docs`` that match no row of the staged ``bad``."""
    return docs.join(sized(bad), on, "left_anti")


def spread_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, deal: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each ``key``, with the rows of hot keys dealt to ``SALTS`` parts.

    ``counts`` has ``(key, n)``, the number of rows by key. The hot keys are fewer than ``HOT`` whatever
    the size of the table, so they are broadcast; only their rows of ``table`` are repeated. Rows are dealt by ``deal``.
    """
    seen = Observation()
    counts = staged(counts.select(key, "n").observe(seen, F.sum("n").alias("whole"), F.max("n").alias("most")), "key-counts")
    whole, most = (seen.get[k] or 0 for k in ("whole", "most"))
    if most * HOT <= whole:
        return rows.join(table, key, how)
    hot = counts.where(F.col("n") * HOT > F.lit(whole)).select(F.col(key).alias("__hot"))
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    salted = salted.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*deal), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    each = table.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    each = each.withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(each, [key, "__salt"], how).drop("__salt")
