"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strataforge.session import staged


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written to the shared folder, and their digest, observed as they are written."""
    seen = Observation()
    digest = (F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as bigint))").alias("s"))
    now = staged(edges.observe(seen, *digest), "edges")
    return now, tuple(seen.get[k] for k in ("n", "x", "s"))


def _two(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Edges ``(u, v)``: of each row one for each pair of columns. A union would have all that makes ``rows`` in the plan twice."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels every node of ``edges(u, v)`` with the smallest node it reaches.

    Alternating large-star and small-star rounds: each is two aggregations
    over the edges, both combined before the shuffle, and the number of
    rounds grows with the logarithm of the longest path. The edge table is
    written to the shared folder after each round. Self loops and repeated
    edges are allowed; rows with a null end are dropped. Returns
    ``(node, component)``; nodes without edges to others are not listed
    unless a self loop names them.
    """
    clean = edges.select("u", "v").where("u is not null and v is not null")
    loops = clean.where("u = v").select(F.col("u").alias("node")).distinct()
    now, mark = _round(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = _two(now, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points from a node to a smaller one
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small_low, "u")
        following = _two(star, ("v", "m"), ("u", "m"))
        before = mark
        now, mark = _round(following.where("u <> v").distinct())
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.union(roots).union(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
