"""Near-duplicate joins on 64-bit codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.scalars import hamming

#: Bits that a band must have for the banded plan: shorter bands match by chance too often.
BAND_BITS = 8
#: Codes of one side of a grid cell.
CELL = 4096
#: Codes that are compared with a whole side at once, and tasks that cells are dealt to.
SLICE, TASKS = 128, 2000


def code_classes(codes: DataFrame, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """``(code, id, n)``: each code once, with its smallest id and its rows. Copies never meet in a join."""
    return codes.groupBy(F.col(code_col).cast("bigint").alias("code")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))


def _keys(most: int, width: int) -> Column | None:
    """Of ``most + 1`` disjoint bands of bits two codes within ``most`` bits share one; None where bands would be too short."""
    bands = most + 1
    if width // bands < BAND_BITS:
        return None
    edges = [width * i // bands for i in range(bands + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("code", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).alias("key")) for i in range(bands)])


def _cell_pairs(most: int, same: bool):
    """Compares the codes of a cell, a slice of one side at a time."""

    def compare(cell: pa.Table) -> pa.Table:
        ids, codes, side = cell.column("id"), cell.column("code").to_numpy().view(np.uint64), cell.column("side").to_numpy()
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # both sides are the same on the diagonal
        own, others = same and bool((side == 2).any()), codes[two]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(one), SLICE):
            apart = np.bitwise_count(codes[one[at : at + SLICE], None] ^ others[None, :])
            i, j = np.nonzero(apart <= most)
            if own:
                i, j = i[i + at < j], j[i + at < j]
            found.append((one[i + at], two[j], apart[i, j]))
        a, b, d = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "distance": pa.array(d.astype(np.int32))})

    return compare


def _by_cells(left: DataFrame, right: DataFrame, most: int, same: bool) -> DataFrame:
    """Pairs by a grid of cells whose sides have about ``CELL`` codes: their number grows, not their size. Of one table with itself, half the grid."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    sizes = [max(1, -(-rows.count() // CELL)) for rows in ((left,) if same else (left, right))]
    if same:
        n = sizes[0]
        rows = left.select("id", "code", own(n).alias("own"), spread(n).alias("other"))
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
        cells, number = rows.select("id", "code", side.alias("side"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), n * (n + 1) // 2
    else:
        n, m = sizes
        a = left.select("id", "code", F.lit(0).alias("side"), own(n).alias("i"), spread(m).alias("j"))
        b = right.select("id", "code", F.lit(1).alias("side"), spread(n).alias("i"), own(m).alias("j"))
        cells, number = a.union(b), n * m
    kind = dict(left.dtypes)["id"]
    # cells have few bytes and much work: they are dealt by number, or they would be put together in a few tasks
    dealt = cells.repartition(min(number, TASKS), "i", "j").groupBy("i", "j")
    pairs = dealt.applyInArrow(_cell_pairs(most, same), f"a {kind}, b {kind}, distance int")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance") if same else pairs


def _joined(left: DataFrame, right: DataFrame, most: int, width: int, same: bool) -> DataFrame:
    """Pairs ``(a, b, distance)`` of two tables of distinct codes ``(id, code)``; distances are verified within the join."""
    keys = _keys(most, width)
    if keys is None:
        return _by_cells(left, right, most, same)
    parts = [rows.select("id", "code", F.explode(keys).alias("k")).select("id", "code", "k.*") for rows in (left, right)]
    a = parts[0].select("band", "key", F.col("id").alias("a"), F.col("code").alias("code_a"))
    b = parts[1].select("band", "key", F.col("id").alias("b"), F.col("code").alias("code_b"))
    near = hamming(F.col("code_a"), F.col("code_b"))
    return a.join(b, ["band", "key"]).where((near <= most) & ((F.col("a") < F.col("b")) if same else F.lit(True))).select("a", "b", near.alias("distance")).distinct()


def near_class_pairs(codes: DataFrame, most: int, id_col: str = "id", code_col: str = "code", width: int = 64) -> DataFrame:
    """Pairs ``(a, b, distance)`` of distinct codes at Hamming distance ``most`` or less, by their smallest ids, a < b.

    Rows of one code are its class (``code_classes``), not pairs. Codes are joined by bands of their bits; for a radius
    with too short bands, cells of a grid are compared.
    """
    rows = code_classes(codes, id_col, code_col).select("id", "code")
    return _joined(rows, rows, most, width, same=True)


def near_pairs(codes: DataFrame, most: int, id_col: str = "id", code_col: str = "code", width: int = 64) -> DataFrame:
    """Pairs ``(a, b, distance)`` of rows, a < b, at Hamming distance ``most`` or less, copies among them.

    The pairs of classes written out by row: as many as the copies of a code squared. Where copies are many, take
    ``near_class_pairs`` and ``code_classes``, which hold the same.
    """
    rows = codes.select(F.col(id_col).alias("id"), F.col(code_col).cast("bigint").alias("code"))
    first = rows.join(code_classes(rows).select("code", F.col("id").alias("class")), "code").select("id", "class")
    one, two = first.select(F.col("id").alias("x"), F.col("class").alias("a")), first.select(F.col("id").alias("y"), F.col("class").alias("b"))
    across = near_class_pairs(rows, most, width=width).join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    within = one.join(two.withColumnRenamed("b", "a"), "a").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("distance"))
    return across.unionByName(within)


def near_between(left: DataFrame, right: DataFrame, most: int, width: int = 64) -> DataFrame:
    """Pairs of the distinct codes (by their smallest ids) of two tables ``(id, code)`` at distance ``most`` or less, by bands or cells as above."""
    a, b = code_classes(left).select("id", "code"), code_classes(right).select("id", "code")
    return _joined(a, b, most, width, same=False)
