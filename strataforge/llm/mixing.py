"""Operator 5: mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators.ranks import numbered
from strataforge.session import staged

#: Documents that one leaf of the reduction tree takes in order, and leaves that one inner node combines.
LEAF, FAN = 4096, 256
#: Sources whose targets may be broadcast.
SOURCES = 100_000


def word_count(text):
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, have the weights in turn. They share
    ``share`` (a fraction) of the sum of sizes by weight; a target stops at
    ``most`` times its source's size, and the excess is shared anew among the
    others until none is above. Sources without words have target 0.

    Sources are numbered by ranges; the rounds are sums over their table.
    """
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    now = numbered(sizes, [F.col("source").asc_nulls_last()], "place").withColumn("turn", turn).drop("place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("turn") + 1).cast("bigint")
    now = staged(now.withColumn("weight", weight).withColumn("capped", F.lit(False)), "weights")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        free, fixed = now.agg(
            F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))), F.lit(0)),
        ).first()
        rest = share[0] * total - share[1] * most * fixed  # in units of 1 / share[1]
        # whole numbers of any size, compared in Python: rest * weight > share * most * free * size
        each = share[1] * most * free
        bounds = [min((rest * w - 1) // each, (1 << 63) - 1) if each else -1 for w in weights]
        above = F.col("source_size") <= F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.col("turn") + 1)
        if free == 0 or now.where(~F.col("capped") & above).limit(1).count() == 0:
            break
        now = staged(now.withColumn("capped", F.col("capped") | above), "weights")
    level = F.lit(float(rest)) * F.col("weight") / F.lit(float(share[1] * max(free, 1)))
    return now.select("source", "source_size", F.when(F.col("capped"), F.col("source_size") * float(most)).otherwise(level).cast("double").alias("target"))


def _draws(key: str, n: int) -> np.ndarray:
    """Uniform numbers that depend on the node's name only, so that reruns agree."""
    seed = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little")
    return np.random.Generator(np.random.PCG64(seed)).random(n)


def pivot(size: np.ndarray, p: np.ndarray, draws: np.ndarray, lots: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Pairs fractional probabilities until at most one is left; gives the values and its position, or -1.

    Of two fractional documents, words move from one to the other until one
    of the two is integral: size[i] * p[i] + size[j] * p[j] stays, and the
    direction is drawn so that both expectations stay. Of a large and a small document it is the small one that
    becomes integral, so a large one would wait to the end. With ``lots``, and documents from the largest, one that
    waits is drawn alone as soon as the next is less than half its size, and the words that this
    gives or takes are spread evenly over the probabilities of all that follow: the sum of words stays, and so do expectations. It waits on
    where a probability would pass 0 or 1.
    """
    x, left, shift = p.copy(), -1, 0.0
    if lots is not None and len(x):
        rest = np.cumsum(size[::-1])[::-1]
        least, most = np.minimum.accumulate(p[::-1])[::-1], np.maximum.accumulate(p[::-1])[::-1]
    for j in range(len(x)):
        if left >= 0 and lots is not None and 2 * size[j] < size[left]:
            give, take = (1 - x[left]) * size[left] / rest[j], x[left] * size[left] / rest[j]
            if least[j] + shift - give > 0 and most[j] + shift + take < 1:
                up = lots[left] < x[left]
                shift += -give if up else take
                x[left], left = float(up), -1
        x[j] += shift
        if not 0 < x[j] < 1:
            continue
        if left < 0:
            left = j
            continue
        a, b = float(size[left]), float(size[j])
        up = min((1 - x[left]) * a, x[j] * b)  # words to the one that waits
        down = min(x[left] * a, (1 - x[j]) * b)
        move = up if draws[j] * (up + down) < down else -down
        first, second = x[left] + move / a, x[j] - move / b
        # the binding end is integral exactly
        if move > 0:
            if (1 - x[left]) * a <= x[j] * b:
                first = 1.0
            if x[j] * b <= (1 - x[left]) * a:
                second = 0.0
        else:
            if x[left] * a <= (1 - x[j]) * b:
                first = 0.0
            if (1 - x[j]) * b <= x[left] * a:
                second = 1.0
        x[left], x[j] = min(max(first, 0.0), 1.0), min(max(second, 0.0), 1.0)
        if not 0 < x[left] < 1:
            left = j if 0 < x[j] < 1 else -1
    return x, left


def _rounder(level: int, last: bool):
    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        return _round(pdf, level, last)

    return node


def _round(pdf: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    # large documents first: what one of them leaves goes on to smaller ones, so what is left at the end is small
    pdf = pdf.sort_values(["size", "draw", "doc", "tie"], ascending=[False, True, True, True], kind="mergesort", na_position="last")
    source, node = pdf["source"].iloc[0], int(pdf["node"].iloc[0])
    draws = _draws(f"{source!r}/{level}/{node}", 2 * len(pdf))
    x, left = pivot(pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), draws[: len(pdf)], draws[len(pdf) :])
    if last and left >= 0:
        x[left] = float(x[left] >= 0.5)  # to the nearer, so that the source misses its target by least
        left = -1
    return pdf.assign(p=x, open=np.arange(len(pdf)) == left)


def round_copies(shares: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Whole numbers of copies for ``(source, doc, tie, size, rows, ratio)``; one row each, with ``copies`` for ``ratio``. ``rows`` may lack, and is 1 then.

    The whole part of ``ratio`` is taken as it is; the fractions are rounded in a
    tree. A leaf takes about ``leaf`` documents of one source, drawn by hash, and
    leaves one fraction at most; up to ``fan`` leaves meet in the next node,
    until one node of the source is left, whose last fraction goes to the nearer whole number.
    A source's words so differ from their target by half a document at most, and by half of a small one as long as
    there are enough small ones to take what the large ones leave.
    Nodes are named by source, level and a hash of the document, so a rerun draws the same.
    """
    base = F.floor("ratio")
    shares = shares if "rows" in shares.columns else shares.withColumn("rows", F.lit(1).cast("bigint"))
    own = ("source", "doc", "none", "tie", "size", "rows", "base", "p")
    # a null id would make the others of its batch floating-point numbers
    table = shares.select("source", F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("none"), "tie", "size", "rows", base.alias("base"), (F.col("ratio") - base).alias("p"), F.expr("xxhash64(doc, size, tie)").alias("draw"))
    open_rows = (F.col("p") > 0) & (F.col("size") > 0)
    counts = table.where(open_rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    leaves = counts.select("source", F.greatest(F.ceil(F.col("n") / leaf), F.lit(1)).cast("bigint").alias("leaves"))
    leaves = staged(leaves, "leaves")
    most = leaves.agg(F.max("leaves")).first()[0] or 1
    small = F.broadcast(leaves) if leaves.count() <= SOURCES else leaves
    s = small.select(F.col("source").alias("__s"), "leaves")
    todo = table.where(open_rows).join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("node", F.expr("pmod(shiftright(draw, 16), leaves)"))
    todo = todo.drop("leaves")
    closed = [table.where(~open_rows).withColumn("p", F.lit(0.0)).select(*own)]
    schema = "source string, doc bigint, none boolean, tie bigint, size bigint, rows bigint, base bigint, p double, draw bigint, node bigint, open boolean"
    level = 0
    while True:
        last = most <= 1
        done = todo.groupBy("source", "node").applyInPandas(_rounder(level, last), schema)
        done = staged(done, f"rounded{level}")
        closed.append(done.where("not open").select(*own))
        if last:
            break
        todo = done.where("open").drop("open").withColumn("node", F.expr(f"node div {fan}"))
        most = -(-most // fan)
        level += 1
    whole = closed[0]
    for part in closed[1:]:
        whole = whole.unionByName(part)
    return whole.select("source", F.when(~F.col("none"), F.col("doc")).alias("doc"), "tie", "size", "rows", (F.col("base") + F.round("p").cast("bigint")).alias("copies"))


#: Rows of a group of alike rows that one task writes out at once.
ALIKE = 10_000


def mix_groups(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc, source, tie, size, rows, source_size, target, copies)``: one row for each group of alike rows.

    Rows with one id, source and text are alike: they count as one document of ``rows``
    times the expectation, so that they neither meet in one leaf nor are drawn one by one.
    """
    units = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))
    units = staged(units.groupBy("doc", "source", "size", "tie").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    targets = staged(source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share, most), "targets")
    small = F.broadcast(targets) if targets.count() <= SOURCES else targets
    small = small.select(F.col("source").alias("__s"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of = F.col("source").eqNullSafe(F.col("__s"))
    shares = units.join(small, of).withColumn("ratio", F.when(F.col("size") > 0, ratio * F.col("rows")).otherwise(F.lit(0.0)))
    return round_copies(shares).join(small, of).select("doc", "source", "tie", "size", "rows", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every document in a mix: ``(doc_id, source, tie, size, source_size, target, copies)``.

    A document's probability is its source's target over its source's size,
    so at most ``most`` copies of it are taken. Size is the number of words,
    0 for null and empty texts, of which no copy is taken. Null is a source
    of its own, and a null id is an id like others. ``tie`` is a hash of the text: the copies of alike rows (one
    id, source and text) are drawn together and dealt out evenly, the first ones getting one more. An
    empty table gives an empty result; extra columns, whatever their names, are ignored; a text counts whole, however long.
    """
    groups = mix_groups(docs, weights, share, most, id_col, text_col, source_col)
    # a group may be a third of all rows: it is written out in pieces that any task may take
    pieces = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) div {ALIKE}"))))
    some = groups.where(F.col("rows") > ALIKE).limit(1).count() > 0
    pieces = pieces.repartition("doc", "tie", "piece") if some else pieces
    first, last = F.col("piece") * ALIKE, F.least((F.col("piece") + 1) * ALIKE, F.col("rows")) - 1
    each = pieces.withColumn("no", F.explode(F.sequence(first, last)))
    own = F.expr("copies div rows") + (F.col("no") < F.expr("copies % rows")).cast("bigint")
    return each.select(F.col("doc").alias("doc_id"), "source", "tie", "size", "source_size", "target", own.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, numbered from 0.

    The number is in ``copy_no`` or, where ``docs`` has such a column, in ``mix_copy_no``. Alike
    rows (one id, source and text) stand for each other: one of them is taken as often as all together. Null,
    empty and wordless texts are not taken; an empty table gives an empty result; extra columns are kept.
    """
    mix = staged(mix_groups(docs), "mix")
    number = "mix_copy_no" if "copy_no" in [c.lower() for c in docs.columns] else "copy_no"
    taken = mix.where("copies > 0").select(F.col("doc").alias("__doc"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), F.col("copies").alias("__n"))
    same = docs["doc_id"].eqNullSafe(F.col("__doc")) & docs["source"].eqNullSafe(F.col("__source")) & (F.xxhash64(docs["text"]) == F.col("__tie"))
    picked = docs.dropDuplicates(["doc_id", "source", "text"]) if mix.where("rows > 1").limit(1).count() else docs
    out = picked.join(taken, same)
    return out.withColumn(number, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1))).drop("__doc", "__source", "__tie", "__n")
