"""Operator 4: near duplicates by 64-bit SimHash and multi-index hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strataforge.llm.arrow_text import rows_per_batch
from strataforge.llm.joins import hinted, spread_join
from strataforge.llm.shingles import BROADCAST_IDS, set_column, shingle_classes
from strataforge.operators.graph import connected_components
from strataforge.session import counted, staged

SEED = 42
#: Fingerprints that one bucket of the index table may hold; fuller ones are linked by midpoints instead.
BUCKET = 64
#: Shingles that are held at once while a text is hashed.
RUN = 200_000


def _majority(text: bytes, words: int) -> int:
    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    n = max(len(w) - words + 1, 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, RUN):
        part = w[at : min(at + RUN, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def simhash(texts: pa.Array, words: int = 3) -> pa.Array:
    """Signed 64-bit fingerprints; null and wordless texts have 0."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    return pa.array((_majority(x.as_py(), words) for x in texts), pa.int64())


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def fp(x: pa.Array) -> pa.Array:
        return simhash(x, words)

    return fp(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``, one pass without a shuffle."""
    rows_per_batch(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp"))


def hamming_links(codes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(u, v)`` between the distinct 64-bit codes ``fp`` that connect all codes at 2 or fewer differing bits.

    Multi-index hashing with two 32-bit segments. Of two codes at distance 2
    or less, either the upper segments differ in at most one bit or the lower
    segments are equal. So each code looks up the table of upper segments
    with the 33 values of the ball of radius 1 and the table of lower
    segments with its own value, and complete distances are verified.

    A table bucket with more than ``bucket`` codes is not joined, and its codes look
    nothing up. Both ends of any link that this loses lie in such a bucket or look at one; all such codes are linked
    exactly in another way: two codes are within 2 bits if and only if some
    64-bit value is within 1 bit of both, so every such code names its 65
    values and the members of a value (65 at most) are linked to its least.
    """
    low = F.lit((1 << 32) - 1)
    parts = codes.select("fp", F.shiftrightunsigned("fp", 32).alias("s1"), F.col("fp").bitwiseAND(low).alias("s2"))
    struct = lambda seg, key: F.struct(F.lit(seg).alias("seg"), key.alias("key"))
    own = F.array(struct(1, F.col("s1")), struct(2, F.col("s2")))
    ball = F.concat(own, *[F.array(struct(1, F.col("s1").bitwiseXOR(F.lit(1 << i)))) for i in range(32)])
    occupied = parts.select(F.explode(own).alias("b")).select("b.*")
    full, n_full = counted(occupied.groupBy("seg", "key").count().where(F.col("count") > bucket).select("seg", "key"), "full-buckets")
    probes = parts.select(F.col("fp").alias("u"), F.explode(ball).alias("b")).select("u", "b.seg", "b.key")
    table = parts.select("fp", F.explode(own).alias("b")).select(F.col("fp").alias("v"), F.col("b.seg").alias("seg"), F.col("b.key").alias("key"))
    by_middle = None
    if n_full:
        # codes that look at a full bucket go by midpoints; those that lie in one do not look up the others' buckets
        small = hinted(full, n_full)
        by_middle = staged(probes.join(small, ["seg", "key"], "left_semi").select(F.col("u").alias("fp")).distinct(), "middle")
        inside = table.join(small, ["seg", "key"], "left_semi").select(F.col("v").alias("u")).distinct()
        probes = probes.join(hinted(*counted(inside, "inside")), "u", "left_anti")
        table = table.join(small, ["seg", "key"], "left_anti")
    near = probes.join(table, ["seg", "key"]).where("u <> v and bit_count(u ^ v) <= 2").select("u", "v")
    ordered = lambda links: links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if by_middle is None:
        return ordered(near)

    signed = lambda i: (1 << i) - (1 << 64) * (i == 63)
    values = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(i)).cast("bigint")) for i in range(64)])
    middle = by_middle.select("fp", F.explode(values).alias("mid"))
    least = middle.groupBy("mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "v")
    starred = middle.join(least, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return ordered(near.union(starred))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row for each row of ``docs``.

    ``component_id`` is the smallest non-null id reachable over links of 2 or
    fewer bits, null where all of them are null. Copies collapse into one code before
    any link is made. Null, empty and wordless texts share fingerprint 0,
    which links like any other. Texts count whole, however long. Extra columns, whatever their names, are ignored; an empty table
    gives an empty result.
    """
    marked = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    codes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    labels = connected_components(hamming_links(codes.select("fp")))
    named = codes.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = staged(named, "labelled")
    groups = staged(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    # one component, or the copies of one text, may be a third of all rows
    final = spread_join(named, groups.select("component", "component_id"), "component", groups, ["fp"]).select("fp", "component_id")
    return spread_join(marked, final, "fp", codes, ["doc_id"]).select("doc_id", "fp", "component_id")


def fingerprint_text(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Operator 4's fingerprints and its multi-index hashing find the nearest pairs; an exact check follows, as groups are those of five-word
    similarity 0.8 (``shingles.shingle_classes``), which also finds the pairs that are more than 2 bits apart. Survivors are chosen by id and
    shingle set, so rows that share an id but not a text are kept apart.
    Repeated rows with the kept id and set are reduced to one; a group whose
    ids are all null keeps one of its rows. Null, empty and wordless texts are one group. An empty table
    gives an empty result; extra columns are kept.
    """
    marked, named = shingle_classes(docs, code=fingerprint, code_links=hamming_links)
    classes = marked.groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = staged(classes.join(named, "cls"), "components")
    first = F.min(F.struct(F.col("least").isNull().alias("no"), F.col("least").alias("id"), F.col("cls").alias("set")))
    kept = classes.groupBy("component").agg(first.alias("k")).select(F.col("k.id").alias("__id"), F.col("k.set").alias("__kept"))
    ids = marked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.n == ids.ids:  # each row has an id of its own: rows go by it, and texts do not move if few go
        gone = marked.join(kept.select("__id"), F.col("doc_id") == F.col("__id"), "left_anti").select(F.col("doc_id").alias("__gone"))
        return docs.join(hinted(*counted(gone, "copies"), BROADCAST_IDS), docs["doc_id"] == F.col("__gone"), "left_anti")
    # both sides move by id and set
    out = docs.withColumn("__set", set_column(F.col("text"))).join(kept, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__set") == F.col("__kept")), "left_semi")
    return out.dropDuplicates(["doc_id", "__set"]).drop("__set")
