"""Near copies by the similarity of their word shingles: MinHash bands find pairs, exact Jaccard similarity confirms them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strataforge.llm.arrow_text import NOT_SPACE, folded_steps, gram_hashes, mix, rows_per_batch, spans, steps, word_hashes
from strataforge.llm.joins import hinted, spread_join
from strataforge.operators.graph import connected_components
from strataforge.session import counted, staged

#: Words of a shingle, least similarity of a pair that is linked.
WORDS, LEAST = 5, 0.8
#: A pair of similarity 0.8 agrees in none of 32 bands of 4 minima with probability 5e-8.
BANDS, ROWS = 32, 4
#: Members of a band's bucket that are all compared with each other; of fuller ones all are compared with ``HUBS`` members first.
BUCKET, HUBS = 6, 1
#: A sketch has two bits of each of the 128 minima. Of a pair of similarity 0.8, 15 % of them differ, and more than 44 with probability 1e-8; such a pair is not compared in full.
SKETCH, APART = BANDS * ROWS // 32, 44
#: The finer sketch of the classes that are compared has 2,048 minima. At similarity 0.8 more than ``FINE_APART`` of them differ with probability 1e-8, fewer than ``SURE + 1`` too: only pairs between are compared in full.
FINE, FINE_APART, SURE = 64, 401, 219
#: Texts and bytes that a Python worker gets at once: arrays of hashes are larger than their texts.
BATCH_ROWS, BATCH_BYTES = 300, 2 << 20
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(19))
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FINE_ODD = _RNG.integers(0, 1 << 63, FINE * 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_ADD = _RNG.integers(0, 1 << 63, FINE * 32, dtype=np.uint64)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """By row: sorted distinct 64-bit hashes of its shingles; a shorter text has its whole sequence, a wordless one none."""
    start, end, first = spans(data, offsets, NOT_SPACE)
    own = word_hashes(data, start, end)
    h, _, runs = gram_hashes(own, first, words)
    out = []
    for k in range(len(offsets) - 1):
        n = int(first[k + 1] - first[k])
        if n >= words:
            out.append(np.unique(h[runs[k] : runs[k + 1]]))
        elif n:
            out.append(gram_hashes(own[first[k] : first[k + 1]], np.array([0, n]), n)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _bands(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of each set, and its sketch; no set is empty."""
    h = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    keys, sketch = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), SKETCH), np.uint64)
    for j in range(BANDS * ROWS):
        least = np.minimum.reduceat(h * _ODD[j] + _ADD[j], starts)
        band = j // ROWS
        keys[:, band] = mix((keys[:, band] if j % ROWS else np.full(len(sets), band, np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + least)
        sketch[:, j // 32] |= (mix(least) & np.uint64(3)) << np.uint64(2 * (j % 32))
    return keys.view(np.int64), sketch.view(np.int64)


def _digest(own: np.ndarray) -> int:
    d = xxh64_intdigest(own.tobytes(), 42) if len(own) else 0
    return d - (1 << 64) * (d >> 63)


def set_column(text, words: int = WORDS, want: str = "cls"):
    """A column of each text: its set's 64-bit digest ``cls`` (0 of wordless texts), or a struct of it with the bands, or with the shingles and their finer sketch.

    Words are runs of anything but ASCII white space, in Unicode's folded case.
    """
    kinds = {"cls": (), "bands": (("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))), "shingles": (("fine", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64())))}[want]
    ddl = {"cls": "bigint", "bands": "struct<cls:bigint,n:int,bands:array<bigint>,sketch:array<bigint>>", "shingles": "struct<cls:bigint,fine:array<bigint>,shingles:array<bigint>>"}[want]

    @F.arrow_udf(ddl)
    def sets(x: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, offsets in folded_steps(x):
            own = _sets(data, offsets, words)
            cls = pa.array(list(map(_digest, own)), pa.int64())
            if want == "cls":
                parts.append(cls)
                continue
            if want == "shingles":
                fine, some = np.zeros((len(own), FINE), np.int64), [k for k, x in enumerate(own) if len(x)]
                if some:
                    fine[some] = _fine([own[k] for k in some])
                columns = [_lists(list(fine)), _lists(own)]
            else:
                keys, sketch = np.zeros((len(own), BANDS), np.int64), np.zeros((len(own), SKETCH), np.int64)
                some = [k for k, s in enumerate(own) if len(s)]
                if some:
                    keys[some], sketch[some] = _bands([own[k] for k in some])
                columns = [pa.array([len(s) for s in own], pa.int32()), _lists(list(keys)), _lists(list(sketch))]
            parts.append(pa.StructArray.from_arrays([cls, *columns], names=["cls", *[k for k, _ in kinds]]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("cls", pa.int64()), *kinds]) if kinds else pa.int64())

    return sets(text)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def _apart(a: str, b: str, size: int = SKETCH):
    """In how many of the minima two sketches differ."""
    odd = F.lit(0x5555555555555555).cast("bigint")
    differ = lambda x: F.bit_count((F.shiftrightunsigned(x, 1).bitwiseOR(x)).bitwiseAND(odd))
    if size > SKETCH:  # a term for each number would make plans, and code, of hundreds of kilobytes
        return F.aggregate(F.zip_with(a, b, lambda x, y: differ(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return sum((differ(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(size)), F.lit(0))


def _fine(sets: list[np.ndarray]) -> np.ndarray:
    """The finer sketches of sets of shingles, none of them empty."""
    out = np.zeros((len(sets), FINE), np.uint64)
    for at in range(0, len(sets), 64):
        h, starts = np.concatenate(sets[at : at + 64]), np.cumsum([0, *(len(s) for s in sets[at : at + 64][:-1])])
        for j in range(FINE * 32):
            least = np.minimum.reduceat(h * _FINE_ODD[j] + _FINE_ADD[j], starts)
            out[at : at + 64, j // 32] |= (mix(least) & np.uint64(3)) << np.uint64(2 * (j % 32))
    return out.view(np.int64)


def _sets_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The staged ``(cls, fine, shingles)`` of the wanted ``(cls, least)``: made anew from one row of each class, and only these move."""
    seen = Observation()
    wanted = staged(wanted.observe(seen, F.count(F.lit(1)).alias("n"), F.count("least").alias("ids")), "compared")
    ids, n_ids = counted(wanted.where("least is not null").select(F.col("least").alias("__least")).distinct(), "compared-ids")
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = chosen.join(hinted(ids, n_ids, BROADCAST_IDS), F.col("__id") == F.col("__least"), "left_semi")
    if seen.get["ids"] < seen.get["n"]:
        rows = rows.union(chosen.where("__id is null"))
    sets = staged(rows.select(set_column(F.col("__text"), words, "shingles").alias("s")).select("s.cls", "s.fine", "s.shingles"), "sets")
    found = sets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cls").alias("c")).first()
    if (found.n, found.c) == (seen.get["n"],) * 2:
        return sets
    # ids may repeat with other texts
    return staged(sets.join(hinted(wanted.select("cls"), seen.get["n"]), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v, apart)`` of those of the staged, distinct pairs that the finer sketches do not rule out."""
    both = _both(pairs, sets, "fine", "f")
    return both.select("u", "v", _apart("fu", "fv", FINE).alias("apart")).where(F.col("apart") <= FINE_APART)


def _both(pairs: DataFrame, sets: DataFrame, column: str, name: str) -> DataFrame:
    by = lambda c: pairs.groupBy(F.col(c)).agg(F.count(F.lit(1)).alias("n"))
    both = spread_join(pairs, sets.select(F.col("cls").alias("u"), F.col(column).alias(f"{name}u")), "u", by("u"), ["v"])
    return spread_join(both, sets.select(F.col("cls").alias("v"), F.col(column).alias(f"{name}v")), "v", by("v"), ["u"])


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, int]:
    """The staged ``(u, v)``, counted, of those of the staged, distinct pairs whose sets have a Jaccard similarity of ``least`` or more."""
    used = hinted(*counted(pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct(), "used"))
    both = _both(pairs, sets.join(used, "cls", "left_semi"), "shingles", "s")
    same = F.size(F.array_intersect("su", "sv"))
    return counted(both.where(same >= F.lit(least) * (F.size("su") + F.size("sv") - same)).select("u", "v"), "links")


def _coded(classes: DataFrame, code_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs ``(u, v)`` of classes by their fingerprints: each with the least class of its own, and the least classes of linked ones."""
    tops = staged(classes.groupBy("fp").agg(F.min("cls").alias("top"), F.count(F.lit(1)).alias("n")), "codes")
    own = spread_join(classes, tops.select("fp", "top"), "fp", tops, ["cls"]).where("cls <> top").select(F.col("cls").alias("u"), F.col("top").alias("v"))
    named = lambda c, name: tops.select(F.col("fp").alias(c), F.col("top").alias(name))
    across = staged(code_links(tops.select("fp")), "code-links").join(named("u", "a"), "u").join(named("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return own.union(across)


class _Links:
    """The components that the links so far make."""

    def __init__(self, sets: DataFrame, least: float) -> None:
        self.sets, self.least, self.labels, self.size = sets, least, None, 0

    def _add(self, new: DataFrame, n: int | None = None) -> None:
        if self.labels is None:
            self.labels, self.size = counted(connected_components(new), "labels")
        elif new.limit(1).count() if n is None else n:  # only links between components are followed, as links of their least members
            new = self.named(self.named(new, "u", "cu"), "v", "cv").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
            joined, n = counted(connected_components(new), "joined")
            wider = self.labels.join(hinted(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), n), "component", "left")
            self.labels, self.size = counted(wider.select("node", F.coalesce("wider", "component").alias("component")).union(joined).distinct(), "labels")

    def named(self, rows: DataFrame, cls: str, name: str) -> DataFrame:
        """``rows`` with the component of the class in column ``cls``."""
        own = self.labels.select(F.col("node").alias(cls), F.col("component").alias(name))
        return rows.join(hinted(own, self.size), cls, "left").withColumn(name, F.coalesce(name, cls))

    def take(self, judged: DataFrame) -> None:
        """Adds the pairs that their sketches make sure of, then, of the others, those between components whose sets are similar."""
        seen = Observation()
        judged = staged(judged.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("apart") <= SURE).alias("sure")), "judged")
        n, sure = seen.get["n"], seen.get["sure"]
        self._add(judged.where(F.col("apart") <= SURE).select("u", "v"), sure)
        if n == sure:
            return
        rest = self.named(self.named(judged.where(F.col("apart") > SURE).select("u", "v"), "u", "cu"), "v", "cv")
        rest, n = counted(rest.where("cu <> cv").select("u", "v"), "unclear")
        if n:
            self._add(*_linked(rest, self.sets, self.least))


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, code: Callable[[Column], Column] | None = None, code_links: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, cls)`` for each row, and ``(cls, component)`` for each class of equal sets.

    Two classes are linked if the Jaccard similarity of their distinct
    shingles is at least ``least``; components are those of the links. A pair
    is compared if it shares a band of MinHash values, and its sizes and sketches
    do not rule it out. Of a bucket with more than ``BUCKET`` members, all are compared with a hub first:
    the member that lies in most such buckets, as the text does that the others were made from. Then members that are
    still outside the bucket's largest component are compared with all of other components, so no pair of a bucket is left out
    unless it is already connected. To compare is to count the minima in which finer sketches differ; sets are
    read only for pairs that these leave open and that nothing has connected yet.

    With ``code``, a fingerprint of a text, and ``code_links``, the links ``(u, v)`` between fingerprints ``fp``, these give the first
    candidates, which are compared like the others; bands add the pairs that are too far apart for fingerprints.
    """
    rows_per_batch(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    fp = F.lit(0).cast("bigint") if code is None else code(F.col(text_col))
    marked = docs.select(F.col(id_col).alias("doc_id"), set_column(F.col(text_col), words, "bands").alias("s"), fp.alias("fp")).select("doc_id", "s.*", "fp")
    marked = staged(marked, "marked")
    own = F.struct("n", "bands", "sketch")
    classes = marked.groupBy("cls").agg(F.min("doc_id").alias("least"), F.any_value(own).alias("own"), F.min("fp").alias("fp")).select("cls", "least", "own.*", "fp")
    classes = staged(classes, "classes")
    keyed = classes.where("n > 0").select("cls", "n", "sketch", F.posexplode("bands").alias("band", "key"))
    tally = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("cls").alias("u"), F.max("cls").alias("v")).where("members > 1")
    tally = staged(tally, "buckets")
    fuller = hinted(*counted(tally.where("members > 2").select("key", "members"), "fuller"))
    members = staged(keyed.join(fuller, "key"), "members")
    # similar sets are similar in size
    alike = (F.least("nu", "nv") >= F.lit(least) * F.greatest("nu", "nv")) & (_apart("au", "av") <= APART)
    side = lambda rows, c, *more: rows.select("key", F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"a{c}"), *more)
    each = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"a{c}"))
    ordered = lambda pairs: pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    two = tally.where("members = 2").select("u", "v").distinct().join(each("u"), "u").join(each("v"), "v").where(alike).select("u", "v")
    few, crowd = members.where(F.col("members") <= BUCKET), members.where(F.col("members") > BUCKET)
    small = side(few, "u").join(side(few, "v"), "key").where((F.col("u") < F.col("v")) & alike).select("u", "v")
    crowd = staged(crowd.join(crowd.groupBy("cls").agg(F.count(F.lit(1)).alias("seen")), "cls"), "crowd")

    def hub(turn: int):
        """The member of most buckets; the turn and the bucket vary which of several is taken."""
        luck = F.pmod(F.xxhash64("cls", "key", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 22))
        return F.max_by(F.struct(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("au")), F.struct(F.col("seen") * (F.lit(0.75) + luck), F.col("cls")))

    hubs = crowd.groupBy("key").agg(F.array_distinct(F.array(*[hub(-k) for k in range(HUBS)])).alias("h")).select("key", F.explode("h").alias("h")).select("key", "h.*")
    large = ordered(side(crowd, "v").join(hubs, "key").where((F.col("u") != F.col("v")) & alike))
    pairs = two.union(small).union(large)
    if code_links is not None:
        pairs = pairs.union(ordered(_coded(classes.where("n > 0").select("cls", "fp"), code_links)))
    pairs = staged(pairs.distinct(), "pairs")
    ends = [pairs.select(F.col(c).alias("cls")).distinct() for c in ("u", "v")]
    wanted = ends[0].union(ends[1]).union(crowd.select("cls").distinct()).distinct().join(classes.select("cls", "least"), "cls")
    sets = _sets_of(wanted, docs, id_col, text_col, words)
    links = _Links(sets, least)
    links.take(_judged(pairs, sets))
    named = links.named(crowd, "cls", "component")
    parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    tops = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    tops, n_tops = counted(tops.select("key", "top"), "divided")
    if n_tops:
        rest = staged(named.join(hinted(tops, n_tops), "key"), "rest")
        more = rest.select("cls").distinct().join(classes.select("cls", "bands"), "cls")
        rest = rest.join(more, "cls").join(sets.select("cls", "fine"), "cls")
        way = lambda c: side(rest, c, *[F.col(k).alias(f"{i}{c}") for k, i in (("component", "c"), ("top", "t"), ("bands", "b"), ("band", "i"), ("fine", "f"))])
        # a pair is compared in the first band that it shares
        first = F.array_position(F.zip_with("bu", "bv", lambda a, b: a == b), True) - 1 == F.col("iu")
        once = (F.col("cv") == F.col("tv")) | (F.col("u") < F.col("v"))
        apart = _apart("fu", "fv", FINE)
        found = way("u").where("cu <> tu").join(way("v"), "key").where((F.col("cu") != F.col("cv")) & once & alike & (apart <= FINE_APART) & first)
        links.take(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), apart.alias("apart")).distinct())
    labels = links.labels
    named = classes.select("cls").join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"))
    return marked.select("doc_id", "cls"), named
