"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.arrow_text import LOWER, WORD_BYTES, folded_steps, gram_hashes, mix, rows_per_batch, spans, steps, word_hashes

#: Words of a shingle, least share of an item's shingles, values of a signature at most, values of a full signature that a document must hold.
WORDS, LEAST, HASHES, HITS = 5, 0.8, 32, 4
#: Test items, and bytes of their texts, that one pass over the documents searches for. Their index is broadcast: texts, 8 bytes
#: a shingle, and the signatures, about 15 KB for an item of 1,000 words.
ITEMS, ITEM_BYTES = 20_000, 16 << 20

_WORD = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")


def shingles(text: str, words: int = WORDS, fold: bool = False) -> list[str]:
    """Distinct runs of words in order; a text of fewer words has its whole sequence, a wordless one none."""
    w = _WORD.findall(_lower(text, fold))
    if not w:
        return []
    n = max(len(w) - words + 1, 1)
    return list(dict.fromkeys(" ".join(w[i : i + words]) for i in range(n)))


_UPPER = {i: i + 32 for i in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.translate(_UPPER)


def _lower(text: str, fold: bool) -> str:
    return text.casefold() if fold else lower_ascii(text)


def _hash(texts: list[str]) -> np.ndarray:
    """The same hashes of shingles that the documents' bytes give, by number of words."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        start, end, first = spans(data, np.array([0, len(data)]), WORD_BYTES)
        out[i] = gram_hashes(word_hashes(data, start, end), first, len(start))[0][0]
    return out


_RNG = np.random.Generator(np.random.PCG64(7))
_ODD, _ADD = _RNG.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, dtype=np.uint64)


class Table:
    """The signatures of one partition: sorted values with their items, and a bitmap of the values' low bits."""

    def __init__(self, entries: list[tuple[int, np.ndarray]], hits: int) -> None:
        self.hits = hits
        value = np.concatenate([h for _, h in entries])
        item = np.repeat([at for at, _ in entries], [len(h) for _, h in entries])
        order = np.argsort(value, kind="stable")
        self.value, self.item = value[order], item[order]
        self.mask = np.uint64((1 << min(max(len(value) * 32, 1 << 10).bit_length(), 22)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(value & self.mask).astype(np.int64)] = True

    def search(self, h: np.ndarray, runs: np.ndarray, out: list[set[int]]) -> None:
        """Adds to ``out`` the items of which a row holds at least ``hits`` values of the signature."""
        at = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        if not len(at):
            return
        low, high = np.searchsorted(self.value, h[at], "left"), np.searchsorted(self.value, h[at], "right")
        row = np.searchsorted(runs, at, "right") - 1
        seen: dict[tuple[int, int], set[int]] = {}
        for k in np.flatnonzero(high > low):
            for i in range(low[k], high[k]):
                seen.setdefault((int(row[k]), int(self.item[i])), set()).add(int(self.value[i]))
        for (r, item), values in seen.items():
            if len(values) >= self.hits:
                out[r].add(item)


class Index:
    """Signatures of test items, partitioned by size.

    Items are put into partitions by the power of two of their number of
    shingles, and by shingle length for items under ``words`` words; each has a table of its own. The
    signature of an item is the MinHash sketch of its least permuted values. In a partition of small items it
    has one value more than an item may lack, so a document that holds the item
    holds one of them for certain. In a partition of items for which that would be more than ``hashes``
    values, it has ``hashes``, of which a document must hold ``HITS``: at a share of
    0.8 it holds fewer with probability 1e-17.
    """

    def __init__(self, items: list[tuple[int, str | None]], words: int = WORDS, hashes: int = HASHES, fold: bool = False, least: float = LEAST) -> None:
        self.fold, self.words = fold, words
        self.ids, self.texts, self.hashes, self.length, parts = [], [], [], [], {}
        for key, text in items:
            own = shingles(text or "", words, fold)
            if not own:
                continue
            h = np.unique(_hash(own))
            length = own[0].count(" ") + 1
            parts.setdefault((length, len(h).bit_length()), []).append((len(self.ids), h))
            self.ids.append(key)
            self.texts.append(text)
            self.hashes.append(h)
            self.length.append(length)
        #: by shingle length: the tables of its partitions
        self.tables: dict[int, list[Table]] = {}
        for (length, size), part in sorted(parts.items()):
            top = (1 << size) - 1
            lacks = top - math.ceil(least * top - 1e-9)
            long, hits = (lacks + 1, 1) if lacks < hashes else (hashes, min(HITS, hashes))
            self.tables.setdefault(length, []).append(Table([(at, h[np.argsort(mix(h * _ODD + _ADD), kind="stable")[:long]]) for at, h in part], hits))

    def held(self, data: np.ndarray, offsets: np.ndarray, least: float) -> list[list[int]]:
        """By row the items that it holds, by the hashes of their shingles."""
        out: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        data = LOWER[data]
        start, end, first = spans(data, offsets, WORD_BYTES)
        words = word_hashes(data, start, end)
        own = {}
        for length, tables in self.tables.items():
            h, _, runs = own[length] = gram_hashes(words, first, length)
            for table in tables:
                table.search(h, runs, out)
        found: list[list[int]] = []
        for row, some in enumerate(out):
            found.append([])
            for at in sorted(some):
                h, _, runs = own[self.length[at]]
                n = int(np.isin(self.hashes[at], h[runs[row] : runs[row + 1]]).sum())
                if n >= least * len(self.hashes[at]):
                    found[-1].append(at)
        return found

    def matches(self, text: str, found: list[int], least: float) -> list[tuple[int, int, int]]:
        """(item id, shingles, shingles found) of items that the text holds, compared as strings."""
        w = _WORD.findall(_lower(text, self.fold))
        held: dict[int, set[str]] = {}
        out = []
        for at in found:
            own = shingles(self.texts[at], self.words, self.fold)
            n = self.length[at]
            if n not in held:
                held[n] = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
            same = sum(x in held[n] for x in own)
            if same >= least * len(own):
                out.append((self.ids[at], len(own), same))
        return out


MATCH = "array<struct<item_id:bigint,n_shingles:int,n_found:int>>"


def _matcher(spark, items: list, words: int, least: float, hashes: int, text: Column, fold: bool = False) -> Column:
    index = spark.sparkContext.broadcast(Index(items, words, hashes, fold, least))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_found", pa.int32())]))

    @F.arrow_udf(MATCH)
    def match(x: pa.Array) -> pa.Array:
        own, out = index.value, [[] for _ in range(len(x))]
        for first, _, data, offsets in (folded_steps if own.fold else steps)(x):
            for k, found in enumerate(own.held(data, offsets, least)):
                if found:
                    out[first + k] = [dict(zip(("item_id", "n_shingles", "n_found"), m, strict=True)) for m in own.matches(x[first + k].as_py(), found, least)]
        return pa.array(out, kind)

    return match(text)


def _slices(bench: DataFrame, items: int) -> int:
    n, size = bench.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, -(-n // items), -(-size // ITEM_BYTES))


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, least: float = LEAST, hashes: int = HASHES, items: int = ITEMS, fold: bool = False) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` for each row of ``docs`` and each item it holds.

    Words are runs of letters, digits, underscores and characters outside
    ASCII, ASCII letters in lower case or, with ``fold`` (as in the query), all
    letters in Unicode's folded case; an item is held if at least ``least`` of its
    distinct shingles occur in the text. Items of fewer than ``words`` words are one shingle;
    null and wordless items match nothing, null texts hold nothing; null ids are kept. Repeated
    rows and items are each reported; texts count whole, however long; empty tables give an empty
    result; extra columns, whatever their names, are ignored. Documents are not shuffled: they pass once for each
    slice of at most about ``items`` items and ``ITEM_BYTES`` bytes, whose index is broadcast.
    """
    spark = docs.sparkSession
    rows_per_batch(spark, size=8 << 20)
    bench = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    slices = _slices(bench, items)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    out = None
    # explode_outer: from a plain explode a filter on the matches is inferred, and the search would run twice
    for k in range(slices):
        own = [(r.item_id, r.text) for r in bench.where(part == k).collect()]
        found = docs.select(F.col(id_col).alias("doc_id"), _matcher(spark, own, words, least, hashes, F.col(text_col), fold).alias("m")).select("doc_id", F.explode_outer("m").alias("m")).where(F.col("m").isNotNull()).select("doc_id", "m.*")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without documents that hold a benchmark item, in whatever case.

    The decision is made on the rows themselves: for one slice of items no
    shuffle is needed, and null ids or repeated ids do not matter. Null and empty texts hold nothing and
    stay; empty tables are allowed; columns are kept. An item of fewer than five words is held by each
    document that has these words in a row: an item of one word drops all documents with it.
    """
    spark = docs.sparkSession
    rows_per_batch(spark, size=8 << 20)
    slices = _slices(benchmark, ITEMS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    for k in range(slices):
        own = [(r.item_id, r.text) for r in benchmark.select("item_id", "text").where(part == k).collect()]
        docs = docs.withColumn("__m", _matcher(spark, own, WORDS, LEAST, HASHES, docs["text"], fold=True)).where(F.size("__m") == 0).drop("__m")
    return docs
