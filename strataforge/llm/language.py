"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.arrow_text import mix, rows_per_batch

#: Buckets of the n-gram hash, lengths of n-grams, pseudo-count of a bucket.
BUCKETS, LENGTHS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: Labelled documents of a language that are learned from at most (about), and languages at most (their table is broadcast, 0.25 MB each).
TRAIN_ROWS, LANGUAGES = 4000, 256
#: N-grams that a score stands for: odds of a longer text, the prior's with them, are taken to this power of their share, which leaves the order of languages as it is.
SURE_GRAMS = 200.0
#: Code points that one numpy step takes at once; a longer text is taken in such steps.
STEP = 250_000


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)


def _stream(code: np.ndarray, inside: bool) -> np.ndarray:
    """Code points with runs of anything but letters as one blank; ``inside``: the point before was a letter."""
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] |= inside
    return np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)


def _hashed(code: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(code) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + code[k : len(code) - n + 1 + k]
    return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _long_counts(low: str) -> np.ndarray:
    """Counts by bucket of one lower-case text, in steps that see the last two points of the one before."""
    total = np.zeros(BUCKETS, np.int64)
    before, inside = np.array([32], np.uint64), False

    def add(own: np.ndarray) -> None:
        nonlocal before, total
        joined = np.concatenate([before, own])
        for n in LENGTHS:
            tail = joined[max(len(before) - n + 1, 0) :]  # n-grams that end in this step
            if len(tail) >= n:
                h = _hashed(tail, n)
                total += np.bincount(h[tail != 32] if n == 1 else h, minlength=BUCKETS)
        before = joined[-2:]

    for at in range(0, len(low), STEP):
        code = _points(low[at : at + STEP])
        own = _stream(code, inside)
        inside = bool(_letters()[code[-1]])
        if len(own):
            add(own)
    if before[-1] != 32:
        add(np.array([32], np.uint64))
    return total


def sparse_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, count) of the n-grams of the texts in order: letters in lower case, anything else one blank, blanks at both ends.

    Texts are taken together in steps of bounded size, and one pass of numpy makes
    the n-grams of a step. Each text has a blank of its own at both ends, so runs beyond a text hold two blanks.
    """
    first = 0
    while first < len(texts):
        size, held = 0, []
        while first + len(held) < len(texts):
            low = (texts[first + len(held)] or "").lower()
            if held and size + len(low) > STEP:
                break
            held.append(low)
            size += len(low)
        if size > STEP:  # one long text
            total = _long_counts(held[0])
            bucket = np.flatnonzero(total)
            yield np.full(len(bucket), first), bucket, total[bucket]
        else:
            code = _points("".join(f"\n{t}\n" for t in held))
            long = np.array([len(t) + 2 for t in held])
            letter = _letters()[code]
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[np.cumsum(long) - long] = True
            stream = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
            row = np.repeat(np.arange(len(held)), long)[keep]
            twice = (stream[1:] == 32) & (stream[:-1] == 32)
            pairs = []
            for n in LENGTHS:
                runs = len(stream) - n + 1
                if runs > 0:
                    good = stream != 32 if n == 1 else ~np.logical_or.reduce([twice[k : k + runs] for k in range(n - 1)])
                    pairs.append((row[:runs] * BUCKETS + _hashed(stream, n))[good])
            found, count = np.unique(np.concatenate(pairs), return_counts=True)
            yield found // BUCKETS + first, found % BUCKETS, count
        first += len(held)


def _grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of one text, each as often as it occurs."""
    return np.concatenate([np.zeros(0, np.int64), *(np.repeat(bucket, n) for _, bucket, n in sparse_counts([text]))])


def language_part(id_col: str = "doc_id", parts: int = 4) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """The languages in order and their log probabilities by bucket (and log priors in the last column).

    Learns from a sample of about ``rows`` documents of each language, drawn
    by a hash of the id; the counts by language and bucket are summed on the cluster, and
    only that table, bounded by languages and buckets, comes to the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).alias("lang")).count().limit(LANGUAGES + 1).collect()}
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(found)
    if not langs:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    scale = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows / found[k])))])
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(1 << 20)) < scale[F.col(lang_col)] * (1 << 20))
    rows_per_batch(docs.sparkSession, size=4 << 20)
    place = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for row, bucket, n in sparse_counts(batch.column(0).to_pylist()):
                np.add.at(total, (lang[row], bucket), n)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[row, bucket], pa.int64())], names=["lang", "bucket", "n"])

    sums = drawn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    n = np.full((len(langs), BUCKETS), SMOOTHING)
    n[table["lang"].to_numpy(), table["bucket"].to_numpy()] += table["n"].to_numpy()
    prior = np.array([min(found[k], rows) for k in langs], float)
    log = np.concatenate([np.log(n / n.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())[:, None]], axis=1)
    return langs, log.astype(np.float32)


def classify(texts: list[str | None], langs: list[str], by_lang: np.ndarray, priors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text: the place of the likeliest language, the first of equal ones, and its share of the probability; (-1, 0) without a letter.

    Log odds are products of the sparse counts of all texts with the model's table. The share is taken
    after log odds of texts above ``SURE_GRAMS`` n-grams are scaled down to those of as many; the prior is scaled with them.
    """
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    if not langs:
        return best, score
    z, grams = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    for row, bucket, n in sparse_counts(texts):
        if len(row):
            first, last = int(row[0]), int(row[-1]) + 1
            for k in range(len(langs)):
                z[first:last, k] += np.bincount(row - first, n * by_lang[k, bucket], last - first)
            grams[first:last] += np.bincount(row - first, n, last - first)
    z += priors
    some = grams > 0
    p = (z[some] - z[some].max(axis=1, keepdims=True)) * np.minimum(1.0, SURE_GRAMS / grams[some])[:, None]
    p = np.exp(p)
    best[some] = np.argmax(z[some], axis=1)
    score[some] = p.max(axis=1) / p.sum(axis=1)
    return best, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: Column) -> Column:
    """A column ``struct<lang, score>`` for ``text``, by a model that is broadcast (languages x buckets floats)."""
    rows_per_batch(docs.sparkSession, size=4 << 20)
    langs, log = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(log[:, :-1].astype(np.float64)), log[:, -1].astype(np.float64)))

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(x: pa.Array) -> pa.Array:
        best, score = classify(x.to_pylist(), *shared.value)
        names = [*shared.value[0], "und"]
        return pa.StructArray.from_arrays([pa.array([names[k] for k in best], pa.string()), pa.array(score)], names=["lang", "score"])

    return guess(text)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs``.

    Rows whose crc32 of the id mod ``parts`` is ``held`` are never learned from, nor are null ids, languages
    and texts. Null texts and texts without a letter are ``und`` with score 0; so is every text if
    there is nothing to learn from. Of equally likely languages the first by name is told. Texts
    count whole, however long. Extra columns, whatever their names, are ignored; repeated rows
    are each answered; an empty table gives an empty result. More than ``LANGUAGES`` languages are refused.
    """
    out = F.coalesce(language_part(id_col, parts) == held, F.lit(False))
    model = train(docs.where(language_part(id_col, parts) != held), id_col, text_col, lang_col)
    told = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), identify(docs, model, F.col(text_col)).alias("__g"))
    return told.select("doc_id", "held_out", F.col("__g.lang").alias("lang_pred"), F.col("__g.score").alias("score"))


def keep_known_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without texts that are in no learned language, or whose best language is under ``least``.

    Null texts and texts without a letter go; rows with a null id or language are decided by their text. Repeated
    rows share their fate; an empty table gives an empty result; columns are kept as they are.
    """
    model = train(docs)
    marked = docs.withColumn("__g", identify(docs, model, docs["text"]))
    return marked.where((F.col("__g.lang") != "und") & (F.col("__g.score") >= least)).drop("__g")
