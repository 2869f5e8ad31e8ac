"""Vectorised work on the bytes of Arrow string columns.

A column arrives as one byte buffer with row offsets; words and n-grams are
found and hashed with whole-array numpy operations, so that no Python object
is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step takes at once; a longer row is taken alone.
STEP_BYTES = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def rows_per_batch(spark, rows: int = 2000, size: int = 32 << 20) -> None:
    """Bounds the Arrow batches that Python workers get, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, row offsets) in steps of bounded size; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def folded(texts: pa.Array) -> pa.Array:
    """Texts in Unicode's folded case, in which capitals with accents and ß equal their small forms."""
    return pa.array((None if x is None else x.casefold() for x in texts.to_pylist()), pa.large_string())


def folded_steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Steps of the folded texts; only one step's texts are held as Python strings."""
    for first, end, _, _ in steps(texts):
        for a, b, data, offsets in steps(folded(texts.slice(first, end - first))):
            yield first + a, first + b, data, offsets


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words as runs of anything but ASCII white space.
NOT_SPACE = ~byte_table((0x09, 0x0D), (0x20, 0x20))
#: Words as runs of ASCII letters, digits, underscore and any other character outside ASCII.
WORD_BYTES = byte_table((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the index of each row's first word (one more than rows)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    both = []
    for base in (_ODD, inverse):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, equal for equal bytes wherever they stand.

    A word is hashed as a polynomial of its bytes; words are taken in pieces of about
    ``STEP_BYTES``, a longer word by itself in pieces too, so temporaries stay small.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(int(np.searchsorted(ends, low + STEP_BYTES, "right")), at + 1)
        if int(ends[stop - 1]) - low <= STEP_BYTES:
            power, inverse = _powers(1 << STEP_BYTES.bit_length())
            part = data[low : int(ends[stop - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (sums[e] - sums[s]) * inverse[s]
        else:
            total, shift = 0, 1
            power, _ = _powers(1 << STEP_BYTES.bit_length())
            for k in range(low, int(ends[at]), STEP_BYTES):
                part = data[k : min(k + STEP_BYTES, int(ends[at]))]
                total = (total + shift * int(((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
                shift = shift * pow(int(_ODD), STEP_BYTES, 1 << 64) % (1 << 64)
            out[at] = np.uint64(total)
        at = stop
    return mix(out + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of n words within a row, the index of each run's first word, and each row's first run."""
    if n == 1:
        return words, np.arange(len(words)), first
    if len(words) < n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, np.zeros(len(first), np.int64)
    total = len(words) - n + 1
    joined = np.zeros(total, np.uint64)
    for k in range(n):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + words[k : k + total]
    whole = np.ones(total, bool)
    for k in range(1, n):  # a run may not pass the start of a row
        at = first[1:-1] - k
        whole[at[(at >= 0) & (at < total)]] = False
    at = np.flatnonzero(whole)
    return mix(joined[at]), at, np.searchsorted(at, first)
