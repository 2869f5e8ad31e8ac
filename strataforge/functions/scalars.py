"""Hashes, names, dates, and small grammars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataforge.functions.vectors import once


def content_id(prefix: Column | str, digest: Column) -> Column:
    """<prefix>_<first 16 hex digits of the digest>."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("_"), F.substring(digest, 1, 16))


def hex_to_bits(h: Column) -> Column:
    """16 hex digits as a bigint of the same 64 bits."""
    return F.conv(h, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def median_code(v: Column) -> Column:
    """A bit for each of up to 64 values, first value highest: above the median or not."""
    ordered = F.sort_array(v)
    n = F.size(v)
    middle = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2
    bit = lambda x, m: F.when(x > m, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return once(middle, lambda m: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x, m))))


def plus_set(x: Column) -> Column:
    """A name of several parts joined by + as a sorted array of distinct parts."""
    return F.array_sort(F.array_distinct(F.split(x, r"\+")))


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def day_from_millis(stem: Column, hours: int = 3) -> Column:
    """The day, at a fixed offset from UTC, of a name of 13 digits read as Unix milliseconds."""
    seconds = F.when(stem.rlike(r"^[0-9]{13}$"), F.floor(stem.cast("double") / 1000) + hours * 3600)
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")


def day_from_iso(value: Column) -> Column:
    """The local day of an ISO 8601 date-time as written, whatever its offset; null if it isn't one."""
    good = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    return F.date_format(F.when(good, F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")), "yyyy-MM-dd")


def day_from_exif(value: Column) -> Column:
    """YYYY:MM:DD (a time may follow) as YYYY-MM-DD; null if it is no day."""
    day = F.regexp_extract(value, r"^([0-9]{4}:[0-9]{2}:[0-9]{2})", 1)
    return F.date_format(F.try_to_date(F.nullif(day, F.lit("")), "yyyy:MM:dd"), "yyyy-MM-dd")


def trailing_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[0-9]+$", "")


def metric_name(metric: Column) -> Column:
    return F.substring_index(metric, ":", 1)


def _contains(part: str):
    def test(x: Column) -> Column:
        return x.contains(part)

    return test


def licence(texts: Column) -> Column:
    """The licence that an array of stated texts names, if all name one; else ``unknown``."""
    # Stated names and addresses by licence.
    names = {
        "cc-by-4.0": "CC-BY-4.0",
        "cc by 4.0": "CC-BY-4.0",
        "creative commons attribution 4.0 international": "CC-BY-4.0",
        "cc0-1.0": "CC0-1.0",
        "cc0 1.0": "CC0-1.0",
        "cc0": "CC0-1.0",
        "creative commons zero v1.0 universal": "CC0-1.0",
        "mit": "MIT",
    }
    addresses = {"creativecommons.org/licenses/by/4.0": "CC-BY-4.0", "creativecommons.org/publicdomain/zero/1.0": "CC0-1.0"}
    low = F.transform(texts, lambda x: F.lower(F.trim(x)))
    by_name = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    found = F.transform(low, lambda x: by_name[x])
    for address, value in addresses.items():
        named = F.exists(low, _contains(address))
        found = F.concat(found, F.when(named, F.array(F.lit(value))).otherwise(F.array().cast("array<string>")))
    distinct = F.array_distinct(F.array_compact(found))
    return F.when(F.size(distinct) == 1, F.element_at(distinct, 1)).otherwise(F.lit("unknown"))


def uri_kind(uri: Column) -> Column:
    """How a frame address is served: ``file``, ``relative``, ``absolute``, ``escape`` (outside the root) or ``unserved`` (another scheme)."""
    scheme = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]+):", 1)
    path = F.when(scheme == "file", F.regexp_replace(uri, "^file://[^/]*", "")).otherwise(uri)
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, x: F.struct(
            (s["at"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("at"),
            F.least(s["low"], s["at"] + F.when(x == "..", -1).otherwise(0)).alias("low"),
        ),
    )["low"]
    return (
        F.when(~scheme.isin("", "file"), "unserved")
        .when((depth < 0) & ~path.startswith("/"), "escape")
        .when(scheme == "file", "file")
        .when(path.startswith("/"), "absolute")
        .otherwise("relative")
    )
