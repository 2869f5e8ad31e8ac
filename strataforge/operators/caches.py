"""Feature caches and runs: integrity, look-up, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.schemas import KEY_FIELDS, RUN_KEYS, STORAGE_TYPE, TOKEN_TYPES


#: Descriptors that one join broadcasts; more are taken in slices.
WANTED = 10_000


def json_text(x: Column) -> Column:
    """A string as JSON text in ASCII: what lies outside the printable characters is escaped, above 0xFFFF as a surrogate pair."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        above = code - 0x10000
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(0x3FF).cast("bigint")) + 0xDC00))
        out = F.when(code.between(0x20, 0x7E), c).when(code > 0xFFFF, pair).otherwise(unit(code))
        for plain, text in short.items():
            out = F.when(c == plain, F.lit(text)).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.when(x == "", "").otherwise(F.array_join(F.transform(F.split(x, ""), escaped), "")), F.lit('"'))


def _each_wanted(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of ``wanted``, repeated ones too, with what was found for its values."""
    own = found.select(*[F.col(c).alias(f"__w_{c}") for c in wanted.columns], *[c for c in found.columns if c not in wanted.columns])
    same = F.lit(True)
    for c in wanted.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    return wanted.join(own, same, "left").drop(*[f"__w_{c}" for c in wanted.columns])


def cache_key(fields: dict[str, Column]) -> Column:
    """The first 16 hex digits of the SHA-256 of the key fields as a JSON list; null if one lacks."""
    parts = [F.col("resolution").cast("string") if k == "resolution" else json_text(fields[k]) for k in KEY_FIELDS]
    text = F.concat(F.lit("["), *[x for k, p in enumerate(parts) for x in ((F.lit(", "), p) if k else (p,))], F.lit("]"))
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_problems(caches: DataFrame, manifest_sha256: str | None = None) -> DataFrame:
    """``(path, problem)`` of caches that may not be loaded: the first of six checks that each fails.

    ``caches`` has a row for each cache: ``path``, ``present`` (both files are there), the five key fields, ``cache_key``,
    ``manifest_sha256``, ``n_images``, ``storage_dtype`` (null: the usual one), ``shapes`` (what is recorded) and
    ``arrays`` (what is held), maps from an array's name to its shape and to its type and shape.
    """
    c = F.col
    tokens = F.array(*[F.lit(t) for t in TOKEN_TYPES])
    wrong = lambda rule: ~F.coalesce(rule, F.lit(False))
    shapes = F.forall(tokens, lambda t: F.coalesce(c("arrays")[t]["shape"] == c("shapes")[t], F.lit(False)))
    kinds = F.forall(tokens, lambda t: c("arrays")[t]["dtype"] == F.coalesce(c("storage_dtype"), F.lit(STORAGE_TYPE)))
    counts = F.forall(F.array(F.lit("image_id"), F.lit("sha256")), lambda t: F.coalesce(F.get(c("arrays")[t]["shape"], F.lit(0)) == c("n_images"), F.lit(False)))
    lacks = F.array_compact(F.array(*[F.when(c(k).isNull(), F.lit(k)) for k in KEY_FIELDS]))
    checks = [
        ("missing", wrong(c("present"))),
        ("lacks_key_field", F.size(lacks) > 0),
        ("wrong_key", wrong(cache_key({k: c(k) for k in KEY_FIELDS}) == c("cache_key"))),
        ("other_manifest", wrong(c("manifest_sha256") == manifest_sha256) if manifest_sha256 is not None else F.lit(False)),
        ("shape", wrong(shapes)),
        ("dtype", wrong(kinds)),
        ("n_images", wrong(counts)),
    ]
    found = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks])
    return caches.select("path", found.alias("problem")).where("problem is not null")


def find_caches(caches: DataFrame, wanted: DataFrame, on: list[str], key: str = "cache_key") -> DataFrame:
    """``wanted`` with ``state`` (found, not_found, ambiguous) and the ``path`` of the one cache that matches.

    A cache matches if it agrees in the columns ``on``, and in ``key`` where the wanted row names one.
    Only the number of matches and one path are kept of each, however many there are. A wanted row that is repeated is answered each time.
    """
    held = caches.select(F.col("path").alias("__path"), *[F.col(k).alias(f"__{k}") for k in [*on, key]])
    same = F.coalesce(F.col(key) == F.col(f"__{key}"), F.col(key).isNull())
    for k in on:
        same = same & (F.col(k) == F.col(f"__{k}"))
    both = wanted.distinct().join(held, same, "left")
    n = F.count("__path")
    out = both.groupBy(*wanted.columns).agg(n.alias("matches"), F.min("__path").alias("path"))
    state = F.when(F.col("matches") == 0, "not_found").when(F.col("matches") == 1, "found").otherwise("ambiguous")
    return _each_wanted(wanted, out.select(*wanted.columns, state.alias("state"), F.when(F.col("matches") == 1, F.col("path")).alias("path")))


def select_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``state`` (found, missing_run, ambiguous_run) and the ``run_id`` of the one run that matches.

    ``runs`` has ``run_id``, ``run`` (a struct of the run's record) and nested keys as they are recorded; a key that the wanted row
    leaves null is not asked for; training manifests match by their stems, in order. A run that lacks what is asked for does not match.
    """
    r = F.col("run")
    flat = {"backbone_id": r["backbone"]["backbone_id"], "res": r["backbone"]["res"], "tokens": r["tokens"], "head": r["head"], "seed": r["seed"], "head_config_sha256": r["head_config"]["sha256"]}
    stems = F.transform(F.split(r["train"]["manifest"], r"\+"), lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    held = runs.select(F.col("run_id").alias("__id"), *[flat[k].alias(f"__{k}") for k in RUN_KEYS], stems.alias("__train"))
    same = F.coalesce(F.col("train_manifests") == F.col("__train"), F.col("train_manifests").isNull())
    for k in RUN_KEYS:
        same = same & F.coalesce(F.col(k) == F.col(f"__{k}"), F.col(k).isNull())
    asked = wanted.distinct()
    parts = max(1, -(-asked.count() // WANTED))
    both = None
    for k in range(parts):  # a slice of descriptors is broadcast at a time
        one = held.join(F.broadcast(asked.where(F.pmod(F.xxhash64(*wanted.columns), F.lit(parts)) == k)), same, "right")
        both = one if both is None else both.unionByName(one)
    out = both.groupBy(*wanted.columns).agg(F.count("__id").alias("matches"), F.min("__id").alias("run_id"))
    state = F.when(F.col("matches") == 0, "missing_run").when(F.col("matches") == 1, "found").otherwise("ambiguous_run")
    return _each_wanted(wanted, out.select(*wanted.columns, state.alias("state"), F.when(F.col("matches") == 1, F.col("run_id")).alias("run_id")))


def inputs_digest(version: int | str) -> Column:
    """The digest of what a fit is a function of, from the columns of its record (V19): JSON with sorted keys."""
    c = lambda k: json_text(F.col(k))
    shown = str(version) if isinstance(version, int) else f'"{version}"'
    text = F.concat(
        F.lit('{"cache_key": '), c("cache_key"), F.lit(', "config_sha256": '), c("config_sha256"), F.lit(f', "fitter_version": {shown}, "run_id": '), c("run_id"),
        F.lit(', "tokens": '), c("tokens"), F.lit(', "train": ['), c("manifest_sha256"), F.lit(", "), c("train_split"), F.lit('], "val": ['), c("manifest_sha256"), F.lit(", "), c("val_split"), F.lit("]}"),
    )
    return F.sha2(text, 256)


def first_cache(features: DataFrame, digest: str, name: str) -> DataFrame:
    """The feature row of each digest that the first cache by name has; a row a digest moves."""
    w = Window.partitionBy(digest).orderBy(name)
    return features.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
