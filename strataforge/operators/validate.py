"""Validation: rules as columns, violations as rows ``(reason, row_no, message)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataforge.functions.scalars import metric_name
from strataforge.schemas import BATCHES, CLASSES, FOLD_RULE, FORMATS, HEX16, HEX64, HOLDOUT, LICENCES, NUMBERS, RULE, SCORES, SPLITS, STAMP, TRAINED, UNKNOWN, UNLABELLED


def not_true(rule: Column) -> Column:
    """A rule that is false or null is broken."""
    return ~F.coalesce(rule, F.lit(False))


def violations(rows: DataFrame, rules: list[tuple[str, str, Column]], row_no: str = "row_no") -> DataFrame:
    """A row for each broken rule ``(reason, message, holds)``. All rules are checked in one pass, without a shuffle."""
    found = F.array_compact(F.array(*[F.when(not_true(ok), F.struct(F.lit(reason).alias("reason"), F.lit(what).alias("message"))) for reason, what, ok in rules]))
    return rows.select(row_no, F.explode(found).alias("v")).select("v.reason", row_no, "v.message")


def missing_fields(rows: DataFrame, body: str, schema: T.StructType, nested: dict[str, T.StructType] | None = None, row_no: str = "row_no") -> DataFrame:
    """``(reason, row_no, message)`` of JSON rows that lack fields, with their names in the fields' order.

    A field that is there as null does not lack. Fields of a nested object are looked for where it is one.
    """
    have = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    lacks = F.array_except(F.array(*[F.lit(f.name) for f in schema.fields]), have)
    for name, inner in (nested or {}).items():
        own = F.json_object_keys(F.get_json_object(body, f"$.{name}"))
        named = F.transform(F.array_except(F.array(*[F.lit(f.name) for f in inner.fields]), own), lambda k: F.concat(F.lit(f"{name}."), k))  # noqa: B023
        lacks = F.concat(lacks, F.coalesce(F.when(F.get_json_object(body, f"$.{name}").startswith("{"), named), F.array().cast("array<string>")))
    told = rows.select(row_no, lacks.alias("lacks")).where(F.size("lacks") > 0)
    return told.select(F.lit("missing_field").alias("reason"), row_no, F.array_join("lacks", ", ").alias("message"))


def wrong_fields(rows: DataFrame, body: str, schema: T.StructType, row_no: str = "row_no") -> DataFrame:
    """``bad_fields`` of JSON rows whose keys are not just the schema's, in its order."""
    want = F.array(*[F.lit(f.name) for f in schema.fields])
    have = F.json_object_keys(body)
    return rows.where(not_true(have == want)).select(F.lit("bad_fields").alias("reason"), row_no, F.coalesce(F.array_join(have, ","), F.lit("")).alias("message"))


def in_order(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's fields alone, in its order; one that lacks is null of its kind."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def file_violations(rows: DataFrame, files: DataFrame, path: str = "path", digest: str = "sha256", row_no: str = "row_no") -> DataFrame:
    """``missing_file`` and ``sha256_mismatch`` of rows against a scan of storage."""
    held = files.select(F.col(path).alias("__path"), F.col(digest).alias("__digest"))
    both = rows.select(row_no, path, digest).join(held, F.col(path) == F.col("__path"), "left")
    why = F.when(F.col("__path").isNull(), "missing_file").when(not_true(F.col("__digest") == F.col(digest)), "sha256_mismatch")
    return both.select(why.alias("reason"), row_no, F.col(path).alias("message")).where("reason is not null")


def manifest_rules(licences_allowed: bool = False) -> list[tuple[str, str, Column]]:
    """Rules of a single manifest row (V02, V03, V07); unknown licences may be allowed."""
    c = F.col
    split, klass = c("split"), c("class_km2")
    return [
        ("bad_value", "manifest_version", c("manifest_version").rlike("^[0-9]+$")),
        ("bad_value", "sha256", c("sha256").rlike(HEX64)),
        ("bad_value", "image_id", ~c("sha256").rlike(HEX64) | (c("image_id") == F.concat(c("dataset"), F.lit("_"), F.substring("sha256", 1, 16)))),
        ("bad_value", "phash", c("phash").rlike(HEX16)),
        ("bad_value", "class_km2", klass.isin(*CLASSES)),
        ("bad_value", "split", split.isin(*SPLITS, HOLDOUT)),
        ("bad_value", "licence", c("licence").isin(*LICENCES)),
        ("bad_value", "format", c("format").isin(*FORMATS)),
        ("bad_value", "width", c("width") >= 1),
        ("bad_value", "height", c("height") >= 1),
        ("bad_value", "path", ~c("path").contains("\\") & ~c("path").startswith("/")),
        ("bad_value", "unknown in test", ~(klass.isin(*UNKNOWN) & (split == "test"))),
        ("bad_split_rule", "split_rule", c("split_rule").rlike(RULE)),
        ("unknown_in_train", "class", ~(klass.isin(*UNKNOWN) & split.isin("train", "val"))),
        ("unlabelled_in_train", "class", ~((klass == UNLABELLED) & split.isin("train", "val"))),
        *([] if licences_allowed else [("licence_unknown", "licence", c("licence") != "unknown")]),
    ]


def order_violations(rows: DataFrame, key: str, row_no: str = "row_no", parts: int = 64) -> DataFrame:
    """``duplicate_image_id`` and ``rows_not_sorted``.

    Row numbers are dealt in runs, so that each run's order is one window;
    a run also holds the last row of the one before.
    """
    first = rows.groupBy(key).agg(F.min(row_no).alias("first"))
    twice = rows.join(first, key).where(F.col(row_no) > F.col("first")).select(F.lit("duplicate_image_id").alias("reason"), row_no, F.col(key).alias("message"))
    w = Window.partitionBy("run").orderBy(row_no)
    size = 100_000
    run = F.floor(F.col(row_no) / size)
    dealt = rows.select(key, row_no, F.explode(F.array_distinct(F.array(run, F.floor((F.col(row_no) + 1) / size)))).alias("run"))
    # the row that ends a run is also dealt to the next one, where it is only looked back at
    before = dealt.withColumn("previous", F.lag(key).over(w)).where(F.col("run") == F.floor(F.col(row_no) / size))
    fell = before.where(F.col(key) < F.col("previous")).select(row_no, key)
    fell = fell.join(twice.select(F.col(row_no).alias("__no")), F.col(row_no) == F.col("__no"), "left_anti")
    return twice.union(fell.select(F.lit("rows_not_sorted").alias("reason"), row_no, F.col(key).alias("message")))


def straddling(rows: DataFrame, group: str) -> DataFrame:
    """Groups with rows in more than one split."""
    by = rows.where(F.col("split").isin(*SPLITS)).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count(F.lit(1)).alias("n"))
    return by.where(F.col("splits").contains(",")).select(F.col(group).cast("string").alias("grp"), "splits", "n")


def missing_classes(rows: DataFrame, classes: tuple[str, ...] = TRAINED) -> DataFrame:
    """Splits in which a class that occurs has no rows."""
    by = rows.where(F.col("class_km2").isin(*classes) & (F.col("split_rule").startswith("blocked:") | F.col("split_rule").startswith("unblocked:"))).groupBy("class_km2").agg(F.collect_set("split").alias("have"))
    return by.select("class_km2", F.explode(F.array_except(F.array(*[F.lit(s) for s in SPLITS]), "have")).alias("lacks"))


def metric_ok(metric: Column, classes: Column) -> Column:
    """The metric grammar: a name, and a qualifier as its kind asks for."""
    name, tail = metric_name(metric), F.regexp_extract(metric, ":(.*)$", 1)
    has = metric.contains(":")
    known = F.array_contains(classes, tail)
    return (
        F.when(name.isin("macro_f1", "unknown_recall", "ece", "selective_risk"), ~has)
        .when(name == "recall", has & known)
        .when(name == "abstention_rate", ~has | known)
        .when(name == "auroc", has & tail.isin(*SCORES))
        .when(name == "latency_ms", has & tail.isin(*BATCHES))
        .when(name == "balanced_accuracy", ~has | (tail != ""))
        .otherwise(F.lit(False))
    )


def result_rules(frozen: list[str] | None = None) -> list[tuple[str, str, Column]]:
    """Rules of a results row."""
    c = F.col
    parts = lambda x: F.split(c(x), r"\+")
    hashes = lambda side: (F.size(parts(f"{side}_manifest_sha256")) == F.size(parts(f"{side}_manifest"))) & F.forall(parts(f"{side}_manifest_sha256"), lambda h: h.rlike(HEX64))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    text = lambda x: F.coalesce(c(x) != "", F.lit(False))
    low, high = c("ci_low"), c("ci_high")
    rule_parts = parts("split_rule")
    rules = [
        ("bad_value", "ts", c("ts").rlike(STAMP)),
        ("bad_number", "number", c("number").isin(*NUMBERS)),
        ("bad_metric", "metric", metric_ok(c("metric"), c("classes"))),
        ("bad_value", "value", number(c("value"))),
        ("bad_value", "ci_low, ci_high", (low.isNull() & high.isNull()) | (number(low) & number(high) & (low <= high))),
        ("bad_value", "n", c("n") >= 1),
        *[("bad_value", k, text(k)) for k in ("backbone_id", "token_type", "head", "train_split", "run_id")],
        ("bad_value", "res", c("res") >= 1),
        ("bad_value", "seed", c("seed").isNull() | (c("seed") >= 0)),
        ("bad_hash", "train_manifest_sha256", hashes("train")),
        ("bad_hash", "test_manifest_sha256", hashes("test")),
        ("bad_value", "test_split", c("test_split").isin("test", HOLDOUT, "all") | c("test_split").rlike("^cv[1-9][0-9]*$")),
        ("bad_split_rule", "split_rule", F.forall(rule_parts, lambda r: r.rlike(RULE) | r.rlike(FOLD_RULE)) & (rule_parts == F.array_sort(F.array_distinct(rule_parts)))),
        ("bad_value", "coverage", (c("coverage") > 0) & (c("coverage") <= 1)),
        ("bad_value", "classes", (F.size("classes") > 0) & F.forall("classes", lambda x: x != "")),
        ("bad_value", "superseded", c("superseded").isNull() | (c("superseded") != "")),
        ("bad_value", "quotable", c("quotable").isNotNull()),
        ("n3_not_held_out", "classes", (c("number") != "N3") | ((c("test_split") == HOLDOUT) & (F.size(F.array_except("classes", F.array(*[F.lit(u) for u in UNKNOWN]))) == 0))),
    ]
    if frozen is not None:
        listed = F.array(*[F.lit(h) for h in frozen]).cast("array<string>")
        own = F.concat(parts("train_manifest_sha256"), parts("test_manifest_sha256"))
        rules.append(("manifest_not_frozen", "sha256", ~F.coalesce(c("quotable"), F.lit(False)) | (F.size(F.array_except(own, listed)) == 0)))
    return rules


def exit_code(n_violations: int, freeze_broken: bool) -> int:
    """0 for clean, 2 for violations, 3 for a broken freeze, which wins."""
    return 3 if freeze_broken else 2 if n_violations else 0
