"""Gates: small questions whose answers decide whether a plan runs. Each gives rows that say why not, or what to do."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.schemas import SPLITS, TEST_ONLY, TRAINED

TRAIN_EVAL = "train_eval"


def role_gate(tables: DataFrame, run: str, place: str, role: str, allow_test_only: bool = False) -> DataFrame:
    """Training tables whose role forbids them.

    A run's first table must be a train_eval one, or a test_only one where that is
    allowed; further tables may be either. Held-out and missing roles never train.
    """
    first = F.row_number().over(Window.partitionBy(run).orderBy(place)) == 1
    known = F.coalesce(F.col(role), F.lit(""))
    may = (known == TRAIN_EVAL) | ((known == TEST_ONLY) & (F.lit(allow_test_only) | ~F.col("__first")))
    return tables.withColumn("__first", first).where(~may).select(run, place, role, F.lit("role_not_trainable").alias("reason"))


def own_validation(val: DataFrame, train: DataFrame, digest: str) -> DataFrame:
    """Validation tables that are among the training tables, by digest."""
    return val.join(train.select(digest).distinct(), digest, "left_semi")


def slice_needed(coverages: list[float]) -> int:
    """Rows that a validation slice must have for its strictest coverage to be a quantile of it."""
    return max(math.ceil(round(1 / (1 - c), 9)) for c in coverages)


def too_few(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Groups with fewer than ``least`` rows (G03): prototypes of a class, a slice, a bank."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def mixed_cache_keys(features: DataFrame, run: str, key: str) -> DataFrame:
    """Runs whose feature tables were made in more than one way."""
    return features.groupBy(run).agg(F.count_distinct(key).alias("n_keys")).where("n_keys > 1")


def class_gate(rows: DataFrame, run: str, klass: str, split: str, classes: tuple[str, ...] = TRAINED) -> DataFrame:
    """``(run, reason, classes)`` of runs that can't be trained.

    ``stray``: training classes that no head knows; ``single``: fewer than
    two classes; ``unvalidated``: classes without a validation row. One aggregation.
    """
    have = lambda s: F.collect_set(F.when(F.col(split) == s, F.col(klass)))
    by = rows.groupBy(run).agg(have("train").alias("t"), have("val").alias("v"))
    known = F.array(*[F.lit(c) for c in classes])
    own = F.array_intersect("t", known)
    told = F.array(
        F.struct(F.lit("stray").alias("reason"), F.array_except("t", known).alias("c"), (F.size(F.array_except("t", known)) > 0).alias("bad")),
        F.struct(F.lit("single").alias("reason"), own.alias("c"), (F.size(own) < 2).alias("bad")),
        F.struct(F.lit("unvalidated").alias("reason"), F.array_except(own, "v").alias("c"), (F.size(F.array_except(own, "v")) > 0).alias("bad")),
    )
    return by.select(run, F.explode(F.filter(told, lambda x: x["bad"])).alias("x")).select(run, "x.reason", F.array_join(F.array_sort("x.c"), "+").alias("classes"))


def shared_classes(rows: DataFrame, table: str, klass: str) -> DataFrame:
    """Classes that every table has (G06): a count of distinct pairs, however many tables there are."""
    pairs = rows.where(F.col(klass).isNotNull()).select(table, klass).distinct()
    every = rows.select(F.count_distinct(table).alias("__every"))
    return pairs.groupBy(klass).agg(F.count(F.lit(1)).alias("n_tables")).join(F.broadcast(every), F.col("n_tables") == F.col("__every")).drop("__every")


def target_action(targets: DataFrame, frozen: DataFrame) -> DataFrame:
    """What writing a table comes to (G08): ``write``, ``same`` for a frozen one that would not change, ``refuse`` for one that would.

    A refused name is told the next version, ``<stem>_v<n+1>``. The first record of a name counts.
    """
    held = frozen.groupBy("manifest").agg(F.min_by("sha256", "frozen_at").alias("__held"))
    action = F.when(F.col("__held").isNull(), "write").when(F.col("__held") == F.col("sha256"), "same").otherwise("refuse")
    version = F.regexp_extract("manifest", r"_v([0-9]+)$", 1)
    following = F.concat(F.regexp_replace("manifest", r"_v[0-9]+$", ""), F.lit("_v"), (F.coalesce(version.try_cast("int"), F.lit(1)) + 1).cast("string"))
    out = targets.join(held, "manifest", "left").withColumn("action", action)
    return out.withColumn("next_name", F.when(F.col("action") == "refuse", following)).drop("__held")


def quotable(runs: DataFrame, targets: DataFrame, run: str) -> DataFrame:
    """``(run, quotable, note)`` (G09): the run, its training tables and all its targets must allow it; the note says what does not."""
    frozen = targets.groupBy(run).agg(F.bool_and(F.coalesce("frozen", F.lit(False))).alias("__targets"))
    own, trained = F.coalesce("quotable", F.lit(False)), F.coalesce("train_frozen", F.lit(False))
    ok = own & trained & F.coalesce("__targets", F.lit(True))
    note = F.when(~own, F.coalesce(F.nullif("notes", F.lit("")), F.lit("not quotable"))).when(~ok, "a manifest is not frozen: not quotable").otherwise("")
    return runs.join(frozen, run, "left").select(run, ok.alias("quotable"), note.alias("note"))


def verdict_refused(readable: DataFrame, unpaired: DataFrame) -> str | None:
    """Why no verdict can be read (G10): pairs are missing, or there is nothing to read; None if there can be one."""
    if not unpaired.isEmpty():
        return "missing_pairs"
    return "no_rows" if readable.isEmpty() else None


def registrable(models: DataFrame, versions: DataFrame, name: str = "model_version") -> DataFrame:
    """``(model_version, action)`` (G11): ``register``, or why not: not quotable, a card that no longer fits its rows, a version that exists."""
    known = versions.select(F.col(name).alias("__known")).distinct()
    out = models.join(known, F.col(name) == F.col("__known"), "left")
    action = (
        F.when(~F.coalesce("quotable", F.lit(False)), "not_quotable")
        .when(~F.coalesce(F.col("card_sha256") == F.col("fresh_sha256"), F.lit(False)), "stale_card")
        .when(F.col("__known").isNotNull(), "present")
        .otherwise("register")
    )
    return out.select(name, action.alias("action"))


def shards_left(rows: DataFrame, done: DataFrame, identity: list[str], shard: str = "shard") -> DataFrame:
    """Shards still to do (G13). Done ones count only if key, digest, shard size and row number are those of now; nulls equal nulls."""
    same = F.col(f"a.{shard}") == F.col(f"b.{shard}")
    for c in identity:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.select(shard, *identity).distinct().alias("a").join(done.alias("b"), same, "left_anti")


def inside(path: Column, root: str) -> Column:
    """Does a path lie below a folder, with no way up in it."""
    base = root.rstrip("/") + "/"
    return path.startswith(base) & ~path.rlike(r"(^|/)\.\.(/|$)")


def in_order(runs: DataFrame, created: str = "created_at", name: str = "run_id") -> DataFrame:
    """Runs as they are listed: by creation, then name."""
    return runs.orderBy(F.col(created).asc_nulls_first(), name)


def crop_violations(crops: DataFrame, parents: DataFrame, parent: str = "parent_image_id", row_no: str = "row_no") -> DataFrame:
    """``(reason, key, n_rows)``: crops without their parent, and parents whose crops lie in several splits."""
    known = parents.select(F.col("image_id").alias(parent)).distinct()
    by = crops.groupBy(parent).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("split").isin(*SPLITS), F.col("split"))).alias("n_splits"))
    lost = by.join(known, parent, "left_anti").select(F.lit("parent_missing").alias("reason"), F.col(parent).alias("key"), "n_rows")
    return lost.union(by.where("n_splits > 1").select(F.lit("group_straddles_split"), F.col(parent), "n_rows"))
