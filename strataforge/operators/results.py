"""The results table: seeds, pairs, superseding, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.schemas import SEEDS, T_975_4

#: Margin of a win, and a guard for values that are rounded.
MARGIN, GUARD = 0.02, 1e-9


def current(rows: DataFrame) -> DataFrame:
    """Quotable aggregates that nothing supersedes."""
    return rows.where(F.col("superseded").isNull() & F.col("quotable").eqNullSafe(True) & F.col("seed").isNull())


def readable(rows: DataFrame, res: int = 224, tokens: str = "cls", coverage: float = 1.0) -> DataFrame:
    """Current rows at the resolution, tokens and coverage that a verdict reads."""
    return current(rows).where((F.col("res") == res) & (F.col("token_type") == tokens) & (F.col("coverage") == coverage))


def aggregate_seeds(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """One row for each number whose seeds are exactly 0 to 4: mean and 95 % Student interval.

    Of several rows of a seed the last by ``order`` counts. One shuffle by
    the keys: the last row of a seed is an aggregation of structs within it.
    """
    last = rows.where(F.col("seed").isNotNull()).groupBy(*keys, "seed").agg(F.max_by(F.struct("ts", "value", "run_id", "quotable"), order).alias("r"))
    by = last.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seed", F.col("r.run_id").alias("run_id")))).alias("runs"),
        F.avg("r.value").alias("mean"),
        F.stddev_samp("r.value").alias("sd"),
        F.max("r.ts").alias("ts"),
        F.bool_and(F.coalesce("r.quotable", F.lit(False))).alias("quotable"),
    )
    five = F.transform("runs", lambda x: x["seed"]) == F.array(*[F.lit(s).cast("bigint") for s in SEEDS])
    half = F.lit(T_975_4) * F.col("sd") / F.sqrt(F.lit(float(len(SEEDS))))
    return by.where(five).select(
        *keys, "ts", F.round("mean", 4).alias("value"), F.round(F.col("mean") - half, 4).alias("ci_low"), F.round(F.col("mean") + half, 4).alias("ci_high"),
        F.array_join(F.transform("runs", lambda x: x["run_id"]), "+").alias("run_id"), "quotable",
    )


def unpaired(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with a current N1 and no N2, or the reverse, and the missing number."""
    have = rows.where(F.col("number").isin("N1", "N2")).groupBy(*keys).agg(F.bool_or(F.col("number") == "N1").alias("a"), F.bool_or(F.col("number") == "N2").alias("b"))
    return have.where("a <> b").select(*keys, F.when(F.col("a"), "N2").otherwise("N1").alias("missing"))


def run_parts(rows: DataFrame) -> DataFrame:
    """A row for each run id that a row stands on."""
    return rows.withColumn("part", F.explode(F.split("run_id", r"\+")))


def replaced(runs: DataFrame, configs: list[str]) -> DataFrame:
    """Runs trained with one of the configs, and mixes of such runs: ``(run_id)`` from ``(run_id, config, components)``."""
    own = runs.where(F.col("config").isin(*configs)).select("run_id")
    mixes = runs.select("run_id", F.explode("components").alias("part")).join(own.select(F.col("run_id").alias("part")), "part", "left_semi").select("run_id")
    return own.union(mixes).distinct()


def mark_superseded(rows: DataFrame, runs: DataFrame, why: str, key: str) -> DataFrame:
    """Rows that name a replaced run get a reason, unless they have one."""
    hit = run_parts(rows).join(runs.select(F.col("run_id").alias("part")), "part", "left_semi").select(F.col(key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    joined = rows.join(hit, F.col(key) == F.col("__key"), "left")
    reason = F.when(F.coalesce("superseded", F.lit("")) != "", F.col("superseded")).when(F.col("__hit"), F.lit(why))
    return joined.withColumn("superseded", reason).drop("__key", "__hit")


def retired(rows: DataFrame) -> DataFrame:
    """Run ids of which every row is superseded."""
    return run_parts(rows).groupBy("part").agg(F.bool_and(F.col("superseded").isNotNull()).alias("gone"), F.count(F.lit(1)).alias("n_rows")).where("gone").select(F.col("part").alias("run_id"), "n_rows")


def versus(rows: DataFrame, keys: list[str], a: str, b: str, values: list[str], side: str = "backbone_id") -> DataFrame:
    """Values of two contenders side by side, where both have them (J15): one aggregation, not a self-join."""
    pick = lambda who, v: F.max(F.when(F.col(side) == who, F.col(v)))
    out = rows.groupBy(*keys).agg(*[pick(w, v).alias(f"{v}_{n}") for n, w in (("a", a), ("b", b)) for v in values])
    return out.where(F.col(f"{values[0]}_a").isNotNull() & F.col(f"{values[0]}_b").isNotNull())


def clears(gap: Column) -> Column:
    return gap >= MARGIN - GUARD


def criterion_1(n2: DataFrame, a: str, b: str, heads: list[str], directions: int) -> DataFrame:
    """By head: is ``a`` ahead of ``b`` by the margin on the mean over all directions, and clearly so on two."""
    pairs = versus(n2, ["head", "direction"], a, b, ["value", "ci_low", "ci_high"])
    gap = F.col("value_a") - F.col("value_b")
    clear = clears(gap) & F.coalesce(F.col("ci_low_a") > F.col("ci_high_b"), F.lit(False))
    by = pairs.where(F.col("head").isin(*heads)).groupBy("head").agg(F.count(F.lit(1)).alias("n"), (F.avg("value_a") - F.avg("value_b")).alias("ahead"), F.sum(clear.cast("bigint")).alias("clear"))
    return by.withColumn("won", (F.col("n") == directions) & clears(F.col("ahead")) & (F.col("clear") >= 2))


def criterion_2(n3: DataFrame, a: str, b: str, heads: list[str], held: list[str]) -> DataFrame:
    """Is ``a`` ahead by the margin in every comparison, with all heads and held-out sets among them."""
    pairs = versus(n3, ["head", "held_out", "metric", "train"], a, b, ["value"])
    gap = F.col("value_a") - F.col("value_b")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(clears(gap).cast("bigint")).alias("cleared"),
        (F.count_distinct(F.when(F.col("head").isin(*heads), F.col("head"))) == len(heads)).alias("all_heads"),
        (F.count_distinct(F.when(F.col("held_out").isin(*held), F.col("held_out"))) == len(held)).alias("all_held"),
    ).withColumn("won", (F.col("n") > 0) & (F.col("n") == F.coalesce("cleared", F.lit(0))) & F.col("all_heads") & F.col("all_held"))


def tie_break(n4: DataFrame, a: str, b: str, targets: list[str]) -> DataFrame:
    """Is the probe at least the margin less accurate on ``a`` for every target."""
    pairs = versus(n4.where(F.col("metric").isin(*targets)), ["metric"], a, b, ["value"])
    return pairs.agg((F.coalesce(F.sum(clears(F.col("value_b") - F.col("value_a")).cast("bigint")), F.lit(0)) == len(targets)).alias("won"))


def winner(challenger_won: bool, champion_won: bool, tie_to_challenger: bool) -> str:
    """The verdict."""
    if challenger_won and (not champion_won or tie_to_challenger):
        return "challenger"
    return "champion"


def running_best(history: DataFrame, by: list[str], epoch: str, score: str, patience: int) -> DataFrame:
    """The epoch that early stopping keeps: the first strict best before ``patience`` epochs without one."""
    w = Window.partitionBy(*by).orderBy(epoch)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("better", before.isNull() | (F.col(score) > before))
    rows = rows.withColumn("last", F.max(F.when(F.col("better"), F.col(epoch))).over(w))
    stop = rows.withColumn("stop", F.col(epoch) - F.col("last") >= patience)
    alive = stop.withColumn("over", F.coalesce(F.max(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("over = 0")
    return alive.groupBy(*by).agg(F.max(epoch).alias("stopped_at"), F.max(F.when(F.col("better"), F.col(epoch))).alias("best_epoch"), F.max(score).alias("best"))
