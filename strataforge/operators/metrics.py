"""Evaluation metrics: each takes a table of scored rows and gives a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.operators.ranks import order_statistics, running


def confusion(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return rows.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def recall_by_class(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return rows.groupBy(y).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(pred) == F.col(y)).cast("double")).alias("recall"))


def f1_by_class(rows: DataFrame, classes: list, y: str = "y", pred: str = "pred") -> DataFrame:
    """F1 for every class of the list, 0 where a class never occurs (A07). One aggregation over (y, pred) counts, then arrays."""
    cells = confusion(rows, y, pred)
    sums = [F.struct(F.lit(c).alias("class"), *[F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(k) for k, cond in (("tp", (F.col(y) == c) & (F.col(pred) == c)), ("fp", (F.col(y) != c) & (F.col(pred) == c)), ("fn", (F.col(y) == c) & (F.col(pred) != c)))]) for c in classes]
    one = cells.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("k")).select("k.*")
    below = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return one.withColumn("f1", F.when(below > 0, 2.0 * F.col("tp") / below).otherwise(0.0))


def macro_f1(rows: DataFrame, classes: list, y: str = "y", pred: str = "pred") -> DataFrame:
    return f1_by_class(rows, classes, y, pred).agg(F.avg("f1").alias("macro_f1"), F.sum(F.col("tp") + F.col("fn")).alias("n"))


def balanced_accuracy(rows: DataFrame, target: str, klass: str, right: Column) -> DataFrame:
    """The mean over targets of the mean over their classes of recall."""
    cell = rows.groupBy(target, klass).agg(F.avg(right.cast("double")).alias("r"))
    return cell.groupBy(target).agg(F.avg("r").alias("r")).agg(F.avg("r").alias("balanced_accuracy"))


def cell_weights(rows: DataFrame, target: str, klass: str) -> DataFrame:
    """1 / (rows of the cell x classes of its target), scaled to mean 1.

    Weights belong to cells, so they are counted in one aggregation; the
    table of cells is small and is joined back by whoever needs rows.
    """
    cell = rows.groupBy(target, klass).agg(F.count(F.lit(1)).alias("n"))
    by = cell.withColumn("classes", F.count(F.lit(1)).over(Window.partitionBy(target)))
    # the weights before scaling add up to 1 for each target
    whole = Window.partitionBy(F.lit(1))
    targets = F.sum(1.0 / F.col("classes")).over(whole)
    return by.select(target, klass, "n", (F.sum("n").over(whole) / (F.col("n") * F.col("classes")) / targets).alias("weight"))


def auroc(rows: DataFrame, positive: Column, value: Column, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with average ranks for ties.

    Counts by value are made first; ranks are then running sums over distinct
    values in ranges, so many equal scores cost one row and no task has all of a group's.
    """
    by = by or []
    counts = rows.groupBy(*by, value.alias("__v")).agg(F.sum(positive.cast("bigint")).alias("p"), F.sum((~positive).cast("bigint")).alias("q"))
    won = running(counts, [F.col("__v")], {"below": F.col("q")}, by).withColumn("u", F.col("p") * (F.col("below") + F.col("q") / F.lit(2.0)))
    sums = won.groupBy(*by).agg(F.sum("u").alias("u"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return sums.select(*by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"), "n_pos", "n_neg")


def ece(rows: DataFrame, confidence: str, right: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins (low, high], the first closed at 0."""
    edges = [float(x) for x in np.linspace(0.0, 1.0, bins + 1)]
    inner = F.array(*[F.lit(x) for x in edges[1:-1]])
    place = F.size(F.filter(inner, lambda e: F.col(confidence) > e))
    by = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def selective(rows: DataFrame, accepted: Column, right: Column, by: list[str] | None = None) -> DataFrame:
    """Risk of accepted rows, abstention rate, and the number of scored rows."""
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(accepted.cast("bigint")).alias("n_accepted"),
        F.avg(F.when(accepted, (~right).cast("double"))).alias("selective_risk"),
        F.avg((~accepted).cast("double")).alias("abstention_rate"),
    )


def class_averaged_loss(rows: DataFrame, y: str, loss: str) -> DataFrame:
    return rows.groupBy(y).agg(F.avg(loss).alias("l")).agg(F.avg("l").alias("loss"))


def percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation (A23, A24), from counts by value in ranges."""
    return order_statistics(rows, value, points, by)


def reported(rows: DataFrame, by: list[str], value: str, coverage: str, reason: str) -> DataFrame:
    """Rows of metrics with ``skipped``: why one has no value below coverage 1 (A11). At coverage 1 such a row is an error."""
    none = F.col(value).isNull()
    bad = rows.where(none & (F.col(coverage) >= 1)).select(*by).limit(1).collect()
    if bad:
        raise ValueError(f"{reason}: {bad[0].asDict()}")
    return rows.withColumn("skipped", F.when(none, F.lit(reason)))


#: Standard deviations (and as many whole answers) about the mean that a table of a binomial has; what lies beyond has a probability below 1e-24.
SPAN = 12.0


def binomial_table(cells: DataFrame, key: list[str]) -> DataFrame:
    """``(key, k, below)``: for cells ``(key, n, ok)`` the probability that at most k of n answers are right, each with probability ok / n.

    The probabilities come from the ratios of neighbouring ones, so no factorial is formed. k is within ``SPAN``
    standard deviations and answers of the mean: about the square root of n rows for a cell. The last k has 1.
    """
    p = F.col("ok") / F.col("n")
    wide = SPAN * F.sqrt(F.col("n") * p * (1 - p)) + SPAN
    sure = (F.col("ok") == 0) | (F.col("ok") == F.col("n"))
    low = F.when(sure, F.col("ok")).otherwise(F.greatest(F.lit(0), F.floor(F.col("ok") - wide))).cast("bigint")
    high = F.when(sure, F.col("ok")).otherwise(F.least(F.col("n"), F.ceil(F.col("ok") + wide))).cast("bigint")
    rows = cells.withColumns({"__lo": low, "__hi": high}).withColumn("k", F.explode(F.sequence("__lo", "__hi")))
    step = F.when(F.col("k") > F.col("__lo"), F.log((F.col("n") - F.col("k") + 1) * F.col("ok") / (F.col("k") * (F.col("n") - F.col("ok"))))).otherwise(0.0)
    cell = Window.partitionBy(*key)
    upto = cell.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = rows.withColumn("__l", F.sum(step).over(upto))
    mass = logs.withColumn("__m", F.exp(F.col("__l") - F.max("__l").over(cell)))
    below = F.when(F.col("k") == F.col("__hi"), 1.0).otherwise(F.sum("__m").over(upto) / F.sum("__m").over(cell))
    return mass.select(*key, "k", below.alias("below"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits that only its parts decide: the head of the MD5 of their text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def bootstrap(rows: DataFrame, target: str, klass: str, right: Column, seed: int, draws: int = 1000) -> DataFrame:
    """``(value, ci_low, ci_high)``: balanced accuracy with a 95 % interval; right answers are drawn anew within each cell.

    Only counts by cell are drawn from: the number of right answers is binomial, and is read off the cell's table at a
    number that seed, draw, target and class decide, so tasks need no generator and a rerun draws the same. Numbers and
    table are put in one order instead of being joined by range: work is cells x (draws + sqrt(n)). Rows without a
    target or class are left out; an answer that is null counts as wrong. Without rows all three are null.
    """
    key = [target, klass]
    answers = rows.where(F.col(target).isNotNull() & F.col(klass).isNotNull())
    cells = answers.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(right, F.lit(False)).cast("bigint")).alias("ok"))
    table = binomial_table(cells, key).select(*key, F.col("below").alias("at"), F.lit(1).alias("kind"), "k", F.lit(None).cast("int").alias("draw"))
    drawn = cells.select(*key, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    points = drawn.select(*key, uniform(F.lit(seed), F.col("draw"), F.col(target), F.col(klass)).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("k"), "draw")
    # the least k whose probability reaches the number is the next entry of the table
    ahead = Window.partitionBy(*key).orderBy("at", "kind", "k").rowsBetween(0, Window.unboundedFollowing)
    taken = table.unionByName(points).withColumn("k", F.first("k", ignorenulls=True).over(ahead)).where("kind = 0").select(*key, "draw", "k")
    recall = taken.join(cells.select(*[F.col(c).alias(f"__{c}") for c in key], "n"), (F.col(target) == F.col(f"__{target}")) & (F.col(klass) == F.col(f"__{klass}"))).withColumn("r", F.col("k") / F.col("n"))
    by_draw = recall.groupBy("draw", target).agg(F.avg("r").alias("r")).groupBy("draw").agg(F.avg("r").alias("r"))
    ends = by_draw.agg(F.percentile("r", F.lit(0.025)).alias("ci_low"), F.percentile("r", F.lit(0.975)).alias("ci_high"))
    value = cells.groupBy(target).agg(F.avg(F.col("ok") / F.col("n")).alias("r")).agg(F.avg("r").alias("value"))
    return value.crossJoin(F.broadcast(ends))  # one row each
