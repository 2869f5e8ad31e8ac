"""Thresholds, decisions and temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.vectors import logsumexp
from strataforge.operators.ranks import order_statistics

#: A score whose range is not above this has no threshold to give.
FLAT = 1e-9


def coverage_key(coverage: float) -> str:
    return f"{coverage:.2f}"


def thresholds(rows: DataFrame, coverages: list[float], tpr: float = 0.95, scores: tuple[str, str] = ("conf", "knn")) -> DataFrame:
    """``(coverage, tau_conf, tau_knn, coverage_achieved)`` from a validation slice.

    Quantiles are exact, with linear interpolation, from counts by value in ranges; an
    aggregation counts the rows that the joint rule keeps.
    """
    conf, knn = scores
    ends = rows.agg(F.count(conf).alias("n"), (F.max(conf) - F.min(conf)).alias("range_conf"), (F.max(knn) - F.min(knn)).alias("range_knn")).first()
    if not ends["n"]:
        raise ValueError("no validation rows")
    q = order_statistics(rows, conf, {f"c{i}": 1 - c for i, c in enumerate(coverages)}).first()
    taus, far = [q[f"c{i}"] for i in range(len(coverages))], order_statistics(rows, knn, {"knn": tpr}).first()["knn"]
    flat = ends["range_conf"] <= FLAT or ends["range_knn"] <= FLAT
    kept = [F.avg(((F.col(conf) >= tau) & (F.col(knn) <= far)).cast("double")) for tau in taus]
    table = [F.struct(F.lit(c).alias("coverage"), F.round(F.lit(tau), 6).alias("tau_conf"), F.round(F.lit(far), 6).alias("tau_knn"), F.round(k, 6).alias("coverage_achieved"), F.lit(flat).alias("degenerate")) for c, tau, k in zip(coverages, taus, kept, strict=True)]
    return rows.agg(F.array(*table).alias("t")).select(F.explode("t").alias("t")).select("t.*")


def reason(conf: Column, knn: Column, tau_conf: Column, tau_knn: Column) -> Column:
    """Why a row abstains; null where it predicts. Both comparisons are strict."""
    return F.when(conf < tau_conf, "low_confidence").when(knn > tau_knn, "far_from_training")


def mean_loss(rows: DataFrame, logits: str, y: str, temperatures: list[float]) -> list[float]:
    """The mean negative log-likelihood at several temperatures, in one pass that combines before its shuffle."""
    each = rows.select(logits, y, F.posexplode(F.array(*[F.lit(t) for t in temperatures])).alias("i", "t"))
    scaled = each.select("i", y, F.transform(logits, lambda v: v / F.col("t")).alias("z"))
    loss = scaled.groupBy("i").agg(F.avg(logsumexp(F.col("z")) - F.element_at("z", F.col(y).cast("int") + 1)).alias("l"))
    return [r["l"] for r in loss.orderBy("i").collect()]


def fit_temperature(rows: DataFrame, logits: str, y: str, low: float = 0.01, high: float = 100.0, tolerance: float = 1e-6, probes: int = 40) -> tuple[float, float, float]:
    """(T, loss at 1, loss at T): the least mean loss over log T.

    The loss is unimodal in log T. Each round scores ``probes`` evenly spaced
    temperatures in one aggregation and keeps the neighbourhood of the best, so that four
    rounds reach the tolerance that a golden-section search reaches in forty jobs.
    """
    a, b = math.log(low), math.log(high)
    while b - a > tolerance:
        step = (b - a) / (probes - 1)
        loss = mean_loss(rows, logits, y, [math.exp(a + i * step) for i in range(probes)])
        best = min(range(probes), key=lambda i: loss[i])
        a, b = a + max(best - 1, 0) * step, a + min(best + 1, probes - 1) * step
    t = math.exp((a + b) / 2)
    before, after = mean_loss(rows, logits, y, [1.0, t])
    return round(t, 6), round(before, 6), round(after, 6)
