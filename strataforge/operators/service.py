"""Decisions for requests: one row for each, in a batch or a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.vectors import argmax, entropy
from strataforge.operators.abstain import reason
from strataforge.operators.dedupe import first_by
from strataforge.operators.frames import envelope_errors, frame_errors, with_request_errors


def one_feature(features: DataFrame, digest: str = "sha256", order: str = "cache") -> DataFrame:
    """One feature row for each digest: that of the first cache by name."""
    return first_by(features, [digest], [F.col(order)])


def request_errors(body: Column, coverages: list[float]) -> Column:
    """Error paths of a request: of its envelope and of the frame in it, sorted."""
    return F.array_sort(F.array_distinct(F.concat(envelope_errors(body, coverages), frame_errors(body, enveloped=True))))


def predict(requests: DataFrame, features: DataFrame, probabilities: Callable[[Column], Column], thresholds: dict[float, tuple[float, float]], default: float, classes: list[str], body: str = "body", full: bool = False) -> DataFrame:
    """``requests`` with ``status, errors, coverage, top1, decision, abstain_reason, max_prob, entropy``.

    422: the request or its frame breaks the contract, with sorted error
    paths. 501: no feature is held for the frame's digest. 200: a prediction, or an
    abstention with its reason. ``features`` has ``sha256``, a vector ``v`` and
    a neighbour distance ``knn``, one row a digest; ``thresholds`` gives the
    two cut-offs of each coverage. Rows that break the contract are not looked up. Columns of ``requests``,
    its order column among them, are kept; repeated requests are each answered. ``full`` adds the ``scores`` by class, ``ood_knn`` and ``ood_knn_threshold``.
    """
    text = F.col(body)
    want = F.try_variant_get(F.try_parse_json(text), "$.options.coverage_target", "double")
    rows = with_request_errors(requests, list(thresholds), body)
    rows = rows.withColumn("coverage", F.when(F.size("errors") == 0, F.round(F.coalesce(want, F.lit(default)), 2)))
    # requests without a digest get keys of their own: they would else meet in one task
    rows = rows.withColumn("__key", F.when(F.size("errors") == 0, F.get_json_object(text, "$.frame.sha256")).otherwise(F.concat(F.lit("-"), F.xxhash64(text).cast("string"))))
    held = features.select(F.col("sha256").alias("__sha"), F.col("v").alias("__v"), F.col("knn").alias("__knn"))
    out = rows.join(held, F.col("__key") == F.col("__sha"), "left")
    out = out.withColumn("status", F.when(F.size("errors") > 0, 422).when(F.col("__v").isNull(), 501).otherwise(200))
    out = out.withColumn("__p", F.when(F.col("status") == 200, probabilities(F.col("__v"))))
    tau = F.create_map(*[x for c, (a, b) in thresholds.items() for x in (F.lit(round(c, 2)), F.struct(F.lit(a).alias("conf"), F.lit(b).alias("knn")))])[F.col("coverage")]
    why = F.when(F.col("status") == 200, reason(F.array_max("__p"), F.col("__knn"), tau["conf"], tau["knn"]))
    names = F.array(*[F.lit(c) for c in classes])
    out = out.withColumn("abstain_reason", why).withColumns(
        {
            "top1": F.when(F.col("status") == 200, F.get(names, argmax(F.col("__p")))),
            "decision": F.when(F.col("status") == 200, F.when(F.col("abstain_reason").isNull(), "predict").otherwise("abstain")),
            "max_prob": F.round(F.array_max("__p"), 6),
            "entropy": F.round(entropy(F.col("__p")), 6),
        }
    )
    if full:
        seen = F.col("status") == 200
        out = out.withColumns({"scores": F.when(seen, F.map_from_arrays(names, "__p")), "ood_knn": F.when(seen, F.col("__knn")), "ood_knn_threshold": F.when(seen, tau["knn"])})
    return out.drop("__key", "__sha", "__v", "__knn", "__p")


def invalid(answers: DataFrame) -> Column:
    """Requests that broke the contract; a frame that can't be answered here is not one."""
    return F.sum((answers["status"] == 422).cast("bigint"))
