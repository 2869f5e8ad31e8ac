"""The decision service over a stream: contract, scores, decisions, quarantine and log of each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.service import one_feature, predict
from strataforge.schemas import REQUESTS
from strataforge.sources.sinks import append_requests
from strataforge.streaming.requests import put_batch

ANSWER = ("status", "coverage", "top1", "decision", "abstain_reason", "max_prob", "entropy")


def log_rows(answers: DataFrame, model_version: str, run_id: str, body: str = "body") -> DataFrame:
    """Answers as rows of the request log: what was asked, as far as it can be read, and what was said."""
    v = F.try_parse_json(F.col(body))
    get = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    asked = {
        "ts": get("metadata.timestamp_utc"), "request_id": get("request_id"), "frame_uid": get("frame.frame_uid"), "frame_sha256": get("frame.sha256"), "uri": get("frame.uri"), "site_id": get("metadata.site_id"),
        "plot_id": get("metadata.plot_id"), "zone_id": get("metadata.zone_id"), "timestamp_utc": get("metadata.timestamp_utc"), "platform": get("metadata.platform"), "bbch": get("metadata.bbch", "bigint"), "bbch_null_reason": get("metadata.bbch_null_reason"),
    }
    seen = F.col("status") == 200
    doubt = F.struct(F.col("max_prob"), F.col("entropy"), F.col("ood_knn"), F.col("ood_knn_threshold"), F.lit(None).cast("double").alias("ood_maha"))
    said = {
        "model_version": F.lit(model_version), "run_id": F.lit(run_id), "coverage": F.col("coverage"), "decision": F.col("decision"), "abstain_reason": F.col("abstain_reason"), "top1": F.col("top1"), "scores": F.col("scores"),
        "uncertainty": F.when(seen, doubt), "features": F.when(seen, F.lit("cached")), "status": F.col("status").cast("bigint"), "timing_ms": F.lit(None).cast("map<string,double>"),
        "errors": F.transform("errors", lambda e: F.struct(e.alias("path"), F.lit("breaks the contract").alias("message"))), "warnings": F.array().cast("array<string>"),
    }
    return answers.select(*[{**asked, **said}[f.name].cast(f.dataType).alias(f.name) for f in REQUESTS.fields])


def serve(requests: DataFrame, features: DataFrame, probabilities: Callable[[Column], Column], thresholds: dict[float, tuple[float, float]], default: float, classes: list[str], key: str, out: str, marks: str, model_version: str = "m", run_id: str = "r", body: str = "body") -> list[str]:
    """Answers a stream of requests; gives the warnings of batches whose log could not be written.

    Of each batch, requests that keep the contract are answered below ``out/answers``, those that break it go with their
    error paths to ``out/quarantine``, and all of them are logged below ``out/log``. Each of these has a folder for each
    batch, so one that runs again after a failure replaces what it wrote. Of several caches that hold a
    frame the first by name answers (``features`` has a column ``cache`` then). A batch is scored once, in one plan. Read with ``streaming.requests.batches``.
    """
    held = one_feature(features) if "cache" in features.columns else features
    told: list[str] = []

    def answer(batch: DataFrame, n: int) -> None:
        answers = predict(batch.select(key, body), held, probabilities, thresholds, default, classes, body, full=True).persist()
        try:
            put_batch(answers.where("status <> 422").select(key, *ANSWER), f"{out}/answers", n)
            put_batch(answers.where("status = 422").select(key, "status", "errors", body), f"{out}/quarantine", n)
            if warning := append_requests(log_rows(answers, model_version, run_id, body), f"{out}/log", n):
                told.append(warning)
        finally:
            answers.unpersist()

    requests.writeStream.foreachBatch(answer).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return told
