"""The streaming service: a restart, a broken log, and what is logged."""

import json
import shutil

from pyspark.sql import functions as F

from strataforge.functions.vectors import softmax
from strataforge.schemas import REQUESTS
from strataforge.streaming import decisions
from strataforge.streaming import requests as rq

TAU = {0.8: (0.5, 0.3), 0.9: (0.4, 0.6)}


def body(k, sha, coverage=0.9, **more):
    frame = {"frame_uid": f"f{k}", "uri": "a/b.jpg", "sha256": sha, "width": 4, "height": 3}
    meta = {"site_id": "s", "plot_id": f"p{k % 3}", "zone_id": "open", "timestamp_utc": "2024-01-01T00:00:00Z", "pose": {"x": 0, "y": 0, "z": 1.5, "yaw": 0.5, "frame_id": "plot", "source": "rtk"}, "platform": "cart"}
    meta |= {"camera": {"model": "m", "exposure_us": None, "gain": None, "flash": True, "white_balance": "auto"}, "illumination_mode": "flash", "sowing_batch": "b", "bbch": 12}
    return json.dumps({"contract_version": "v0", "frame": frame, "metadata": meta, "request_id": f"q{k}", "options": {"coverage_target": coverage}} | more)


def tables(spark, tmp_path):
    rows = [(1, body(1, "a" * 64)), (2, body(2, "b" * 64)), (3, body(3, "zz")), (4, "no json"), (5, body(5, "a" * 64, 0.77)), (6, body(6, "c" * 64, 0.8)), (1, body(1, "a" * 64))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id bigint, body string").coalesce(1).write.parquet(source)
    features = [("a" * 64, [3.0, 0.0, 0.0], 0.1, "x"), ("a" * 64, [0.0, 9.0, 0.0], 0.1, "y"), ("c" * 64, [3.0, 0.0, 0.0], 0.5, "x")]
    return source, spark.createDataFrame(features, "sha256 string, v array<double>, knn double, cache string")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    source, features = tables(spark, tmp_path)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    requests = lambda: spark.readStream.schema("id bigint, body string").parquet(source)
    for _ in range(2):
        assert decisions.serve(requests(), features, softmax, TAU, 0.9, ["u", "v", "w"], "id", out, marks) == []
        shutil.rmtree(f"{marks}/commits")
    answers = sorted((r.id, r.status, r.top1, r.decision, r.abstain_reason) for r in rq.batches(spark, f"{out}/answers", "id bigint, status int, top1 string, decision string, abstain_reason string").fillna("-").collect())
    assert answers == [(1, 200, "u", "predict", "-")] * 2 + [(2, 501, "-", "-", "-"), (6, 200, "u", "abstain", "far_from_training")]
    bad = {r.id: r.errors for r in rq.batches(spark, f"{out}/quarantine", "id bigint, errors array<string>").collect()}
    assert set(bad) == {3, 4, 5} and bad[3] == ["frame.sha256"] and bad[5] == ["options.coverage_target"]
    log = rq.batches(spark, f"{out}/log", REQUESTS)
    assert log.count() == 7
    r = log.where("request_id = 'q6'").first()
    assert (r.frame_uid, r.plot_id, r.bbch, r.status, r.decision, r.coverage, r.features, r.model_version) == ("f6", "p0", 12, 200, "abstain", 0.8, "cached", "m")
    assert abs(sum(r.scores.values()) - 1) < 1e-9 and r.uncertainty.ood_knn == 0.5 and r.uncertainty.ood_knn_threshold == 0.3
    broken = log.where("request_id = 'q3'").first()
    assert [e.path for e in broken.errors] == ["frame.sha256"] and broken.scores is None and broken.status == 422


def test_answers_are_given_though_the_log_cannot_be_written(spark, tmp_path):
    source, features = tables(spark, tmp_path)
    out = tmp_path / "out"
    out.mkdir()
    (out / "log").write_text("a file where the log's folder should be")
    told = decisions.serve(spark.readStream.schema("id bigint, body string").parquet(source), features.where(F.col("cache") == "x").drop("cache"), softmax, TAU, 0.9, ["u", "v", "w"], "id", str(out), str(tmp_path / "marks"))
    assert len(told) == 1 and "request log not written" in told[0]
    assert rq.batches(spark, f"{out}/answers", "id bigint").count() == 4


def test_requests_are_dealt_to_all_cores(spark, small):
    """One file of events is one task, and checking its requests takes far longer than reading it."""
    from strataforge.plans import gates
    from strataforge.plans.tables import table

    events = table(spark, small, "events").coalesce(1)
    requests = gates._requests(events)
    assert requests.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert requests.count() == events.count() and requests.columns == ["event_id", "body"]
