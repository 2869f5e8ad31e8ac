import json

import numpy as np
import pytest

from strataforge.operators import extract, gates, service
from strataforge.sources.records import read_records, record_files


def test_role_gate(spark):
    rows = spark.createDataFrame([("a", 1, "train_eval"), ("a", 2, "test_only"), ("b", 1, "test_only"), ("c", 1, "train_eval"), ("c", 2, "holdout_unknown"), ("d", 1, None)], "run string, place int, role string")
    assert {(r.run, r.place) for r in gates.role_gate(rows, "run", "place", "role").collect()} == {("b", 1), ("c", 2), ("d", 1)}
    assert {(r.run, r.place) for r in gates.role_gate(rows, "run", "place", "role", allow_test_only=True).collect()} == {("c", 2), ("d", 1)}


@pytest.mark.parametrize("coverages, rows", [([0.8], 5), ([0.8, 0.9], 10), ([0.95], 20), ([0.99], 100)])
def test_slice_needed(coverages, rows):
    assert gates.slice_needed(coverages) == rows


def test_verdict_needs_pairs_and_rows(spark):
    some, none = spark.range(1), spark.range(0)
    assert gates.verdict_refused(some, none) is None
    assert gates.verdict_refused(some, some) == "missing_pairs"
    assert gates.verdict_refused(none, none) == "no_rows"


def test_paths_stay_inside(spark):
    rows = spark.createDataFrame([("/data/a",), ("/data/../b",), ("/database/a",), ("/data/a..b",)], "p string")
    assert [r[0] for r in rows.select(gates.inside(rows["p"], "/data")).collect()] == [True, False, False, True]


def test_shards_compare_nulls(spark):
    rows = spark.createDataFrame([(0, None), (1, None), (2, "x")], "shard int, key string")
    done = spark.createDataFrame([(0, None), (2, "y")], "shard int, key string")
    assert {r.shard for r in gates.shards_left(rows, done, ["key"]).collect()} == {1, 2}


def test_target_names(spark):
    frozen = spark.createDataFrame([("m_v3", "a", "2024"), ("m_v3", "b", "2025")], "manifest string, sha256 string, frozen_at string")
    rows = spark.createDataFrame([("m_v3", "b"), ("m_v3", "a"), ("n_v1", "a")], "manifest string, sha256 string")
    assert [(r.action, r.next_name) for r in gates.target_action(rows, frozen).orderBy("manifest", "sha256").collect()] == [("same", None), ("refuse", "m_v4"), ("write", None)]


def test_extraction_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", [float(k), 1.0]) for k in range(50)], "image_id string, v array<double>")
    path, identity = str(tmp_path / "cache"), {"cache_key": "k", "manifest_sha256": "m"}
    first = rows.where("image_id < 'i3'")
    n = extract.extract(first, lambda x: x * 2, path, identity, shards=8)
    assert n == extract.sharded(first, "image_id", 8).select("shard").distinct().count()
    assert extract.extract(first, lambda x: x * 2, path, identity, shards=8) == 0
    assert {r.image_id: list(r.cls) for r in spark.read.parquet(f"{path}/features").collect()} == {r.image_id: [2 * x for x in r.v] for r in first.collect()}
    # a line of the state is lost: only that shard is done again
    state = spark.read.parquet(f"{path}/state").collect()
    spark.createDataFrame(state[1:], "shard int, cache_key string, manifest_sha256 string, shards string").write.mode("overwrite").parquet(f"{path}/state")
    assert extract.extract(first, lambda x: x * 3, path, identity, shards=8) == 1
    assert spark.read.parquet(f"{path}/features").count() == first.count()
    # another key: all anew
    assert extract.extract(rows, lambda x: x * 5, path, identity | {"cache_key": "other"}, shards=8) == 8
    got = {r.image_id: list(r.cls) for r in spark.read.parquet(f"{path}/features").collect()}
    assert got == {r.image_id: [5 * x for x in r.v] for r in rows.collect()}


def test_grey_phash_by_hand(spark):
    rng = np.random.default_rng(5)
    x = rng.random((32, 32))
    low = np.array([[sum(x[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)])
    scale = np.where(np.arange(8) == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))
    low = low * np.outer(scale, scale)
    bits = "".join("1" if c > np.median(low) else "0" for c in low.ravel())
    assert extract.grey_phash(x) == f"{int(bits, 2):016x}"
    images = spark.createDataFrame([(1, x.ravel().tolist()), (2, None), (3, [1.0])], "id int, pixels array<double>")
    assert [(r.id, r.phash, r.reason) for r in extract.grey_phashes(images, "id", "pixels").orderBy("id").collect()] == [(1, f"{int(bits, 2):016x}", None), (2, None, "not_an_image"), (3, None, "decode_error")]


def test_records_give_reasons(spark):
    rows = [
        ("zenodo", "5", "not json"),
        ("zenodo", "5", "{}"),
        ("mendeley", "x.2", json.dumps({"version": 3, "files": []})),
        ("dataverse", "10.1/x", json.dumps({"status": "ERROR"})),
        ("ftp", "x", "{}"),
        (None, None, None),
        ("zenodo", "5", None),
        ("mendeley", "x.2", json.dumps({"version": 2, "contributors": [{"last_name": "b"}], "files": [{"id": "i", "filename": "f", "size": 3}, {"id": "j", "filename": "g"}]})),
    ]
    out = read_records(spark.createDataFrame(rows, "kind string, pinned string, body string"))
    assert sorted(str(r.reason) for r in out.collect()) == sorted(["not_json", "no_files", "another_version", "bad_status", "unknown_kind", "unknown_kind", "not_json", "None"])
    good = out.where("reason is null")
    assert [(r.creators, r.version) for r in good.collect()] == [(["b"], "2")]
    fields = [{"typeName": "title", "value": "T"}, {"typeName": "author", "value": [{"authorName": {"value": "n, m"}}, {"authorName": {"value": "o"}}]}]
    answer = json.dumps({"status": "OK", "data": {"latestVersion": {"versionNumber": 1, "versionMinorNumber": 2, "metadataBlocks": {"citation": {"fields": fields}}, "files": []}}})
    found = read_records(spark.createDataFrame([("dataverse", "10.1/x", answer)], "kind string, pinned string, body string")).first()
    assert (found.title, found.creators, found.version, found.files) == ("T", ["n, m", "o"], "1.2", [])
    files = record_files(good, ["pinned"]).orderBy("place").collect()
    assert [(f.name, f.size, f.checksum, f.url.rsplit("/", 2)[1]) for f in files] == [("f", 3, None, "i"), ("g", None, None, "j")]


def test_service_without_a_body(spark):
    features = spark.createDataFrame([], "sha256 string, v array<double>, knn double")
    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, "{}")], "n int, body string")
    out = service.predict(rows, features, lambda v: v, {0.9: (0.5, 1.0)}, 0.9, ["a"])
    got = {r.n: r for r in out.collect()}
    assert [got[n].status for n in (1, 2, 3)] == [422, 422, 422] and "request_id" in got[3].errors
    assert out.agg(service.invalid(out)).first()[0] == 3
