"""Ranges, configurations, caches, near copies and draws by hand-made cases."""

import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataforge import plans
from strataforge.operators import caches, configs, dedupe, knn, metrics, ml, neardup, ordering, ranks, splits, validate
from strataforge.operators.graph import connected_components
from strataforge.schemas import FROZEN, LEDGER
from strataforge.sources import sinks


def test_running_sums_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(300)]
    got = {r.i: r.before for r in ranks.running(spark.createDataFrame(rows, "g string, i int, x int").repartition(7), [F.col("i")], {"before": F.col("x")}, ["g"]).collect()}
    assert got == {i: sum(x for h, j, x in rows if h == g and j < i) for g, i, _ in rows}
    numbers = ranks.numbered(spark.createDataFrame(rows, "g string, i int, x int"), [F.col("i").desc()]).collect()
    assert {r.i: r.row_no for r in numbers} == {i: 300 - i for _, i, _ in rows}
    assert ranks.numbered(spark.createDataFrame([], "i int"), [F.col("i")]).count() == 0


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=500), 1)
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 10.0), ("c", None)], "g string, v double")
    got = {r.g: r for r in metrics.percentiles(rows, ["g"], "v", {"p10": 0.1, "p95": 0.95}).collect()}
    assert got["a"].p10 == pytest.approx(np.percentile(x, 10)) and got["a"].p95 == pytest.approx(np.percentile(x, 95))
    assert got["b"].p10 == pytest.approx(1.3) and "c" not in got


def test_configs():
    good = {"k": 20, "ece_bins": 15, "coverages": [0.8, 0.9], "distance_tpr": 0.95, "default_coverage": 0.9, "epsilon": 1e-3, "n3": [{"manifest": "m", "classes": ["x"]}]}
    assert configs.abstain_config(good) is good
    for change, problem in (({"k": True}, "k must"), ({"k": 0}, "k must"), ({"ece_bins": 1.5}, "ece_bins"), ({"coverages": []}, "coverages"), ({"coverages": [1]}, "coverages"), ({"default_coverage": 0.5}, "not declared"), ({"n3": [{}]}, "n3"), ({"more": 1}, "more is unknown"), ({"epsilon": float("nan")}, "epsilon")):
        with pytest.raises(configs.ConfigError, match=problem):
            configs.abstain_config(good | change)
    with pytest.raises(configs.ConfigError, match="epsilon lacks"):
        configs.abstain_config({k: v for k, v in good.items() if k != "epsilon"})
    with pytest.raises(configs.ConfigError):
        configs.abstain_config([])


def test_cache_key(spark):
    import hashlib
    import json

    fields = ["dino é ü\u2028 😀 \x7f \x1f\n\t", 'we"ig\\hts', 224, "", "float32"]
    row = spark.createDataFrame([tuple(fields)], "backbone_id string, weights_sha256 string, resolution int, preprocess_string string, compute_dtype string")
    got = row.select(caches.cache_key({c: F.col(c) for c in row.columns})).first()[0]
    assert got == hashlib.sha256(json.dumps(fields).encode()).hexdigest()[:16]


def test_near_copies_by_class(spark):
    rng = random.Random(2)
    codes = [rng.getrandbits(63) for _ in range(40)]
    codes += [c ^ (1 << rng.randrange(63)) for c in codes[:10]] + codes[:7] * 3
    rows = list(enumerate(codes))
    first = {}
    for i, c in rows:
        first.setdefault(c, i)
    for most in (2, 20):
        want = {(min(a, b), max(a, b)) for x, a in first.items() for y, b in first.items() if a != b and (x ^ y).bit_count() <= most}
        got = [(r.a, r.b) for r in neardup.near_class_pairs(spark.createDataFrame(rows, "id bigint, code bigint"), most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bank_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    bank, rows = rng.normal(size=(50, 4)), rng.normal(size=(9, 4))
    b = spark.createDataFrame([(v.tolist(),) for v in bank], "v array<double>").repartition(5)
    r = spark.createDataFrame([(1, v.tolist()) for v in rows], "id int, v array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted(np.sort(np.linalg.norm(unit(rows)[:, None] - unit(bank)[None], axis=2), axis=1)[:, 6].tolist())
    for size in (1000, 7):
        assert sorted(x.knn for x in knn.kth_distance(r, b, 7, "id", "v", size).collect()) == pytest.approx(want)
    with pytest.raises(ValueError):
        knn.kth_distance(r, b, 51, "id", "v")


def test_draws_of_classes_are_alike(spark):
    rows = spark.range(1001).select(F.col("id"), F.when(F.col("id") == 1000, "rare").otherwise("many").alias("y"))
    got = ml.balanced_draw(rows, "y", 501, 3, "id").join(rows, "id").groupBy("y").agg(F.sum("times").alias("n")).collect()
    assert {r.y: r.n for r in got} == {"many": 251, "rare": 250}


def test_many_groups_are_dealt_close_to_the_targets(spark):
    rng = np.random.default_rng(5)
    groups = {f"g{i:03d}": Counter({c: int(n) for c in "abcd" if (n := rng.integers(0, 30) * (rng.random() < 0.7))}) for i in range(120)}
    groups = {g: c for g, c in groups.items() if c}
    where = splits.assign(groups, 1)
    for c in "abcd":
        total = sum(g[c] for g in groups.values())
        for s, share in splits.TARGETS.items():
            assert abs(sum(g[c] for k, g in groups.items() if where[k] == s) / total - share) < 0.02
    assert where == splits.assign(groups, 1)


def test_large_groups_of_copies_stay_rows(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "PATHS", 3)
    rows = spark.createDataFrame([("x", i, f"p{i}", "a") for i in range(5)] + [("y", 9, "q", "a"), ("z", 10, "r", "a"), ("z", 11, "s", "b")], "d string, i int, path string, y string")
    got = {r.d: (r.path, r.dup_paths, r.conflict) for r in dedupe.dedupe(rows, "d", ["i"], "path", "y").collect()}
    assert got == {"x": ("p0", None, False), "y": ("q", [], False), "z": ("r", ["s"], True)}
    assert dedupe.duplicate_paths(rows, "d", ["i"], "path").count() == 5


def test_fields_in_order(spark):
    rows = spark.createDataFrame([("h", "n", 1)], "sha256 string, manifest string, more int")
    out = validate.in_order(rows, FROZEN)
    assert out.columns == [f.name for f in FROZEN.fields] and tuple(out.first()) == ("n", "h", None, None)
    both = ordering.union_in_order([rows, rows.drop("more")])
    assert [(r.source_no, r.more) for r in both.orderBy("source_no").collect()] == [(0, 1), (1, None)]


def test_metric_without_rows_is_an_error_at_full_coverage(spark):
    rows = spark.createDataFrame([("a", None, 1.0)], "g string, v double, c double")
    with pytest.raises(ValueError, match="no row"):
        metrics.reported(rows, ["g"], "v", "c", "no row")


def test_ledger_takes_all_rows_or_none(spark, tmp_path):
    path = str(tmp_path / "ledger")
    kind = "step string, ts string, wallclock_s double"
    good = spark.createDataFrame([("env", "2024-01-01T00:00:00Z", None), ("eval", "2024-01-01T00:00:01Z", 2.0)], kind)
    sinks.append_ledger(good, path)
    for bad in (("other", "2024-01-01T00:00:00Z", 1.0), ("env", "today", 1.0), ("env", "2024-01-01T00:00:00Z", -1.0), ("env", "2024-01-01T00:00:00Z", float("nan")), (None, None, None)):
        with pytest.raises(ValueError, match="bad_value"):
            sinks.append_ledger(good.union(spark.createDataFrame([bad], kind)), path)
    sinks.append_ledger(good, path)
    held = spark.read.parquet(path)
    assert held.columns == [f.name for f in LEDGER.fields] and held.count() == 4


def test_request_log_of_a_batch_that_runs_again(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *ids: spark.createDataFrame([(i, 200) for i in ids], "request_id string, status bigint")
    for batch, ids in ((0, "ab"), (1, "c"), (1, "cd")):
        assert sinks.append_requests(rows(*ids), path, batch) is None
    assert sorted(r.request_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]
    (tmp_path / "file").write_text("")
    assert "request log not written" in sinks.append_requests(rows("a"), str(tmp_path / "file"), 0)


def test_repeated_wanted_rows_are_answered_each_time(spark):
    held = spark.createDataFrame([("a", "b1", "k1"), ("b", "b2", "k2"), ("c", "b2", "k3")], "path string, backbone_id string, cache_key string")
    wanted = spark.createDataFrame([("b1", None), ("b1", None), ("b2", None), ("b2", "k3"), ("b9", None), (None, None)], "backbone_id string, cache_key string")
    got = sorted(tuple(r) for r in caches.find_caches(held, wanted, ["backbone_id"]).fillna("-").collect())
    assert got == sorted([("b1", "-", "found", "a")] * 2 + [("b2", "-", "ambiguous", "-"), ("b2", "k3", "found", "c"), ("b9", "-", "not_found", "-"), ("-", "-", "not_found", "-")])


def test_shown_items_count_distinct_ones(spark):
    from strataforge.operators import ordering

    rows = spark.createDataFrame([("g", x) for x in "ddabbcce"] + [("h", "z")] * 4, "g string, item string")
    assert sorted(tuple(r) for r in ordering.shown(rows, ["g"], "item", 3).collect()) == [("g", 8, "a, b, c", 2), ("h", 4, "z", 0)]


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    import shutil

    from strataforge.streaming import requests as rq

    source = str(tmp_path / "in")
    spark.range(10).select(F.col("id"), F.timestamp_seconds(F.col("id") * 1000).alias("ts")).coalesce(1).write.parquet(source)
    rows = lambda: spark.readStream.schema("id bigint, ts timestamp").parquet(source)
    good, bad, late, marks = (str(tmp_path / k) for k in ("good", "bad", "late", "marks"))
    errors = F.when(F.col("id") % 3 == 0, F.array(F.lit("id"))).otherwise(F.array().cast("array<string>"))
    for _ in range(2):  # the second time the batch's commit is lost
        rq.quarantine(rows(), errors, good, bad, marks)
        shutil.rmtree(f"{marks}/commits")
    assert rq.batches(spark, good, "id bigint").count() == 6 and rq.batches(spark, bad, "id bigint").count() == 4
    spark.createDataFrame([(100, 1)], "id bigint, s bigint").select("id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    rq.late_rows(rows(), "ts", 60, late, f"{marks}-late")
    assert rq.batches(spark, late, "id bigint").count() <= 1


def test_names_of_blocks_do_not_move_with_groups(spark, monkeypatch):
    """1,500 districts that one day links: a name of 97 KB, which each of 1,501 groups would else take through a shuffle."""
    whole = spark.range(1501).select("id", F.when(F.col("id") < 1500, F.sha2(F.col("id").cast("string"), 256)).alias("district"), F.lit("2024-01-01").alias("day"), F.col("id").alias("grp"))
    moved = lambda: sum(e.totalShuffleWrite() for e in _listed(spark._jsc.sc().statusStore().executorList(False)))
    names = []
    for limit in (splits.NAME_BYTES, 0):
        monkeypatch.setattr(splits, "NAME_BYTES", limit)
        before = moved()
        names.append({(r.split_group, r.split_rule) for r in splits.blocks(whole, "district").select("split_group", "split_rule").distinct().collect()})
        assert limit == 0 or moved() - before < 20 << 20
        assert splits.blocks(whole.where("id < 0"), "district").collect() == []
    assert len(names[0]) == 1 and names[0] == names[1]
    name, rule = names[0].pop()
    assert rule == "blocked:district" and name == "district:" + "+".join(sorted(r.district for r in whole.where("id < 1500").collect()))


def test_cells_of_a_grid_are_dealt(spark, monkeypatch):
    rng = random.Random(9)
    codes = list({rng.getrandbits(62) for _ in range(80)})
    far = lambda x, y: (x ^ y).bit_count()
    monkeypatch.setattr(neardup, "CELL", 16)
    monkeypatch.setattr(neardup, "SLICE", 3)
    rows = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    found = neardup.near_class_pairs(rows, 25)
    assert found.rdd.getNumPartitions() == 15  # one for each cell of half a grid, however few its bytes are
    want = sorted((a, b, far(x, codes[b])) for a, x in enumerate(codes) for b in range(a + 1, 80) if far(x, codes[b]) <= 25)
    assert sorted(map(tuple, found.collect())) == want
    between = neardup.near_between(rows.where("id % 2 = 0"), rows.where("id % 2 = 1 or id = 4"), 25)
    assert sorted(map(tuple, between.collect())) == sorted((a, b, far(codes[a], codes[b])) for a in range(0, 80, 2) for b in (4, *range(1, 80, 2)) if far(codes[a], codes[b]) <= 25)
    assert neardup.near_class_pairs(rows.where("id < 0"), 25).collect() == []


def test_distances_are_made_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bank, x = rng.normal(size=(900, 8)), rng.normal(size=(700, 8))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = None
    for at in range(0, 900, 400):
        near = np.concatenate([knn._least(unit(x)[i : i + 50], unit(bank)[at : at + 400], 20, None if near is None else near[i : i + 50]) for i in range(0, 700, 50)])
    want = np.sort(np.linalg.norm(unit(x)[:, None] - unit(bank)[None], axis=2), axis=1)[:, 19]
    assert near.shape == (700, 20) and np.allclose(np.sqrt(near.max(axis=1)), want)
    monkeypatch.setattr(knn, "DISTANCES", 5000)
    monkeypatch.setattr(knn, "WORK", 100_000)
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id bigint, v array<double>").coalesce(1)
    found = knn.kth_distance(frame(x), frame(bank), 20, "id", "v", 400)
    assert found.rdd.getNumPartitions() == 7
    assert np.allclose([d for _, d in sorted(map(tuple, found.collect()))], want)


def test_a_file_of_the_bank_is_no_larger_than_a_block(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(knn, "fresh_path", lambda spark, label: (tmp_path / label).as_uri())
    rng = np.random.default_rng(5)
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id bigint, v array<double>").coalesce(1)
    bank, x = rng.normal(size=(900, 8)), rng.normal(size=(30, 8))
    found = dict(map(tuple, knn.kth_distance(frame(x), frame(bank), 20, "id", "v", 400).collect()))
    assert sorted(pq.read_metadata(f).num_rows for f in (tmp_path / "bank").glob("*.parquet")) == [100, 400, 400]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.sort(np.linalg.norm(unit(x)[:, None] - unit(bank)[None], axis=2), axis=1)[:, 19]
    assert np.allclose([found[i] for i in range(30)], want)


def test_memory_of_distances_does_not_grow(spark, monkeypatch):
    made = []
    kind, real = type(spark.range(0)), type(spark.range(0)).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: made.append(f) or real(self, f, *a, **b))
    rng = np.random.default_rng(6)
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id bigint, v array<double>").coalesce(1)

    def peak(n):
        x = rng.normal(size=(n, 4))
        knn.kth_distance(frame(x), frame(rng.normal(size=(2 * n, 4))), 20, "id", "v")
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(x.tolist())], names=["id", "v"])
        tracemalloc.start()
        assert sum(b.num_rows for b in made[-1](iter([batch]))) == n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(3000) < 1.5 * peak(1500)  # four times the distances


def test_links_of_blocks_go_with_values_and_days(spark, monkeypatch):
    """60,000 rows in 20,000 groups and 100 districts, of which 15 share a day with a row without a district: one group alone is a node."""
    k = F.col("id")
    whole = spark.range(60_000).select("id", F.when(k % 600 != 0, F.expr("id div 600")).alias("district"), F.when(k % 600 == 1, F.expr("id div 600 % 7")).when(k == 600, F.lit(1)).alias("day"), F.expr("id div 3").alias("grp"))
    links = []
    monkeypatch.setattr(splits, "connected_components", lambda edges: links.append(edges.count()) or connected_components(edges))
    got = {r.id: r.split_group for r in splits.blocks(whole, "district").collect()}
    assert len(got) == 60_000 and links[0] < 200
    joined = sorted(str(x) for x in range(1, 100, 7))
    assert got[600] == "district:" + "+".join(joined)
    assert all(v == (got[600] if str(x // 600) in joined else f"district:{x // 600}") for x, v in got.items())


def test_blocks_of_odd_rows_are_those_of_the_sql(spark):
    """Groups of several districts, of none, of null; days without a row of either kind, or whose only row without a district has no group."""
    rng = random.Random(4)
    some = lambda share, x: x if rng.random() < share else None
    given = [(k, some(0.6, f"d{rng.randrange(250)}"), some(0.25, f"t{rng.randrange(150)}"), some(0.9, f"g{rng.randrange(300)}")) for k in range(400)]
    given += [(400, "x1", "t99", "gx1"), (401, "x2", "t99", "gx2"), (402, None, "t99", None), (403, "x1", None, "gx1"), (404, "x2", None, "gx2")]
    plans.load()
    sql = plans.SQL["blocks"]
    rows_ = pa.table(dict(zip(("id", "district", "day", "grp"), map(list, zip(*given, strict=True)), strict=True)))
    want = duckdb.sql("with recursive " + sql[sql.index("edges as") :]).fetchall()
    got = [tuple(r) for r in splits.blocks(spark.createDataFrame(given, "id bigint, district string, day string, grp string"), "district").collect()]
    null_last = lambda r: (r[0], r[1] is None, r[1], r[2])
    assert sorted(got, key=null_last) == sorted(want, key=null_last)
    assert len({r[1] for r in want if r[2] == "blocked:district" and "+" in r[1]}) > 5


def _listed(found):
    return [found.apply(k) for k in range(found.size())]
