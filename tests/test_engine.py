"""Operators of the engine on small hand-made tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.functions import scalars, vectors
from strataforge.operators import abstain, dedupe, knn, ledger, metrics, neardup, results, splits, validate
from strataforge.operators.graph import connected_components
from strataforge.session import fresh_path
from strataforge.sources import readers, sinks


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    top = {n: n for e in edges for n in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for n in top}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize(("most", "width"), [(2, 64), (20, 64)])
def test_near_pairs_equal_brute_force(spark, most, width):
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 80, dtype=np.int64)]
    codes += [c ^ 5 for c in codes[:20]] + codes[:3]
    got = rows_of(neardup.near_pairs(spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint"), most, width=width))
    far = lambda a, b: ((codes[a] ^ codes[b]) & ((1 << 64) - 1)).bit_count()
    assert got == [(a, b, far(a, b)) for a in range(len(codes)) for b in range(a + 1, len(codes)) if far(a, b) <= most]


def test_kth_distance_in_slices(spark):
    rng = np.random.default_rng(2)
    bank, x = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id bigint, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.sort(np.linalg.norm(unit(x)[:, None] - unit(bank)[None], axis=2), axis=1)[:, 4]
    for size in (1000, 13):
        got = {r.id: r.knn for r in knn.kth_distance(frame(x), frame(bank), 5, "id", "v", bank_rows=size).collect()}
        assert np.allclose([got[i] for i in range(7)], want)
    with pytest.raises(ValueError):
        knn.kth_distance(frame(x), frame(bank), 51, "id", "v")


def test_gaussians(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 3)), np.arange(60) % 3
    bank = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x, strict=True)], "y int, v array<double>")
    fit = knn.fit_gaussians(bank, "y", "v", 0.01)
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    within = sum((z[y == c] - z[y == c].mean(0)).T @ (z[y == c] - z[y == c].mean(0)) for c in range(3)) / 57
    assert np.allclose(np.linalg.inv(fit.precision), within + 0.01 * np.trace(within) / 3 * np.eye(3))
    assert np.allclose(np.linalg.inv(fit.background_precision) - 0.01 * np.trace(np.cov(z.T)) / 3 * np.eye(3), np.cov(z.T))


def test_auroc_ties_and_ece(spark):
    data = [(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9), (0, 0.5), (1, 0.2)]
    got = metrics.auroc(spark.createDataFrame(data, "y int, v double"), F.col("y") == 1, F.col("v")).first().auroc
    pairs = [(a, b) for ya, a in data for yb, b in data if ya == 1 and yb == 0]
    assert got == pytest.approx(np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs]))
    rows = spark.createDataFrame([(0.0, 0), (1 / 15, 1), (0.5, 1), (1.0, 0)], "c double, ok int")
    assert metrics.ece(rows, "c", F.col("ok") == 1).first().ece == pytest.approx((abs(0.5 - 1 / 30) * 2 + 0.5 + 1.0) / 4)


def test_macro_f1_counts_absent_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, pred int")
    assert metrics.macro_f1(rows, [0, 1, 2]).first().macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)


def test_thresholds_and_reasons(spark):
    rows = spark.createDataFrame([(float(i), float(100 - i)) for i in range(11)], "conf double, knn double")
    t = abstain.thresholds(rows, [0.9]).first()
    assert t.tau_conf == pytest.approx(1.0) and t.tau_knn == pytest.approx(np.quantile([100 - i for i in range(11)], 0.95)) and not t.degenerate
    why = abstain.reason(F.col("conf"), F.col("knn"), F.lit(1.0), F.lit(95.0))
    got = [r.w for r in rows.select(why.alias("w")).collect()]
    assert got == ["low_confidence", *["far_from_training"] * 4, *[None] * 6]


def test_temperature(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(200, 3)) * 5
    y = np.array([rng.choice(3, p=np.exp(r / 3) / np.exp(r / 3).sum()) for r in z])
    t, before, after = abstain.fit_temperature(spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(z, y, strict=True)], "z array<double>, y int"), "z", "y")
    nll = lambda t: np.mean([np.log(np.exp(r / t).sum()) - r[c] / t for r, c in zip(z, y, strict=True)])
    assert after <= before and nll(t) <= min(nll(t * 0.99), nll(t * 1.01)) + 1e-9


def test_argmax_first_wins(spark):
    got = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 1.0, 2.0],)], "z array<double>").select(vectors.argmax(F.col("z")).alias("a")).collect()
    assert [r.a for r in got] == [1, 0]


def test_seed_aggregate_takes_the_last_row(spark):
    rows = [("k", s, 0.1 * s, f"r{s}", s, f"t{s}", True) for s in range(5)] + [("k", 2, 0.9, "r2b", 9, "t9", True), ("j", 0, 1.0, "x", 0, "t", True)]
    got = results.aggregate_seeds(spark.createDataFrame(rows, "key string, seed bigint, value double, run_id string, pos int, ts string, quotable boolean"), ["key"]).collect()
    v = np.array([0, 0.1, 0.9, 0.3, 0.4])
    half = 2.776445 * v.std(ddof=1) / np.sqrt(5)
    assert len(got) == 1 and got[0].run_id == "r0+r1+r2b+r3+r4" and got[0].value == pytest.approx(round(v.mean(), 4)) and got[0].ci_low == pytest.approx(v.mean() - half, abs=1e-4)


def test_verdict():
    assert [results.winner(*x) for x in ((True, False, False), (False, True, True), (True, True, True), (True, True, False), (False, False, True))] == ["challenger", "champion", "challenger", "champion", "champion"]


def test_split_search():
    rng = np.random.default_rng(0)
    for n in (9, 60):
        groups = {f"g{i}": Counter({c: int(rng.integers(1, 9)) for c in "abc"}) for i in range(n)}
        where = splits.assign(groups, 3)
        assert where == splits.assign(groups, 3) and set(where.values()) == {"train", "val", "test"}
        total = sum(sum(g.values()) for g in groups.values())
        share = sum(sum(groups[g].values()) for g, s in where.items() if s == "train") / total
        assert abs(share - 0.7) < 0.08
    with pytest.raises(ValueError):
        splits.assign({"x": Counter(a=1), "y": Counter(a=1)}, 0)


def test_small_split_is_the_best_of_all():
    import itertools

    groups = {f"g{i}": Counter(a=i + 1, b=7 - i) for i in range(6)}
    where = splits.assign(groups, 0)

    def cost(w):
        out = 0.0
        for s, share in (("train", 0.7), ("val", 0.1), ("test", 0.2)):
            for c in "ab":
                t = sum(g[c] for g in groups.values())
                h = sum(groups[g][c] for g, x in w.items() if x == s)
                out += ((h - share * t) / t) ** 2
                if not h:
                    return np.inf
        return out

    best = min(cost(dict(zip(groups, w, strict=True))) for w in itertools.product(("train", "val", "test"), repeat=6))
    assert cost(where) == pytest.approx(best)


def test_purpose_guard(spark):
    rows = spark.createDataFrame([("train",), ("test",)], "split string")
    assert splits.read_split(rows, ["train"], "train").count() == 1
    assert splits.read_split(rows, None, "evaluate").count() == 2
    for wanted in (["test"], None):
        with pytest.raises(PermissionError):
            splits.read_split(rows, wanted, "train")


MUTATIONS = [
    ({"ts": "2024-01-01"}, "bad_value"), ({"number": "N8"}, "bad_number"), ({"metric": "recall:none"}, "bad_metric"), ({"value": float("nan")}, "bad_value"), ({"ci_low": 1.0}, "bad_value"),
    ({"ci_low": 2.0, "ci_high": 1.0}, "bad_value"), ({"n": 0}, "bad_value"), ({"head": ""}, "bad_value"), ({"seed": -1}, "bad_value"), ({"train_manifest": "x+y"}, "bad_hash"), ({"test_split": "cv0"}, "bad_value"),
    ({"split_rule": "test_only+blocked:date"}, "bad_split_rule"), ({"coverage": 0.0}, "bad_value"), ({"classes": []}, "bad_value"), ({"superseded": ""}, "bad_value"), ({"quotable": None}, "bad_value"),
    ({"number": "N3"}, "n3_not_held_out"), ({"test_manifest_sha256": "c" * 64}, "manifest_not_frozen"),
]
GOOD = {
    "row_no": 1, "ts": "2024-01-01T00:00:00Z", "number": "N1", "metric": "recall:a", "value": 0.5, "ci_low": None, "ci_high": None, "n": 3, "backbone_id": "b", "res": 224, "token_type": "cls", "head": "linear",
    "seed": 0, "train_manifest": "x", "train_manifest_sha256": "a" * 64, "train_split": "train", "test_manifest": "y", "test_manifest_sha256": "b" * 64, "test_split": "test",
    "split_rule": "blocked:date+test_only", "coverage": 1.0, "classes": ["a"], "run_id": "r", "model_version": None, "cache_key": None, "quotable": True, "superseded": None, "notes": None,
}


def test_result_rules_by_mutation(spark):
    from pyspark.sql import types as T

    from strataforge.schemas import RESULTS

    schema = T.StructType([T.StructField("row_no", T.LongType()), *RESULTS.fields])
    table = [GOOD | {"row_no": 0}, *[GOOD | change | {"row_no": i} for i, (change, _) in enumerate(MUTATIONS, 1)]]
    rows = spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in table], schema)
    got = {}
    for r in validate.violations(rows, validate.result_rules(["a" * 64, "b" * 64])).collect():
        got.setdefault(r.row_no, set()).add(r.reason)
    assert 0 not in got and all(reason in got.get(i, ()) for i, (_, reason) in enumerate(MUTATIONS, 1))


def test_order_rules(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "c"), (4, "d")], "row_no bigint, image_id string")
    assert rows_of(validate.order_violations(rows, "image_id")) == [("duplicate_image_id", 3, "c"), ("rows_not_sorted", 2, "b")]


def test_append_and_rewrite(spark):
    path = fresh_path(spark, "results")
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "row_no bigint, k string, j int")
    rules = [("bad_value", "k", F.col("k") != "")]
    assert sinks.append_results(rows, path, ["k", "j"], rules, [F.col("row_no")], "row_no") == 2
    assert sinks.append_results(rows, path, ["k", "j"], rules, [F.col("row_no")], "row_no") == 0
    with pytest.raises(ValueError):
        sinks.append_results(spark.createDataFrame([(7, "z", 1), (8, "", 1)], rows.schema), path, ["k", "j"], rules, [F.col("row_no")], "row_no")
    assert spark.read.parquet(path).count() == 2
    other = fresh_path(spark, "table")
    assert sinks.write_if_changed(rows, other) and not sinks.write_if_changed(rows.repartition(3), other) and sinks.write_if_changed(rows.limit(2), other)


def test_freeze(spark):
    frozen = spark.createDataFrame([("m", "d1", "2024"), ("m", "d2", "2025")], "manifest string, sha256 string, frozen_at string")
    assert [sinks.freeze(frozen, m, g, v, u) for m, g, v, u in (("m", "d1", 0, 0), ("m", "d2", 0, 0), ("x", "d", 0, 0), ("m", "d1", 1, 0), ("m", "d1", 0, 1))] == ["same", "conflict", "new", "refused", "refused"]
    assert validate.exit_code(0, False) == 0 and validate.exit_code(3, False) == 2 and validate.exit_code(3, True) == 3


def test_days_and_names(spark):
    one = spark.range(1)
    got = one.select(
        scalars.day_from_millis(F.lit("1609448400000")).alias("a"), scalars.day_from_millis(F.lit("12")).alias("b"), scalars.day_from_iso(F.lit("2020-11-03T23:30:00+03:00")).alias("c"),
        scalars.day_from_iso(F.lit("2020-13-03")).alias("d"), scalars.day_from_exif(F.lit("2021:02:30 1:2:3")).alias("e"), scalars.day_from_exif(F.lit("2021:02:28")).alias("f"),
        scalars.file_stem(F.lit("a/b/c.d.jpg")).alias("g"), scalars.hex_to_bits(F.lit("f000000000000001")).alias("h"),
    ).first()
    assert tuple(got) == ("2021-01-01", None, "2020-11-03", None, None, "2021-02-28", "c.d", -(0xFFFFFFFFFFFFFFF))


def test_dedupe_and_audit(spark):
    rows = spark.createDataFrame([("h", 2, "p2", "x"), ("h", 1, "p1", "x"), ("g", 3, "p3", "x"), ("g", 4, "p4", "y")], "sha string, ord int, path string, label string")
    got = {r.sha: (r.path, r.dup_paths, r.conflict) for r in dedupe.dedupe(rows, "sha", ["ord"], "path", "label").collect()}
    assert got == {"h": ("p1", ["p2"], False), "g": ("p3", ["p4"], True)}
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows_of(dedupe.audit(a, b, "k")) == [(1, "missing"), (3, "unbacked")]


def test_early_stopping(spark):
    h = spark.createDataFrame([("a", i, s) for i, s in enumerate([1.0, 3.0, 3.0, 2.0, 9.0])], "k string, epoch int, score double")
    assert rows_of(results.running_best(h, ["k"], "epoch", "score", 2)) == [("a", 3, 1, 3.0)]


def test_ledger_and_environment(spark):
    rows = spark.createDataFrame([("eval", "NVIDIA", 2.0, "t1"), ("eval", "CPU (x)", 3.0, "t2"), ("env", None, None, "t0")], "step string, device string, wallclock_s double, ts string")
    got = {r.step: (r.n_rows, r.wallclock_s, r.gpu_s, r.cpu_s) for r in ledger.totals(rows).collect()}
    assert got == {None: (3, 5.0, 2.0, 3.0), "eval": (2, 5.0, 2.0, 3.0), "env": (1, 0.0, 0.0, 0.0)}
    assert not ledger.changed_environment(rows.where("step = 'eval'"), {"device": "CPU (x)"}) and ledger.changed_environment(rows, {"device": "other"})


def test_voc_boxes_skip_incomplete(spark):
    xml = "<annotation><object><name>b</name><bndbox><xmin>0.5</xmin><ymin>1.5</ymin><xmax>4</xmax><ymax>5</ymax></bndbox></object><object><name>a</name><bndbox><xmin>x</xmin><ymin>1</ymin><xmax>4</xmax><ymax>5</ymax></bndbox></object></annotation>"
    got = spark.createDataFrame([(xml,), ("<annotation></annotation>",), (None,)], "xml string").select(readers.voc_boxes(F.col("xml")).alias("b")).collect()
    assert [[tuple(b) for b in r.b] for r in got] == [[(0, 2, 4, 3, "b")], [], []]


def test_scan_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.bin").write_bytes(b"hello")
    got = readers.scan_files(spark, str(tmp_path)).select("path", "length", "sha256").collect()
    assert [tuple(r) for r in got] == [("a/b/x.bin", 5, hashlib.sha256(b"hello").hexdigest())]


def test_registered_queries_have_rows(spark, small):
    import __spark_entry__ as entry

    names = {"dedupe_exact", "slice_abstain_recall", "tumbling", "validate_rows"}
    assert names <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
