"""Operators 11 to 13 against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import exact_dedup, hard_negatives, merkle, topk
from tests.llm.test_operators import DOCS

# --- operator 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves):
    """The root, and for each leaf what stands left and right of it on each level."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for path, k in zip(paths, at, strict=True):
            run = k // 3 * 3
            path.append(("".join(level[run:k]), "".join(level[k + 1 : run + 3])))
        level, at = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], paths


def brute_manifest(rows):
    """Rows of doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[s] = own, *brute_tree([brute_leaf(r) for r in own])
    root, tops = brute_tree([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + top
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = brute_leaf((*r[:4], r[4].replace("\n", "") if cut else r[4]))
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], brute_leaf(r), subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return Counter(out)


def manifest_rows(n):
    rng = random.Random(n)
    rows = [(rng.randrange(n), rng.choice(["a", "a", "a", "é", "Z", "", None]), rng.choice(["en", None]), rng.choice([None, 3, -12]), rng.choice([None, "", "x\ny", "é😀\n", "plain", "\n" * 9])) for _ in range(n)]
    return rows + [(None, "a", None, None, None), (None, "a", None, None, "t\n")] + [rows[0]] * 4 + [(n, "lone", "en", 1, "z" * 100_000 + "\n")]


@pytest.mark.parametrize(("n", "levels"), [(60, 1), (150, 2), (40, 7)])
def test_manifest_equals_brute_force(spark, n, levels):
    rows = manifest_rows(n)
    table = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS).withColumn("leaf", F.lit(1)).withColumn("pos", F.lit("x"))
    got = merkle.manifest_digest(table, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = brute_manifest(rows)
    assert Counter(map(tuple, got)) == want
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one_row(spark):
    one = spark.createDataFrame([(5, "a\nb", "en", "s", 3)], DOCS)
    assert merkle.manifest_digest(one.limit(0)).count() == 0
    r = merkle.manifest_digest(one).first()
    assert r.leaf == r.subroot == r.root == brute_leaf((5, "s", "en", 3, "a\nb")) and r.proof_sha256 == sha("")


def test_manifest_paths_prove_their_leaf_alone(spark, small):
    found = merkle.merkle_manifest(spark.read.parquet(f"{small}/documents.parquet"))
    assert found.columns == ["doc_id", "source", "leaf", "other", "subroot", "root", "path"]
    rows = found.collect()
    assert len({r.root for r in rows}) == 1
    for r in rows:
        node, wrong = r.leaf, sha("?")
        for s in r.path:
            node, wrong = sha(s.left + node + s.right), sha(s.left + wrong + s.right)
        assert node == r.root != wrong


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 80, 81, 82, 243, 700, 729])
def test_traversal(leaves):
    nodes = [sha(str(k)) for k in range(leaves)]
    height = merkle.height_of(leaves)
    root, paths = brute_tree(nodes)
    assert merkle.block_root(nodes, height) == root
    steps, most = merkle.Traversal(nodes, height), 0
    for want in paths:
        assert steps.path() == want
        most = max(most, steps.held())
        steps.advance()
    assert most <= 10 * max(height, 1)  # by levels, not by leaves


def test_blocks_that_are_not_full_reach_the_full_height():
    nodes = [sha(str(k)) for k in range(4)]
    want = nodes
    for _ in range(5):
        want = [sha("".join(want[k : k + 3])) for k in range(0, len(want), 3)]
    assert merkle.block_root(nodes, 5) == want[0]
    steps = merkle.Traversal(nodes, 5)
    for node in nodes:
        for a, b in steps.path():
            node = sha(a + node + b)
        assert node == want[0]
        steps.advance()


# --- operator 12


def brute_negatives(rows, positives=5, negatives=3):
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    anchors = {(i, tuple(v), label) for i, v, label in good if i % 50 == 0}
    for i, v, label in anchors:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, w, other in good if j != i)
        near = [(-s, j) for s, j, other in scores if other == label][:positives]
        for p, j in near:
            fit = [(k, -s) for s, k, other in scores if other != label and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, j, r, k, p, s) for r, (k, s) in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("chunk", [100, 2])
def test_hard_negatives_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.choice([-0.5, -0.1, 0.0, 0.2, 0.7, 0.9], 7)], int(rng.integers(0, 3))) for i in range(260)]
    rows += [(300 + i, rows[50][1], i % 4) for i in range(30)] + [(350, None, 1), (400, [float("nan")] * 7, 1), (450, [None] + [1.0] * 6, 1), (500, rows[1][1], None), (None, rows[2][1], 2)]
    rows += [(100, rows[3][1], 2), rows[150], rows[151], (550, [0.5, 0.25], 0), (600, [], 1), (650, [float("inf")] * 7, 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).repartition(5)
    got = hard_negatives.hard_negatives(table, chunk=chunk).collect()
    want = brute_negatives(rows)
    assert Counter(map(tuple, got)) == want
    assert len(want) > 50


def test_hard_negatives_of_close_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((4, 32)) * np.linspace(2, 0.01, 32)
    rows = [(int(i), [float(x) for x in base[i % 4] + 0.1 * rng.standard_normal(32)], int(i % 5)) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    assert Counter(map(tuple, hard_negatives.hard_negatives(table).collect())) == brute_negatives(rows)


def test_hard_negatives_of_large_and_of_no_values(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    rows = [(0, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [3e5 - 1 / 256, 3.0], 1), (3, [2.5e5, 1 / 256], 2), (4, [2.5e5, 0.0], 2)]
    assert Counter(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect())) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError, match="products may pass"):
        hard_negatives.hard_negatives(spark.createDataFrame([*rows, (5, [1e300, 0.0], 2)], schema))


def test_bounds_enclose_products_at_every_cut():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.standard_normal((60, 24)) * np.linspace(1, 0.05, 24))
    rotation = hard_negatives.Rotation(x.T @ x)
    assert np.allclose(rotation.axes @ rotation.axes.T, np.eye(24))
    true = x @ x.T
    low, high = np.quantile(true, 0.9, axis=1), np.quantile(true, 0.97, axis=1)
    i, j = hard_negatives._survivors(rotation, rotation.turned(x), rotation.turned(x), low, high, np.ones((60, 60), bool))
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    inside = {(a, b) for a in range(60) for b in range(60) if low[a] <= true[a, b] <= high[a]}
    assert inside <= found and len(found) < 3000


# --- operator 8, as it shares the products


def test_top_k_of_large_values(spark):
    schema = "vec_id bigint, embedding array<double>"
    rows = [(0, [4e6, 1.0]), (1, [4e6, 1.0]), (2, [4e6, 1.0 + 1 / 256]), (3, [4e6, 0.0]), (4, [-4e6, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:1], schema)).collect()
    whole = {i: [int(256 * x) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[0], whole[i], strict=True)), i) for i in (1, 2, 3, 4))
    assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(-s, i) for s, i in want]
    assert want[0][0] < -(1 << 53)
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([*rows, (5, [1e300, 0.0])], schema), spark.createDataFrame(rows[:1], schema))


# --- operator 13


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        out += [(i, ids[0], len(ids), k == 0, sha(t)) for k, i in enumerate(ids)]
    return Counter(out)


def copy_rows():
    rng = random.Random(7)
    texts = [None, "", " ", "É", "é", "E", "e", "long " * 30_000, "long " * 30_000 + "x", "Long " * 30_000, "same head " * 9 + "a", "same head " * 9 + "b"]
    texts += ["".join(rng.choice("aAbB") for _ in range(rng.choice([1, 2, 3]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    rng.shuffle(rows)
    hot = [(1000 + i, rng.choice(["Hot text of a third of all rows", "hot TEXT of a third of all rows"])) for i in range(150)]
    return rows + hot + [(5000, "one id"), (5000, "One id"), (5000, "one id"), (5000, "another"), (None, "no id"), (None, "no id"), (None, "one id"), (7, "repeated row")] + [(7, "repeated row")] * 40


@pytest.mark.parametrize(("partitions", "batch"), [(4, 2000), (60, 2000), (9, 3)])
def test_exact_duplicates_equal_brute_force(spark, monkeypatch, partitions, batch):
    monkeypatch.setattr(exact_dedup, "BATCH_ROWS", batch)
    rows = copy_rows()
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sha", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("edge", F.lit(1)).repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = exact_dedup.exact_duplicates(table).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(map(tuple, got)) == brute_copies(rows)


def test_exact_duplicates_of_nothing_and_kept_rows(spark):
    schema = "doc_id bigint, text string, lang string"
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "A", "x"), (2, "a", "y"), (2, "a", "y"), (3, None, None), (4, "", "z"), (None, "n", "v"), (5, "É", "w"), (6, "é", "w"), (2, "b", "u")]
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert Counter(map(tuple, kept.collect())) == Counter([(2, "a", "y"), (4, "", "z"), (None, "n", "v"), (5, "É", "w"), (6, "é", "w"), (2, "b", "u")])
    assert exact_dedup.drop_exact_copies(spark.createDataFrame([], schema)).count() == 0


def test_edges_of_the_same_text_in_neighbouring_ranges():
    import pyarrow as pa

    runs = exact_dedup._Runs(3, pa.int64())
    out = []
    for ids, text in (([9, 8], "aa"), ([7, 3], "ab"), ([2], "b")):
        out += list(runs.take(pa.array(ids), pa.array(list(text)), pa.array(list(text))))
    out += list(runs.close(edge=1))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["first"], r["edge"], r["edge_text"]) for r in rows] == [
        (9, 9, 3, True, 6, "a"), (8, 9, 3, False, 6, None), (7, 9, 3, False, 6, None), (3, 3, 2, True, 7, "b"), (2, 3, 2, False, 7, None),
    ]


def test_the_first_run_of_a_range_is_an_edge_in_its_first_batch():
    import pyarrow as pa

    runs = exact_dedup._Runs(0, pa.int64())
    out = list(runs.take(pa.array([5, 4, 9, 3]), pa.array(list("aabc")), pa.array(list("aabc")))) + list(runs.close(edge=1))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["first"], r["edge"], r["edge_text"]) for r in rows] == [(5, 5, 2, True, 0, "a"), (4, 5, 2, False, 0, None), (9, 9, 1, True, None, None), (3, 3, 1, True, 1, "c")]
