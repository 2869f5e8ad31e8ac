"""The pipeline against the brute-force versions of its stages."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strataforge.llm import shingles, simhash
from strataforge.llm.joins import spread_join
from strataforge.operators import graph
from strataforge.session import counted
from tests.llm.test_operators import base_spans, brute_fingerprint, brute_leaks, brute_targets, components, docs


def test_pipeline(spark, small):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, small).collect()
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, r in rows.items() if (w := r.text.lower().split())}
    group = components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = [i for i in rows if group[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute_leaks([(i, rows[i].text) for i in kept], items)}
    kept = [i for i in kept if i not in bad and not base_spans(rows[i].text)]
    sizes = Counter()
    for i in kept:
        sizes[rows[i].source] += len(rows[i].text.split())
    want, taken = brute_targets(dict(sizes)), Counter()
    assert {r.doc_id for r in out} <= set(kept)
    for r in out:
        assert (r.text, r.lang, r.source) == (rows[r.doc_id].text, rows[r.doc_id].lang, rows[r.doc_id].source)
        taken[r.source] += len(r.text.split())
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.1 * sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= max(len(rows[i].text.split()) for i in kept if rows[i].source == s) for s in sizes)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns, name


def near_copies():
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(9)}É{rng.randrange(400)}" for _ in range(150)]
        texts += [" ".join(base), " ".join(base).lower()]
        for edits in (1, 2, 3, 5, 9):
            w = list(base)
            for at in rng.sample(range(150), edits):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    crowd = [f"c{k}" for k in range(120)]
    for _ in range(90):
        w = list(crowd)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 7])):
            w[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return [*texts, "a b c d", "A b  c d", "a b c e", "", " ", None]


@pytest.mark.parametrize("bucket", [2, 64])
def test_near_copies_of_five_word_shingles_go(spark, monkeypatch, bucket):
    monkeypatch.setattr(shingles, "BUCKET", bucket)
    monkeypatch.setattr(shingles, "HUBS", 2)
    rows = list(enumerate(near_copies()))

    def own(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = {i: own(t) for i, t in rows}
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    group = components(sorted(sets), alike)
    assert {r.doc_id for r in simhash.keep_one_of_each(docs(spark, rows)).collect()} == set(group.values())


def test_sketches_decide_with_small_error():
    """At similarity 0.8 a minimum's two bits differ with probability 0.15."""
    from math import exp, lgamma, log

    def tail(n, counts):
        return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(0.15) + (n - k) * log(0.85)) for k in counts)

    assert tail(2048, range(shingles.SURE + 1)) < 1e-8 and tail(2048, range(shingles.FINE_APART + 1, 2049)) < 1e-8
    assert tail(128, range(shingles.APART + 1, 129)) < 2e-8


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Operator 4's index gives candidates of its own, which the exact check judges."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(base[:-1]), " ".join(f"v{k}" for k in range(300)), "a b c d e f", "a b c a b c a b c"]
    codes = [brute_fingerprint(t) for t in texts]
    linked = [(a, b) for a in range(6) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 2]
    assert linked and all(a < 3 for a, _ in linked)
    seen = []
    real = shingles._coded
    monkeypatch.setattr(shingles, "_coded", lambda *a: seen.append(real(*a)) or seen[-1])
    kept = simhash.keep_one_of_each(docs(spark, list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert len(seen) == 1 and len({c for r in seen[0].collect() for c in r}) == 3


def test_finer_sketches_are_compared_by_a_short_plan(spark):
    rng = random.Random(3)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(shingles.FINE)], [rng.getrandbits(64) - (1 << 63) for _ in range(shingles.FINE)]) for _ in range(20)]
    rows += [(rows[0][0], rows[0][0]), (rows[1][0], [rows[1][0][0] ^ 3, *rows[1][0][1:-1], rows[1][0][-1] ^ -(1 << 63)])]
    table = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    found = table.select(shingles._apart("a", "b", shingles.FINE).alias("n"))
    pairs = lambda x, y: sum((x ^ y) >> 2 * k & 3 != 0 for k in range(32))
    assert [r.n for r in found.collect()] == [sum(map(pairs, a, b)) for a, b in rows]
    assert len(found._jdf.queryExecution().analyzed().toString()) < 1000


def test_later_links_are_followed_between_components_only(spark, monkeypatch):
    seen, real = [], shingles.connected_components
    monkeypatch.setattr(shingles, "connected_components", lambda edges: seen.append(edges.count()) or real(edges))
    rng = random.Random(5)
    links = shingles._Links(None, 0.8)
    turns = [[(rng.randrange(60), rng.randrange(60)) for _ in range(25)], [(rng.randrange(90), rng.randrange(90)) for _ in range(20)], [(1, 2)], []]
    every = []
    for turn in turns:
        every += turn
        links._add(spark.createDataFrame(turn, "u bigint, v bigint"))
        ends = sorted({x for e in every for x in e})
        want = components(ends, lambda a, b: (a, b) in every or (b, a) in every)
        got = links.labels.collect()
        assert len(got) == len({r.node for r in got})
        named = {r.node: r.component for r in got}
        assert {x: named.get(x, x) for x in ends} == want
    assert len(seen) == 3 and seen[0] == 25 and seen[1] <= 20 and seen[2] <= 1


def test_near_duplicates_count_no_rows_in_jobs_of_their_own(spark, monkeypatch):
    def refused(self):
        raise AssertionError("rows are counted as they are written")

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:59]), " ".join(words[:58] + ["x"]), "another text " * 9, "", None]
    monkeypatch.setattr(type(spark.range(0)), "count", refused)
    kept = simhash.keep_one_of_each(docs(spark, list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]


def test_rows_are_counted_as_they_are_written(spark):
    for n in (0, 1, 1000):
        rows, seen = counted(spark.range(n).withColumn("x", F.col("id") * 2), "counted")
        assert (rows.count(), seen) == (n, n)
    rows, seen = counted(spark.range(10).where("id > 3").join(spark.range(0), "id"), "counted")
    assert (rows.count(), seen) == (0, 0)


def test_hot_keys_are_found_as_their_counts_are_written(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    for these, salted in ((rows, True), (spark.range(3000).select("id", F.col("id").alias("k")), False), (rows.limit(0), False)):
        table, counts = these.select("k").distinct().withColumn("w", F.col("k") + 1), these.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        out = spread_join(these, table, "k", counts, ["id"])
        assert sorted(map(tuple, out.select("id", "k", "w").collect())) == sorted((r.id, r.k, r.k + 1) for r in these.collect())
        assert ("__salt" in out._jdf.queryExecution().analyzed().toString()) == salted


def test_a_round_of_components_has_its_edges_once_in_the_plan(spark, monkeypatch):
    plans, real = [], graph._round
    monkeypatch.setattr(graph, "_round", lambda edges: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or real(edges))
    edges = [(3, 1), (5, 3), (8, 5), (9, 8), (20, 21), (21, 22), (7, 7)]
    found = graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r.node: r.component for r in found.collect()} == {1: 1, 3: 1, 5: 1, 8: 1, 9: 1, 20: 20, 21: 20, 22: 20, 7: 7}
    assert len(plans) > 2 and all(p.count("Join ") <= 3 for p in plans)
