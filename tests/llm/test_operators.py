"""Each operator against a brute-force version on small tables with nulls, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strataforge.llm import decontaminate, language, licences, maintext, mixing, quality, secrets, simhash, topk, warc
from strataforge.session import fresh_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, lang=None, source=None, extra=""):
    rows = [(i, t, (lang or {}).get(i, "en"), (source or {}).get(i, "s"), len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


# --- operator 1


def base_spans(text):
    out = []
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, (kind, p, group, least) in enumerate((("assign", pattern, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))):
        for m in re.finditer(p, text, re.A):
            if len(m[group]) >= least:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


HEX = "0123456789abcdef" * 3
SECRET_TEXTS = [
    None, "", "nothing here", "token=secret: abcdefghij", "API_KEY = 'abcdefgh1'", 'x passwd: "short"', "é😀 Token=" + HEX, "AKIA" + "B" * 12 + " AKIA1", "AKIAAKIA" + "Z" * 9,
    HEX[:31] + "g" + HEX, "password=password=longenough1 apikey:zzzzzzzz", " ".join(f"token={i:08d}" for i in range(700)), "secret" * 50, "token\n=abcdefghi",
]


def test_secrets_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(SECRET_TEXTS * 3)] + [(3, SECRET_TEXTS[6]), (None, SECRET_TEXTS[4])]
    table = docs(spark, rows).withColumn("blob_id", F.lit(1)).withColumn("findings", F.lit("x"))
    got = secrets.secret_digest(secrets.scan_secrets(table)).collect()
    want = Counter((i, base_spans(t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.spans) for r in got) == want
    for r in got:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert r.n_assign == r.spans.count("assign:") and r.n_hex == r.spans.count("hex:") and r.n_access == r.spans.count("access:")


def test_secret_ledger_is_incremental(spark):
    ledger = fresh_path(spark, "ledger")
    first = docs(spark, [(1, "token=abcdefgh1"), (2, "clean")])
    secrets.scan_secrets(first, ledger).collect()
    n = secrets.read_ledger(spark, ledger).count()
    again = docs(spark, [(7, "token=abcdefgh1"), (8, "clean"), (9, "new AKIA" + "Q" * 12)])
    got = {r.id: secrets_of(r) for r in secrets.scan_secrets(again, ledger).collect()}
    assert n == 2 and secrets.read_ledger(spark, ledger).count() == 3
    assert got == {7: ["assign"], 8: [], 9: ["access"]}
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", r"c[a-z]{4}", 0, 5, version=2))
    got = {r.id: secrets_of(r) for r in secrets.scan_secrets(again, ledger, rules=newer).collect()}
    assert secrets.read_ledger(spark, ledger).count() == 6 and got[8] == ["hex"] and got[7] == ["assign", "hex"]


def secrets_of(r):
    return [x.kind for x in r.findings]


# --- operator 2


def test_licences(spark):
    noise = "the and of to in a is was on for with that by this from it at as are be"
    lines = [(i, f"{noise} {i}\n{noise}") for i in range(40)]
    lines += [(100, f"{noise}\nReleased under the MIT License.\n{noise}"), (101, "Licensed under CC BY-NC 4.0."), (102, None), (103, ""), (104, "he was licensed to drive the bus"), (105, "This work is licensed under the GNU General Public License, version 3."), (105, "This work is licensed under the GNU General Public License, version 3.")]
    got = Counter((r.doc_id, r.family, tuple(r.notices)) for r in licences.scan_licences(docs(spark, lines).withColumn("family", F.lit(0))).collect())
    found = {k: v for k, v in got.items() if k[1] != "unknown"}
    assert found == {(100, "mit", (1,)): 1, (101, "cc-by-nc", (0,)): 1, (105, "gpl", (0,)): 2}
    assert sum(got.values()) == len(lines)
    assert licences.scan_licences(docs(spark, [])).count() == 0


def test_wrapped_and_short_licences(spark):
    noise = "the and of to in a is was on for with that by this from it at as are be"
    rows = [(i, f"{noise} {i}\n{noise}") for i in range(40)]
    long = [(f, t) for f in ("mit", "bsd", "gpl", "isc") for t in licences.TEMPLATES[f] if len(t) > 120]
    rows += [(100 + i, "\n".join([noise, "", *textwrap.wrap(t, 45), "", noise])) for i, (_, t) in enumerate(long)]
    rows += [(200 + i, "\n".join([noise, *textwrap.wrap(t, 75), noise])) for i, (_, t) in enumerate(long)]
    rows += [(300, f"{noise}\nAll rights reserved.\n{noise}"), (301, "Permission is\n\nhereby\n\ngranted")]
    got = {r.doc_id: (r.family, r.n_notices) for r in licences.scan_licences(docs(spark, rows)).collect() if r.family != "unknown"}
    want = {k + i: (f, 1) for i, (f, _) in enumerate(long) for k in (100, 200)}
    assert got == want | {300: ("proprietary", 1)}


# --- operators 3 and 6


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_scores(table, labels)
    both = got.join(labels, "doc_id").where("held_out and quality is not null").select(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("acc")).first()
    assert both.acc > 0.95 and got.count() == table.count()


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")]
    got = quality.quality_scores(docs(spark, rows).withColumn("score", F.lit("s")), labels).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.quality_scores(docs(spark, []), labels).count() == 0


def test_language_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_languages(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97


def test_language_edges(spark):
    texts = [(i, "der die das und ist nicht" if i % 2 else "the and was with this") for i in range(40)]
    langs = {i: "de" if i % 2 else "en" for i in range(40)}
    rows = [*texts, (50, None), (51, ""), (52, "123 !!"), (53, "Der Die Das"), (53, "Der Die Das"), (None, "the and")]
    table = docs(spark, rows, {**langs, 50: None}).withColumn("lang_pred", F.lit(1))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify_languages(table).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == len(rows) and by[50] == by[51] == by[52] == ("und", 0.0)
    assert by[53][0] == "de" and by[None][0] == "en" and all(0 <= s <= 1 for _, _, s in got)
    assert {r.lang_pred for r in language.identify_languages(docs(spark, [(1, "abc")], {1: None})).collect()} == {"und"}
    assert language.identify_languages(docs(spark, [])).count() == 0


def test_language_model_is_naive_bayes(spark):
    texts = [(i, f"word{i} alpha beta") for i in range(20)] + [(i, f"wort{i} gamma delta") for i in range(20, 40)]
    langs, log = language.train(docs(spark, texts, {i: "aa" if i < 20 else "bb" for i in range(40)}))
    want = np.full((2, language.BUCKETS), language.SMOOTHING)
    for i, t in texts:
        np.add.at(want[i // 20], language._grams(t), 1)
    assert langs == ["aa", "bb"] and np.allclose(log[:, :-1], np.log(want / want.sum(axis=1, keepdims=True)), atol=1e-5)


# --- operator 4


def brute_fingerprint(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def near_texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice("ab cd Ef ghİ Éx jk".split()) + str(rng.randrange(50)) for _ in range(120)) for _ in range(12)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "zz"
            out.append(" ".join(w))
    return [*out, base[0], base[0].upper(), None, "", " \t", "one", "ONE", "one two", "a b c d", "a\x1cb c d"]


def test_simhash_equals_brute_force(spark):
    rows = list(enumerate(near_texts()))
    rows.append((5, rows[5][1]))
    table = docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(table).select("doc_id", simhash.fingerprint_text("fp").alias("f"), "component_id").collect()
    code = {i: brute_fingerprint(t) for i, t in rows}
    want = components(sorted(code), lambda a, b: (code[a] ^ code[b]).bit_count() <= 2)
    assert Counter((r.doc_id, r.f, r.component_id) for r in got) == Counter((i, f"{code[i]:016x}", want[i]) for i, _ in rows)


@pytest.mark.parametrize("bucket", [0, 1, 3, 64])
def test_links_connect_all_near_codes(spark, bucket):
    rng = random.Random(bucket)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for c in list(codes)[:12]:
        for _ in range(12):
            for _ in range(rng.randrange(1, 3)):
                c ^= 1 << rng.choice([0, 1, 2, 31, 32, 33, 62, 63])
            codes.add(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.hamming_links(spark.createDataFrame([(c,) for c in signed], "fp bigint"), bucket).collect()
    mask = (1 << 64) - 1
    near = lambda a, b: ((a ^ b) & mask).bit_count() <= 2
    assert all(near(r.u, r.v) for r in links)
    pairs = {(r.u, r.v) for r in links} | {(r.v, r.u) for r in links}
    assert components(signed, near) == components(signed, lambda a, b: (a, b) in pairs)


def test_keep_one_of_each(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (9, "entirely other words stand here"), (None, "x y z"), (None, "x y z")]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one_of_each(docs(spark, rows)).collect())
    assert kept == [(0, "x y z"), (1, "a b c d"), (9, "entirely other words stand here")]
    assert simhash.keep_one_of_each(docs(spark, [])).count() == 0


def test_keep_one_of_each_with_reused_ids(spark):
    a, b = "some words stand in this first text", "quite other words are in the second one"
    for rows, want in (([(1, a), (1, a), (1, b)], [(1, b), (1, a)]), ([(1, a), (1, b), (0, a)], [(0, a), (1, b)])):
        assert sorted(map(tuple, simhash.keep_one_of_each(docs(spark, rows)).select("doc_id", "text").collect())) == sorted(want)


# --- operator 5


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        out = {s: 2.0 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        above = {s for s in free if out[s] > 2 * sizes[s]}
        if not above:
            return out
        capped |= above


def test_mixing(spark):
    rng = random.Random(5)
    names = ["b", "a", None, "ä", "", "c"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])) if i % 17 else None) for i in range(900)]
    source = {i: names[0] if i % 3 else names[rng.randrange(6)] for i in range(900)}
    rows += [rows[7], rows[7]]
    table = docs(spark, rows, source=source).withColumn("size", F.lit("x")).withColumn("target", F.lit(None))
    got = mixing.mix_sources(table).collect()
    sizes = Counter()
    for i, t in rows:
        sizes[source[i]] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 300 for s in sizes)
    again = mixing.mix_sources(table.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.source or "~", r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_rounding_tree_keeps_the_sum(spark):
    rng = random.Random(2)
    rows = [("s" if i % 2 else None, i, i, rng.randrange(1, 50), 0.37) for i in range(500)]
    shares = spark.createDataFrame(rows, "source string, doc bigint, tie bigint, size bigint, ratio double")
    got = mixing.round_copies(shares, leaf=20, fan=3).collect()
    for s in ("s", None):
        want = sum(r[3] for r in rows if r[0] == s) * 0.37
        assert abs(sum(r.size * r.copies for r in got if r.source == s) - want) < 50
    assert len(got) == 500


def test_pivot_is_fair():
    rng = np.random.default_rng(0)
    size, p = np.array([5.0, 3, 9, 2, 7, 1]), np.array([0.3, 0.6, 0.5, 0.9, 0.2, 0.4])
    total = np.zeros(6)
    for _ in range(4000):
        x, left = mixing.pivot(size, p, rng.random(7))
        assert sum((x > 0) & (x < 1)) == (left >= 0) and np.isclose(x @ size, p @ size)
        total += x
    assert np.allclose(total / 4000, p, atol=0.03)


def test_pivot_hands_large_remainders_to_small_documents():
    rng = np.random.default_rng(1)
    size = np.sort(np.concatenate([rng.integers(1, 30, 300), [4000, 900, 700, 80]]).astype(float))[::-1]
    p, total, words = np.full(len(size), 0.4), np.zeros(len(size)), 0.4 * size.sum()
    for _ in range(3000):
        x, left = mixing.pivot(size, p, rng.random(len(size)), rng.random(len(size)))
        assert sum((x > 0) & (x < 1)) == (left >= 0) and np.isclose(x @ size, words)
        assert left < 0 or size[left] <= 4000
        total += x
    assert np.allclose(total / 3000, 0.4, atol=0.05)


def test_sources_come_near_their_targets(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_sources(table).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(r.taken - r.target) <= max(0.02 * r.target, 0.5 * r.largest) for r in got)
    assert sum(abs(r.taken - r.target) <= 0.01 * r.target for r in got) >= 0.8 * len(got)


# --- operator 7


def brute_leaks(rows, items):
    words = lambda t: re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    runs = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for i, t in rows:
        for k, q in items:
            w = words(q)
            n = min(5, len(w))
            if n and len(runs(words(t), n) & runs(w, n)) >= 0.8 * len(runs(w, n)):
                out.append((i, k))
    return Counter(out)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "cd", "eé", "x1", "_q", "zz"]) + str(rng.randrange(9))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 40, 90])))) for k in range(25)] + [(90, None), (91, " .,"), (3, "again a second text of item three")]
    rows = []
    for i in range(120):
        t = [word() for _ in range(rng.choice([0, 3, 50, 400]))]
        q = rng.choice(items)[1] or ""
        part = q.split()[: max(1, int(len(q.split()) * rng.choice([0.5, 0.8, 0.9, 1])))]
        at = rng.randrange(len(t) + 1)
        rows.append((i, ", ".join(t[:at] + part + t[at:])))
    rows += [(200, None), (201, ""), rows[3]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = docs(spark, rows).withColumn("item_id", F.lit(0)).withColumn("m", F.lit(0))
    for slices in (1000, 7):
        got = decontaminate.contained_items(table, bench, items=slices)
        assert Counter((r.doc_id, r.item_id) for r in got.collect()) == brute_leaks(rows, items)
    left = Counter(r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect())
    bad = {i for i, _ in brute_leaks(rows, items)}
    assert left == Counter(i for i, _ in rows if i not in bad)
    assert decontaminate.contained_items(docs(spark, []), bench).count() == 0
    assert decontaminate.contained_items(table, bench.limit(0)).count() == 0


def test_decontamination_folds_the_case_of_all_letters(spark):
    item = "être où déjà vu straße größe ñandú οδος été à l'école"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    table = docs(spark, [(1, f"x {item.upper()} y"), (2, item), (3, "être où déjà")])
    assert [r.doc_id for r in decontaminate.drop_contaminated(table, bench).collect()] == [3]
    assert {r.doc_id for r in decontaminate.contained_items(table, bench, fold=True).collect()} == {1, 2}


def test_leak_sql_folds_case_as_the_query_does(spark, tmp_path):
    import duckdb

    from strataforge.llm import queries

    letters = "".join(chr(c) for c in range(0x80, 0x2100) if chr(c).casefold() != chr(c) and chr(c).isalpha())
    item = " ".join(letters[k : k + 7] for k in range(0, len(letters), 7)) + " Straße ΟΔΟΣ οδος"
    spark.createDataFrame([(1, item), (2, "École où l'ÉTÉ déjà VU")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(spark, [(1, f"x {item.casefold()} y"), (2, item), (3, "école OÙ l'été DÉJÀ vu"), (4, "ecole ou l'ete deja vu"), (5, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op7_benchmark_leaks"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"select doc_id, item_id, n_shingles, n_found from ({queries.oracle_sql()['op7_benchmark_leaks']})").fetchall()
    assert Counter(tuple(r) for r in got) == Counter(want) and {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (3, 2)}


# --- operator 8


@pytest.mark.parametrize("chunk", [1000, 3])
def test_top_k_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.choice([-0.5, -0.1, 0.0, 0.2, 0.7], 6)]) for i in range(160)]
    rows += [(200 + i, rows[50][1]) for i in range(30)] + [(300, None), (350, [float("nan")] * 6), (400, [None] + [1.0] * 5), (450, [float("inf")] * 6)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("s"))
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in good:
        if q % 50 == 0:
            best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = topk.top_k(table, topk.divisible(table, 50), chunk=chunk).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_takes_doubles_as_they_are(spark):
    near = 1 / 256 - 1e-12  # as a float it would be 1 / 256
    table = spark.createDataFrame([(0, [1.0]), (1, [near]), (2, [1 / 256])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(table, topk.divisible(table, 50)).orderBy("rank").collect()] == [(0, 1, 2, 256), (0, 2, 1, 0)]


def test_top_k_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(table, topk.divisible(table, 50)).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


# --- operator 9

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href=x>Menu</a><li><a href=y>More</a></ul></nav><div id="cookie-notice">We use cookies</div>
<article><header><h1>A  title &amp; more</h1></header><p>First <b>bold</b> words&nbsp;here.<br>Second line<p>Third &lt;tag&gt; &copy <i>end</i>
<aside>Related</aside><form><input value=q><label>Name</label></form><div class="ad">Buy</div></article>
<section class="comments"><p>A reader writes a very long comment that has no links in it at all.</p></section><footer><p>Imprint</p></footer></body></html>"""


def test_main_text():
    assert maintext.main_text(PAGE) == "A title & more\nFirst bold words here.\nSecond line\nThird <tag> © end"
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<html><body></body></html>") == ""
    assert maintext.main_text("just words") == "just words"
    long = "word " * 60
    page = f"<body><div class=top><a href=1>a</a> <a href=2>b</a></div><div id=main><p>{long}</p><p>{long}</p></div><div><a href=3>c</a></div></body>"
    assert maintext.main_text(page) == f"{long.strip()}\n{long.strip()}"
    assert maintext.main_text("<div>" * 5000 + "deep") == "deep"
    assert maintext.main_text("<p title='a>b\">x</p><p>y") and "<" not in maintext.main_text("a <b <p>c</p>").replace("<b", "")


def test_main_text_of_page_frames():
    told = [f"Paragraph {i}. " + "Many plain words stand in this one. " * 4 for i in range(4)]
    inner = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in told)
    want = "\n".join(["Title", *(x.strip() for x in told)])
    reader = "<p>" + "A reader has much to say. " * 30 + "</p>"
    frames = (
        "<body><div class='header'><a href=/>Home</a></div><div class='sidebar'><p>Side</p></div><div id=content>{}</div><div id=comments><ul><li>{}</li></ul></div><div class=footer><p>Imprint</p></div></body>",
        "<body><div class='layout has-sidebar'><div id=content>{}</div><div class=sidebar><p>Side</p></div></div><div class=comments>{}</div></body>",
        "<body><main><article class=post>{}</article><section id=comments><article class=comment>{}</article></section></main></body>",
        "<body><form id=f><div id=menu><a href=m>m</a></div><div class=content>{}</div></form><div class=comments>{}</div></body>",
        "<table><tr><td><a href=a>Home</a> <a href=b>News</a></td><td>{}</td></tr></table><div class=comments>{}</div>",
    )
    for frame in frames:
        assert maintext.main_text(frame.format(inner, reader)) == want
    lines = inner.replace("</h1>", "</h1><p class=ad>Buy</p>").replace("<p>Paragraph 2", "<p class='notice wide'>Closed</p><p>Paragraph 2")
    assert maintext.main_text(f"<article>{lines}</article>") == want
    assert maintext.main_text(f"<div class=promo>{inner}</div>") == want


def test_main_text_of_generated_pages(spark, small):
    import html

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = maintext.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect()
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:h1|p|br)>", inner)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


# --- operator 10


def test_warc_round_trip(spark):
    rows = [(4, "http://b.example.com/x?q=1", "same"), (2, "https://a.example.com", "same"), (9, None, None), (8, "http://[bad", ""), (1, "http://é.example/ü\r\nX: y", "ünï\r\n\r\ncode"), (None, "http://n.example/", "same"), (3, "http://b.example.com/x?q=1", "other"), (3, "http://b.example.com/x?q=1", "other")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    folder = fresh_path(spark, "warc")
    directory = warc.write_archive(pages, folder, lines=2)
    got = warc.read_archive(directory, folder).collect()
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        first = min(k for k, _, x in rows if k is not None and (x or "") == (h or ""))
        repeat = i is not None and i != first
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if repeat else "response", first if repeat else None)] += 1
    assert Counter(map(tuple, got)) == want
    urls = spark.createDataFrame([("http://b.example.com/x?q=1",), ("http://none.example/",), (rows[4][1],)], "url string")
    found = Counter((r.url, r.page_id, r.record_type, None if r.payload is None else r.payload.decode()) for r in warc.look_up(directory, folder, urls).collect())
    assert found == Counter({(rows[0][1], 4, "revisit", None): 1, (rows[0][1], 3, "response", "other"): 2, (rows[4][1], 1, "response", rows[4][2]): 1})
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_small_payloads_are_not_revisits(spark):
    pages = spark.createDataFrame([(1, "http://a/", "abc"), (2, "http://b/", "abc")], "page_id bigint, url string, html string")
    assert {r.record_type for r in warc.archive_and_read(pages, least=4).collect()} == {"response"}
    assert {r.record_type for r in warc.archive_and_read(pages, least=3).collect()} == {"response", "revisit"}
