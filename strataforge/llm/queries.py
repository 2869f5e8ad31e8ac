"""The registered queries of the thirteen operators, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import decontaminate, exact_dedup, hard_negatives, language, licences, maintext, merkle, mixing, quality, secrets, simhash, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), fold=True)
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), F.col("n_found").cast("bigint").alias("n_found"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, topk.divisible(rows, 50))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_texts(_table(spark, sf_dir, "pages"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_secret_scan, op2_licence_scan, op3_quality_scores, op4_simhash_components, op5_source_mix, op6_language_id, op7_benchmark_leaks, op8_exact_top_k, op9_main_text, op10_warc_archive, op11_merkle_manifest, op12_hard_negatives, op13_exact_dedup]
    return {f.__name__: f for f in found}


_QUOTE = """["'']?"""
_ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + _QUOTE + r"\x20*[:=]\x20*" + _QUOTE + r"([A-Za-z0-9+/_.=-]+)"


def _kind_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the pieces between matches and the matches give the positions."""
    return f"""
    select doc_id, row_no, {order} as ord, '{kind}' as kind, n,
           sum(g + m) over w - m as s, sum(g + m) over w as e, own
    from (select doc_id, row_no, unnest(range(len(found))) as n,
                 unnest(list_transform(gaps[1:len(found)], lambda x: length(x))) as g,
                 unnest(list_transform(found, lambda x: length(x))) as m,
                 unnest(list_transform(kept, lambda x: length(x))) as own
          from (select doc_id, row_no, regexp_split_to_array(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}', 0) as found,
                       regexp_extract_all(t, '{pattern}', {group}) as kept from d))
    window w as (partition by row_no order by n rows between unbounded preceding and current row)
    qualify own >= {least}"""


_OP1 = f"""
with d as (select doc_id, row_number() over () as row_no, coalesce(text, '') as t from documents),
spans as ({_kind_sql("assign", 0, _ASSIGN, 2, 8)}
 union all {_kind_sql("access", 1, "AKIA[A-Z0-9]+", 0, 16)}
 union all {_kind_sql("hex", 2, "[0-9a-f]+", 0, 32)}),
listed as (select row_no, count(*) filter (where ord = 0) as a, count(*) filter (where ord = 1) as b, count(*) filter (where ord = 2) as c,
  string_agg(kind || ':' || cast(cast(s as bigint) as varchar) || ':' || cast(cast(e as bigint) as varchar), ',' order by s, ord) as spans from spans group by row_no)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (row_no)"""


def _fold_sql(text: str) -> str:
    """Unicode's folded case by rule: characters that fold to several are replaced, all others translated."""
    folds = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
    for c, f in folds.items():
        if len(f) > 1:
            text = f"replace({text}, '{c}', '{f}')"
    one = {c: f for c, f in folds.items() if len(f) == 1}
    return f"translate({text}, '{''.join(one)}', '{''.join(one.values())}')"


_OP7 = rf"""
with words as (select item_id, regexp_extract_all({_fold_sql('text')}, '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+') as w from benchmark where text is not null),
items as (select distinct item_id, len(w) as n, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words where len(w) > 0),
own as (select item_id, count(*) as n_shingles from items group by item_id),
docs as (select doc_id, row_number() over () as row_no, regexp_extract_all({_fold_sql('text')}, '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+') as w from documents where text is not null),
runs as (select distinct doc_id, row_no, array_to_string(w[i:i + k - 1], ' ') as s
  from (select doc_id, row_no, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, (select distinct least(n, 5) as k from items)))
select doc_id, item_id, n_shingles, count(*) as n_found
from runs join items using (s) join own using (item_id)
group by doc_id, row_no, item_id, n_shingles having count(*) >= 0.8 * n_shingles"""

_OP8 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  , q.n from (select *, row_number() over () as n from (select distinct vec_id, e from v where vec_id % 50 = 0)) q join v c on q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by n order by score desc, vec_id) as rank from p) where rank <= 5"""


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Trees of three children over ``leaves(tree, i, n, h)``: ``name_k`` has the nodes of level k with what stands left and right of them in their run.

    ``n`` is the number of nodes of the tree on the level; a tree of one node stays as it is. ``levels`` are enough for 3^levels leaves.
    """
    out, below = [], leaves
    for k in range(levels):
        w = "window w as (partition by tree, i // 3 order by i)"
        out.append(f"""{name}_{k} as (select tree, i, n, h,
          coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as a,
          coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as b from {below} {w})""")
        below = f"{name}_up{k}"
        out.append(f"{below} as (select tree, i // 3 as i, (n + 2) // 3 as n, case when n = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h from {name}_{k} group by tree, i // 3, n)")
    return ",\n".join(out)


def _walk_sql(name: str, start: str, levels: int) -> str:
    """From ``start(tree, i, proof, f, ...)`` up: the siblings are added to ``proof`` and ``f`` is folded."""
    out, below = [], start
    for k in range(levels):
        fold = "case when x.n = 1 then s.f else sha256(x.a || s.f || x.b) end"
        proof = "case when x.n = 1 then s.proof else s.proof || x.a || x.b end"
        out.append(f"{name}_{k} as (select s.* replace (s.i // 3 as i, {proof} as proof, {fold} as f) from {below} s join {start.split('_')[0]}_{k} x using (tree, i))")
        below = f"{name}_{k}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    value = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    return "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", "n_chars", text])) + ")"


#: Levels in a source and over the sources: the SQL is for up to 3^12 rows of a source and 3^5 sources.
_IN, _OVER = 12, 5
_CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ord(x)::bigint)), lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_OP11 = f"""
with d as (select *, case when source is null then '-' else '=' || source end as tree, {_leaf_sql("text")} as leaf,
    case when {_CRC} % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql("text")} end as other from documents),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from d),
inner_leaves as (select tree, i, n, leaf as h from p),
{_tree_sql("rows", "inner_leaves", _IN)},
sub as (select tree as name, h as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from rows_up{_IN - 1}),
outer_leaves as (select '' as tree, i, n, subroot as h from sub),
{_tree_sql("tops", "outer_leaves", _OVER)},
rows_start as (select tree, i, '' as proof, other as f, doc_id, leaf from p),
{_walk_sql("up", "rows_start", _IN)},
tops_start as (select '' as tree, s.i, u.proof, u.f, doc_id, leaf, subroot from up_{_IN - 1} u join sub s on u.tree = s.name),
{_walk_sql("over", "tops_start", _OVER)}
select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from over_{_OVER - 1}, tops_up{_OVER - 1}"""

_OP12 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select *, row_number() over () as n from (select distinct vec_id, label, e from v where vec_id % 50 = 0)),
p as (select a.n, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
  cast(list_sum(list_transform(range(1, least(len(a.e), len(c.e)) + 1), lambda i: a.e[i] * c.e[i])) as bigint) as score from a join v c on a.vec_id <> c.vec_id),
near as (select *, row_number() over (partition by n order by score desc, vec_id) as place from p where same qualify place <= 5)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from (
  select near.anchor_id, near.vec_id as positive_id, p.vec_id as negative_id, near.score as positive_score, p.score as negative_score,
    row_number() over (partition by n, place order by p.score desc, p.vec_id) as rank
  from near join p using (n) where not p.same and 50 * near.score <= 100 * p.score and 100 * p.score <= 95 * near.score) where rank <= 3"""

_OP13 = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256 from d"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it expresses. It lacks XXH64 with a seed, base32 of SHA-1, trained models and seeded draws: those are tested against brute force."""
    return {"op1_secret_scan": _OP1, "op7_benchmark_leaks": _OP7, "op8_exact_top_k": _OP8, "op11_merkle_manifest": _OP11, "op12_hard_negatives": _OP12, "op13_exact_dedup": _OP13}
