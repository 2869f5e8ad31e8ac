"""Manifest building: scans, class maps, duplicates, groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataforge.operators import dedupe, neardup, splits
from strataforge.operators.graph import connected_components
from strataforge.plans import query
from strataforge.plans.tables import CODES, MANIFEST, NEAR, codes, manifest, near_codes, table

#: Bits by which the codes of near duplicates may differ, and by which codes of a wide search may.
BITS, WIDE = 2, 18


@query(f"""with {MANIFEST}
select image_id, id, array_to_string(list_filter(paths, lambda x: x <> path), '|') as dup_paths, label, conflict from (
 select image_id, min(id) as id, arg_min(path, id) as path, list_sort(list(path)) as paths, min(class_raw) as label, count(distinct class_raw) > 1 as conflict from manifest group by image_id)""")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = dedupe.dedupe(manifest(spark, d), "image_id", ["id"], "path", "class_raw")
    return rows.select("image_id", F.element_at(F.split("path", "/"), -1).cast("bigint").alias("id"), F.array_join("dup_paths", "|").alias("dup_paths"), "label", "conflict")


@query(f"""with {MANIFEST}, kept as (select image_id, min(id) as id from manifest group by image_id having count(distinct class_raw) = 1)
select m.image_id, m.path, m.class_km2, case when m.class_km2 = 'unknown_als' then 'holdout_unknown' end as split,
 case when m.class_km2 = 'unknown_als' then 'holdout_unknown' else 'unblocked:random_by_phash_group' end as split_rule from manifest m join kept using (image_id, id)""")
def manifest_build(spark: SparkSession, d: str) -> DataFrame:
    """Scan, class map, duplicates and routing in one plan."""
    rows = manifest(spark, d)
    kept = dedupe.dedupe(rows, "image_id", ["id"], "path", "class_raw").where("not conflict").select("path")
    split, rule = splits.route(F.col("class_km2"), splits.UNBLOCKED)
    return rows.join(kept, "path", "left_semi").select("image_id", "path", "class_km2", split.alias("split"), F.coalesce(rule, F.lit(splits.UNBLOCKED)).alias("split_rule"))


@query("""select lang as class_raw, source, quality, count(*) as n, cast(grouping(lang) as integer) as g_lang, cast(grouping(source) as integer) as g_source, cast(grouping(quality) as integer) as g_quality
from documents left join labels using (doc_id) group by grouping sets ((), (lang), (source), (quality), (lang, source))""")
def counts_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").withColumnRenamed("lang", "class_raw")
    c = F.col
    return rows.groupingSets([[], [c("class_raw")], [c("source")], [c("quality")], [c("class_raw"), c("source")]], c("class_raw"), c("source"), c("quality")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("class_raw").cast("int").alias("g_lang"), F.grouping("source").cast("int").alias("g_source"), F.grouping("quality").cast("int").alias("g_quality")
    )


@query("""select lang as class_raw, source, count(*) as n, round(count(*) / sum(count(*)) over (partition by lang), 4) as share from documents group by lang, source""")
def split_fractions(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "documents").groupBy(F.col("lang").alias("class_raw"), "source").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("class_raw")), 4))


@query("""select o_orderkey, o_orderpriority as class_raw, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'rust' when o_orderpriority = '3-MEDIUM' then 'healthy' when o_orderpriority = '5-LOW' then 'excluded' end as class_km2 from orders""")
def class_map_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("class_raw"))
    return dedupe.map_classes(rows, _class_map(spark), "class_raw", "class_km2")


def _class_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("1-URGENT", "rust"), ("2-HIGH", "rust"), ("3-MEDIUM", "healthy"), ("5-LOW", "excluded")], "class_raw string, class_km2 string")


@query("""select o_orderpriority as class_raw, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') group by 1""")
def unmapped_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("class_raw"))
    return dedupe.unmatched(rows, F.broadcast(_class_map(spark)), "class_raw").groupBy("class_raw").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id, lang, label from documents join embeddings on doc_id = vec_id""")
def cache_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


@query("""select doc_id from documents where doc_id not in (select vec_id from embeddings)""")
def missing_feature_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return dedupe.unmatched(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""select coalesce(a, b) as key, case when b is null then 'missing' else 'unbacked' end as state
from (select distinct c_custkey as a from customer) full join (select distinct o_custkey + 200 as b from orders) on a = b where a is null or b is null""")
def audit_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.audit(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select((F.col("o_custkey") + 200).alias("key")), "key")


@query("""with r as (select event_id, user_id, event_type, value, row_number() over (partition by user_id, event_type, cast(floor(value) as bigint) order by event_id) as n, cast(floor(value) as bigint) as v from events where event_id % 2 = 1)
select event_id, user_id, event_type, v from r where n = 1 and not exists (select 1 from events k where k.event_id % 2 = 0 and k.user_id is not distinct from r.user_id and k.event_type is not distinct from r.event_type and cast(floor(k.value) as bigint) is not distinct from r.v)""")
def identity_append(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("bigint").alias("v"))
    return dedupe.append_new(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type", "v"], [F.col("event_id")])


@query(f"""with {MANIFEST} select a.sha256 from (select distinct sha256 from manifest where source < 'src2') a where sha256 in (select sha256 from manifest where source >= 'src2')""")
def overlap_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d)
    return rows.where("source < 'src2'").select("sha256").intersect(rows.where("source >= 'src2'").select("sha256"))


@query(f"""with {MANIFEST}, h as (select distinct source, sha256 from manifest) select a.source as a, b.source as b, count(*) as shared from h a join h b on a.sha256 = b.sha256 and a.source < b.source group by 1, 2""")
def member_overlap(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.member_overlap(manifest(spark, d), "source", "sha256")


@query(f"""with {MANIFEST} select source, count(*) as files, count(distinct sha256) as distinct_files from manifest group by source""")
def member_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("sha256").alias("distinct_files"))


@query(f"""with {MANIFEST} select path, sha256, case when id % 97 = 0 then sha256('changed') else sha256 end as expected from manifest where class_raw <> 'fr' and id % 97 = 0""")
def checksum_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d)
    listed = rows.where("class_raw <> 'fr'").select("path", F.when(F.col("id") % 97 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return dedupe.mismatched(rows, listed, "path", "sha256").select("path", "sha256", "expected")


_CLASSES = f"""{NEAR}, classes as (select code, min(id) as id from near group by code)"""
_PAIRS = f"""{_CLASSES}, pairs as (select a.id as a, b.id as b, cast(bit_count(xor(a.code, b.code)) as integer) as distance from classes a join classes b on a.id < b.id where bit_count(xor(a.code, b.code)) <= {BITS})"""


@query(f"with {_PAIRS} select * from pairs")
def phash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_class_pairs(near_codes(spark, d), BITS)


@query(f"""with {CODES}, classes as (select code, min(id) as id from codes group by code) select a.id as a, b.id as b, cast(bit_count(xor(a.code, b.code)) as integer) as distance from classes a join classes b on a.id < b.id where bit_count(xor(a.code, b.code)) <= {WIDE}""")
def phash_pairs_wide(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_class_pairs(codes(spark, d), WIDE)


@query(f"""with {CODES}, s as (select code & 16777215 as code, min(id) as id from codes group by 1) select a.id as a, b.id as b, cast(bit_count(xor(a.code, b.code)) as integer) as distance from s a join s b on a.id < b.id where bit_count(xor(a.code, b.code)) <= 2""")
def phash_pairs_banded(spark: SparkSession, d: str) -> DataFrame:
    short = codes(spark, d).select("id", F.col("code").bitwiseAND(F.lit((1 << 24) - 1)).alias("code"))
    return neardup.near_class_pairs(short, 2, width=24)


@query(f"""with {NEAR}, x as (select code, min(id) as id from near where id % 2 = 0 group by 1), y as (select code, min(id) as id from near where id % 2 = 1 group by 1)
select x.id as a, y.id as b, cast(bit_count(xor(x.code, y.code)) as integer) as distance from x join y on bit_count(xor(x.code, y.code)) <= {BITS}""")
def overlap_near(spark: SparkSession, d: str) -> DataFrame:
    rows = near_codes(spark, d).select("id", "code")
    return neardup.near_between(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), BITS)


@query(f"""with recursive {_PAIRS}, both_ways as (select a as u, b as v from pairs union select b, a from pairs union select id, id from classes),
reach(u, v) as (select u, v from both_ways union select r.u, w.v from reach r join both_ways w on r.v = w.u),
tops as (select u as id, min(v) as component from reach group by u), named as (select n.id, n.label, t.component from near n join classes c using (code) join tops t on t.id = c.id)
select id, component, n, mixed from named join (select component, count(*) as n, count(distinct label) > 1 as mixed from named group by component) using (component)""")
def phash_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over classes of equal codes; rows take their class's."""
    rows = near_codes(spark, d)
    classes = neardup.code_classes(rows).select("code", F.col("id").alias("class"))
    links = neardup.near_class_pairs(rows, BITS).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_components(links).select(F.col("node").alias("class"), "component")
    named = rows.join(classes.join(labels, "class", "left").select("code", F.coalesce("component", "class").alias("component")), "code")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("label") > 1).alias("mixed"))
    return named.join(sizes, "component").select("id", "component", "n", "mixed")


def _block_rows(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.when(k % 5 != 0, F.concat(F.lit("d"), F.expr("o_orderkey div 48"))).alias("district"),
        F.when((k % 16 == 1) | (k % 40 == 0), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.concat(F.lit("g"), F.expr("o_orderkey div 3")).alias("grp"),
    )


@query(
    """with recursive rows_ as (select o_orderkey as id, case when o_orderkey % 5 <> 0 then 'd' || cast(o_orderkey // 48 as varchar) end as district,
 case when o_orderkey % 16 = 1 or o_orderkey % 40 = 0 then strftime(o_orderdate, '%Y-%m-%d') end as day, 'g' || cast(o_orderkey // 3 as varchar) as grp from orders),
edges as (select distinct 'g:' || grp as u, 'v:' || district as v from rows_ where district is not null
 union select distinct 'g:' || k.grp, 'v:' || s.district from rows_ k join rows_ s on k.day = s.day where k.district is null and s.district is not null),
links as (select distinct a.v as u, b.v as v from edges a join edges b using (u)),
reach(u, v) as (select u, v from links union select r.u, w.v from reach r join links w on r.v = w.u),
named as (select e.u, string_agg(distinct r.v[3:], '+' order by r.v[3:]) as vals from edges e join reach r on r.u = e.v group by e.u)
select id, coalesce('district:' || vals, grp) as split_group, case when vals is not null then 'blocked:district' else 'unblocked:random_by_phash_group' end as split_rule from rows_ left join named on u = 'g:' || grp"""
)
def blocks(spark: SparkSession, d: str) -> DataFrame:
    return splits.blocks(_block_rows(spark, d), "district")


@query()
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole near-duplicate groups into splits close to their targets."""
    rows = manifest(spark, d).where("class_km2 <> 'unknown_als'").withColumn("grp", F.concat_ws(":", "source", F.pmod(F.col("id"), F.lit(7)).cast("string")))
    return splits.group_split(rows.select("id", "grp", "class_km2"), "grp", "class_km2", 7)


@query("""with r as (select o_orderkey as id, 'g' || cast((o_orderkey * o_orderkey + o_orderkey // 7) % 7 as varchar) as grp, o_orderpriority as klass from orders),
cells as (select grp, klass, count(*) as n from r group by 1, 2), ranked as (select *, dense_rank() over (order by grp) - 1 as g from cells),
want as (select klass, sum(n) as total from cells group by 1), shares as (select * from (values (0, 0.7), (1, 0.1), (2, 0.2)) t(s, share)),
opt as (select i as o from range(2187) t(i)),
have as (select o, s, share, w.klass, total, sum(case when cast(o // cast(pow(3, g) as bigint) as bigint) % 3 = s then n else 0 end) as h from opt, shares, want w join ranked r on r.klass = w.klass group by all),
cost as (select o, round(sum(pow(h / total - share, 2)), 12) as c from have group by o having min(h) > 0),
best as (select o from cost order by c, o limit 1), place as (select distinct grp, g from ranked)
select r.id, r.grp, r.klass, case cast(o // cast(pow(3, g) as bigint) as bigint) % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from r join place using (grp), best""")
def group_split_exact(spark: SparkSession, d: str) -> DataFrame:
    """Seven groups of orders: the assignment of least cost of all 2,187."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("id"), F.concat(F.lit("g"), ((k * k + F.expr("o_orderkey div 7")) % 7).cast("string")).alias("grp"), F.col("o_orderpriority").alias("klass"))
    return splits.group_split(rows, "grp", "klass", 7)


@query()
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).select("id", "source", "class_km2", F.concat_ws(":", "source", F.pmod(F.col("id"), F.lit(11)).cast("string")).alias("grp"))
    return splits.group_folds(rows, "grp", "class_km2", 5, 0)


@query(f"""with {MANIFEST} select id, case when id % 10 < 7 then 'train' else 'val' end as split from manifest where id % 10 < 8""")
def purpose_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows that training and selection may read."""
    part = F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 == 7, "val").otherwise("test")
    return splits.read_split(manifest(spark, d).select("id", part.alias("split")), ["train", "val"], "select")


@query(f"""with {MANIFEST} select source as dataset, case when n_chars % 3 = 0 then 'MIT' else 'CC-BY-4.0' end as licence, count(*) as n, min(path) as first_path from manifest group by 1, 2""")
def licence_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).withColumn("licence", F.when(F.col("n_chars") % 3 == 0, "MIT").otherwise("CC-BY-4.0"))
    return rows.groupBy(F.col("source").alias("dataset"), "licence").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query(f"""with {MANIFEST} select case when a.name is null then b.name else a.name end as name, case when a.name is null then 'add' when b.name is null then 'delete' when a.digest = b.digest then 'keep' else 'replace' end as action
from (select path as name, sha256 as digest from manifest where id % 5 <> 0) a full join (select path as name, case when id % 7 = 0 then sha256('x') else sha256 end as digest from manifest where id % 3 <> 0) b on a.name = b.name""")
def file_changes(spark: SparkSession, d: str) -> DataFrame:
    from strataforge.sources.sinks import file_changes as changes

    rows = manifest(spark, d)
    old = rows.where("id % 5 <> 0").select(F.col("path").alias("name"), F.col("sha256").alias("digest"))
    new = rows.where("id % 3 <> 0").select(F.col("path").alias("name"), F.when(F.col("id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("digest"))
    return changes(old, new)


@query("""select g as option_no, cost from (
 with opt as (select i as g from range(729) r(i)), cnt as (select o_orderkey % 6 as k, count(*) as n from orders group by 1), total as (select sum(n) as t from cnt),
 have as (select g, s, sum(case when cast(g // cast(pow(3, k) as bigint) as bigint) % 3 = s then n else 0 end) as h from opt, cnt, (select unnest([0, 1, 2]) as s) group by g, s)
 select g, round(sum(pow((h - (case s when 0 then 0.7 when 1 then 0.1 else 0.2 end) * t) / t, 2)), 6) as cost from have, total group by g having min(h) > 0)""")
def exhaustive_costs(spark: SparkSession, d: str) -> DataFrame:
    """Every assignment of six groups to three splits with its distance to the targets: a fixed product of 729 rows, made by a range."""
    counts = [r["n"] for r in table(spark, d, "orders").groupBy((F.col("o_orderkey") % 6).alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()]
    total = float(sum(counts))
    options = spark.range(3 ** len(counts)).select(F.col("id").alias("option_no"))
    digit = lambda k: F.floor(F.col("option_no") / (3**k)) % 3
    have = [sum((F.when(digit(k) == s, F.lit(n)).otherwise(0) for k, n in enumerate(counts)), F.lit(0)) for s in range(3)]
    cost = sum((F.pow((h - F.lit(share * total)) / total, F.lit(2.0)) for h, share in zip(have, (0.7, 0.1, 0.2), strict=True)), F.lit(0.0))
    return options.where(have[0] > 0).where(have[1] > 0).where(have[2] > 0).select("option_no", F.round(cost, 6).alias("cost"))
