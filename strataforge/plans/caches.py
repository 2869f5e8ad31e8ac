"""Queries over caches, runs, fields and ordered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.operators import caches, dedupe, metrics, ordering, ranks, validate
from strataforge.plans import query
from strataforge.plans.tables import MANIFEST, manifest, table
from strataforge.session import fresh_path, staged
from strataforge.sources import archives

def _caches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("k"), F.concat(F.lit("c/"), k.cast("string")).alias("path"), (k % 11 != 0).alias("present"), F.col("c_mktsegment").alias("backbone_id"), F.when(k % 13 != 0, F.concat(F.lit("w"), (k % 5).cast("string"))).alias("weights_sha256"),
        F.lit(224).alias("resolution"), F.lit("p=1").alias("preprocess_string"), F.lit("float32").alias("compute_dtype"), F.col("c_nationkey").alias("nation"),
    )
    key = caches.cache_key({c: F.col(c) for c in ("backbone_id", "weights_sha256", "resolution", "preprocess_string", "compute_dtype")})
    k = F.col("k")
    shape = F.array(F.lit(10), F.lit(16))
    held = lambda t, s: F.struct(F.lit(t).alias("dtype") if isinstance(t, str) else t.alias("dtype"), s.alias("shape"))
    return rows.withColumns(
        {
            "cache_key": F.when(k % 17 == 0, "zz").otherwise(key),
            "manifest_sha256": F.when(k % 19 == 0, "other").otherwise("m"),
            "n_images": F.lit(10),
            "storage_dtype": F.lit(None).cast("string"),
            "shapes": F.create_map(F.lit("cls"), shape, F.lit("meanpatch"), F.when(k % 23 == 0, F.array(F.lit(9), F.lit(16))).otherwise(shape)),
            "arrays": F.create_map(
                F.lit("cls"), held(F.when(k % 29 == 0, "float32").otherwise("float16"), shape), F.lit("meanpatch"), held("float16", shape),
                F.lit("image_id"), held("str", F.array(F.lit(10))), F.lit("sha256"), held("str", F.array(F.when(k % 31 == 0, 9).otherwise(10))),
            ),
        }
    )


@query("""select 'c/' || cast(c_custkey as varchar) as path, case when c_custkey % 11 = 0 then 'missing' when c_custkey % 13 = 0 then 'lacks_key_field' when c_custkey % 17 = 0 then 'wrong_key' when c_custkey % 19 = 0 then 'other_manifest'
 when c_custkey % 23 = 0 then 'shape' when c_custkey % 29 = 0 then 'dtype' when c_custkey % 31 = 0 then 'n_images' end as problem from customer where problem is not null""")
def cache_problems(spark: SparkSession, d: str) -> DataFrame:
    return caches.cache_problems(_caches(spark, d), "m")


@query("""select c_custkey as k, substring(sha256('["' || c_mktsegment || '", "w' || cast(c_custkey % 5 as varchar) || '", 224, "p=1", "float32"]'), 1, 16) as cache_key from customer where c_custkey % 13 <> 0 and c_custkey % 17 <> 0""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _caches(spark, d).where("weights_sha256 is not null and cache_key <> 'zz'").select("k", "cache_key")


_WANTED = """select distinct c_mktsegment as backbone_id, n_nationkey as nation, case when n_nationkey % 2 = 0 then (select min(c_custkey) from customer)::varchar end as cache_key from customer, nation where n_nationkey % 3 <> 1"""


@query(f"""with w as ({_WANTED}), c as (select 'c/' || cast(c_custkey as varchar) as path, c_mktsegment as backbone_id, c_nationkey as nation, cast(c_custkey % 40 + 1 as varchar) as cache_key from customer)
select w.backbone_id, w.nation, w.cache_key, case count(c.path) when 0 then 'not_found' when 1 then 'found' else 'ambiguous' end as state, case when count(c.path) = 1 then min(c.path) end as path
from w left join c on w.backbone_id = c.backbone_id and w.nation = c.nation and (w.cache_key is null or w.cache_key = c.cache_key) group by 1, 2, 3""")
def cache_locator(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    held = c.select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("backbone_id"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 40 + 1).cast("string").alias("cache_key"))
    least = c.agg(F.min("c_custkey").cast("string").alias("least"))
    wanted = c.select(F.col("c_mktsegment").alias("backbone_id")).distinct().crossJoin(F.broadcast(table(spark, d, "nation").where("n_nationkey % 3 <> 1").select(F.col("n_nationkey").alias("nation")))).crossJoin(F.broadcast(least))
    wanted = wanted.select("backbone_id", "nation", F.when(F.col("nation") % 2 == 0, F.col("least")).alias("cache_key"))
    return caches.find_caches(held, wanted, ["backbone_id", "nation"])


@query("""with r as (select 'r' || cast(s_suppkey as varchar) as run_id, 'b' || cast(s_nationkey % 4 as varchar) as backbone_id, case when s_suppkey % 2 = 0 then 224 else 518 end as res, cast(s_suppkey % 5 as bigint) as seed, case when s_suppkey % 3 = 0 then ['x_v1'] else ['x_v1', 'y_v2'] end as train from supplier),
w as (select 'b' || cast(n_nationkey % 5 as varchar) as backbone_id, case when n_nationkey % 3 = 0 then null else 224 end as res, cast(n_nationkey % 6 as bigint) as seed, case when n_nationkey % 2 = 0 then ['x_v1', 'y_v2'] end as train, n_nationkey as no from nation)
select no, case count(run_id) when 0 then 'missing_run' when 1 then 'found' else 'ambiguous_run' end as state, case when count(run_id) = 1 then min(run_id) end as run_id
from w left join r on w.backbone_id = r.backbone_id and (w.res is null or w.res = r.res) and w.seed = r.seed and (w.train is null or w.train = r.train) group by no""")
def run_selector(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    struct = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    run = struct(
        backbone=struct(backbone_id=F.concat(F.lit("b"), (F.col("s_nationkey") % 4).cast("string")), res=F.when(s % 2 == 0, 224).otherwise(518)), tokens=F.lit("cls"), head=F.lit("linear"), seed=(s % 5).cast("bigint"),
        head_config=struct(sha256=F.lit("h")), train=struct(manifest=F.when(s % 3 == 0, "data/x_v1.jsonl").otherwise("data/x_v1.jsonl+y_v2.jsonl")),
    )
    runs = table(spark, d, "supplier").select(F.concat(F.lit("r"), s.cast("string")).alias("run_id"), run.alias("run"))
    n, none = F.col("n_nationkey"), F.lit(None).cast("string")
    wanted = table(spark, d, "nation").select(
        n.alias("no"), F.concat(F.lit("b"), (n % 5).cast("string")).alias("backbone_id"), F.when(n % 3 != 0, 224).alias("res"), none.alias("tokens"), F.lit("linear").alias("head"), (n % 6).cast("bigint").alias("seed"),
        none.alias("head_config_sha256"), F.when(n % 2 == 0, F.array(F.lit("x_v1"), F.lit("y_v2"))).alias("train_manifests"),
    )
    return caches.select_runs(runs, wanted).select("no", "state", "run_id")


@query("""select c_custkey as k, sha256('{"cache_key": "' || c_name || '", "config_sha256": "c", "fitter_version": 1, "run_id": "r\\"' || cast(c_custkey as varchar) || '", "tokens": "cls", "train": ["m", "train"], "val": ["m", "val"]}') as inputs_sha256 from customer""")
def inputs_digest(spark: SparkSession, d: str) -> DataFrame:
    k, lit = F.col("c_custkey"), F.lit
    rows = table(spark, d, "customer").select(k.alias("k"), F.col("c_name").alias("cache_key"), lit("c").alias("config_sha256"), F.concat(lit('r"'), k.cast("string")).alias("run_id"), lit("cls").alias("tokens"), lit("m").alias("manifest_sha256"), lit("train").alias("train_split"), lit("val").alias("val_split"))
    return rows.select("k", caches.inputs_digest(1).alias("inputs_sha256"))


_FIELDS = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("group_keys", T.StringType()), T.StructField("notes", T.StringType())])
_KEYS = T.StructType([T.StructField("date", T.StringType()), T.StructField("region", T.StringType())])


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    part = lambda ok, text: F.when(ok, F.lit(text))
    body = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(part(k % 5 != 0, '"image_id":"a"'), part(k % 7 != 0, '"sha256":null'), F.when(k % 3 == 0, '"group_keys":{"date":"x"}').when(k % 11 != 0, '"group_keys":null'), F.lit('"notes":"n"'))), ","), F.lit("}"))
    return table(spark, d, "events").select(k.alias("row_no"), body.alias("body"))


@query("""select 'missing_field' as reason, event_id as row_no, concat_ws(', ', case when event_id % 5 = 0 then 'image_id' end, case when event_id % 7 = 0 then 'sha256' end, case when event_id % 3 <> 0 and event_id % 11 = 0 then 'group_keys' end, case when event_id % 3 = 0 then 'group_keys.region' end) as message
from events where event_id % 5 = 0 or event_id % 7 = 0 or event_id % 3 = 0 or event_id % 11 = 0""")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return validate.missing_fields(_bodies(spark, d), "body", _FIELDS, {"group_keys": _KEYS})


@query("""select 'bad_fields' as reason, event_id as row_no, concat_ws(',', case when event_id % 5 <> 0 then 'image_id' end, case when event_id % 7 <> 0 then 'sha256' end, case when event_id % 3 = 0 or event_id % 11 <> 0 then 'group_keys' end, 'notes') as message
from events where event_id % 5 = 0 or event_id % 7 = 0 or (event_id % 3 <> 0 and event_id % 11 = 0)""")
def wrong_fields(spark: SparkSession, d: str) -> DataFrame:
    return validate.wrong_fields(_bodies(spark, d), "body", _FIELDS)


@query(f"""with {MANIFEST} select case when id % 13 = 0 then 'missing_file' else 'sha256_mismatch' end as reason, id as row_no, path as message from manifest where id % 13 = 0 or id % 29 = 0""")
def file_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d).withColumnRenamed("id", "row_no")
    files = rows.where("row_no % 13 <> 0").select("path", F.when(F.col("row_no") % 29 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return validate.file_violations(rows, files)


@query("""select 0 as source_no, c_custkey as k, c_nationkey as nation, null as extra from customer union all select 1, s_suppkey, s_nationkey, s_name from supplier""")
def union_order(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return ordering.union_in_order([a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("extra"))])


@query("""select user_id, event_type, min(event_id) as event_id from events group by 1, 2""")
def distinct_order(spark: SparkSession, d: str) -> DataFrame:
    return ordering.distinct_in_order(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"])


@query("""with r as (select o_orderkey as id, 't' || cast(o_custkey % 3 as varchar) as test_manifest, 'm' as train_manifest, o_orderpriority as backbone_id, 224 as res, 'cls' as token_type, 'h' as head, 1.0 as coverage, 'k' || cast(o_orderkey as varchar) as metric, case when o_orderkey % 4 > 0 then o_orderkey % 4 end as seed from orders)
select id, row_number() over (order by test_manifest, train_manifest, backbone_id, res, token_type, head, coverage, metric, seed nulls first) as place from r""")
def results_sorted(spark: SparkSession, d: str) -> DataFrame:
    k, lit = F.col("o_orderkey"), F.lit
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.concat(lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("test_manifest"), lit("m").alias("train_manifest"), F.col("o_orderpriority").alias("backbone_id"), lit(224).alias("res"), lit("cls").alias("token_type"),
        lit("h").alias("head"), lit(1.0).alias("coverage"), F.concat(lit("k"), k.cast("string")).alias("metric"), F.when(k % 4 > 0, k % 4).alias("seed"),
    )
    return ranks.numbered(rows, ordering.results_order(), "place").select("id", "place")


@query(f"""with {MANIFEST}, r as (select distinct class_raw, path from manifest), n as (select class_raw, count(*) as n from manifest group by 1)
select class_raw, n, (select string_agg(path, ', ' order by path) from (select path from r where r.class_raw = n.class_raw order by path limit 5)) as shown, greatest((select count(path) from r where r.class_raw = n.class_raw) - 5, 0) as more from n""")
def shown_items(spark: SparkSession, d: str) -> DataFrame:
    return ordering.shown(manifest(spark, d), ["class_raw"], "path", 5)


@query("""with r as (select event_type, cast(user_id % 3 as integer) as g, avg(case when value > 200 then value end) as v from events group by 1, 2) select event_type, g, round(v, 6) as v, case when v is null then 'no accepted row' end as skipped from r""")
def skipped_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).cast("int").alias("g")).agg(F.avg(F.when(F.col("value") > 200, F.col("value"))).alias("v")).withColumn("coverage", F.lit(0.9))
    return metrics.reported(rows, ["event_type", "g"], "v", "coverage", "no accepted row").select("event_type", "g", F.round("v", 6).alias("v"), "skipped")


@query(f"""with {MANIFEST}, f as (select sha256, arg_min(path, id) as first from manifest group by 1) select sha256, path from manifest join f using (sha256) where path <> first""")
def dup_path_rows(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_paths(manifest(spark, d), "sha256", ["id"], "path")


@query("""select k, name, v from (select user_id as k, event_type as name, event_id as v, row_number() over (partition by user_id order by event_type, event_id) as r from (select user_id, event_type, min(event_id) as event_id from events group by 1, 2)) where r = 1""")
def first_cache(spark: SparkSession, d: str) -> DataFrame:
    """Of the features that several caches hold for a digest, those of the first cache by name."""
    held = table(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("name")).agg(F.min("event_id").alias("v"))
    return caches.first_cache(held, "k", "name")


_META = {"backbone_id": "dé", "weights_sha256": "w", "resolution": 224, "preprocess_string": "p=1", "compute_dtype": "float32", "manifest_sha256": "m"}


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as rows of an archive, 256 to a shard."""
    rows = table(spark, d, "embeddings").where("embedding is not null")
    name = F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 12, "0"))
    return rows.select(F.expr("vec_id div 256").alias("shard"), name.alias("image_id"), F.sha2(name, 256).alias("sha256"), F.col("embedding").alias("cls"), F.transform("embedding", lambda x: -x).alias("meanpatch"))


@query("""select 'v' || lpad(cast(vec_id as varchar), 12, '0') as image_id, cast(len(embedding) as integer) as width, round(cast(embedding[1] as double), 6) as first, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total from embeddings where embedding is not null""")
def archive_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features written as archives and read back by the data source, two of their four arrays."""
    folder = fresh_path(spark, "archives")
    archives.write_archives(_features(spark, d), folder, "shard", _META, storage="float32").write.format("noop").mode("overwrite").save()
    found = archives.read_archives(spark, folder, ["image_id", "cls"], "m")
    total = F.aggregate("cls", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("image_id", F.size("cls").alias("width"), F.round(F.element_at("cls", 1).cast("double"), 6).alias("first"), F.round(total, 4).alias("total"))


def _broken(shard: str, meta: dict) -> dict | None:
    """Each shard but every eighth has one fault, by its number."""
    k = int(shard) % 8
    change = {1: {"weights_sha256": None}, 2: {"cache_key": "x"}, 3: {"manifest_sha256": "other"}, 4: {"shapes": {**meta["shapes"], "cls": [1, 1]}}, 5: {"storage_dtype": "float16"}, 6: {"n_images": meta["n_images"] + 1}}
    return None if k == 7 else {**meta, **change.get(k, {})}


@query("""select * from (select cast(vec_id // 16 as varchar) as shard, ['', 'lacks_key_field', 'wrong_key', 'other_manifest', 'shape', 'dtype', 'n_images', 'missing'][(vec_id // 16) % 8 + 1] as problem from embeddings where embedding is not null group by vec_id // 16) where problem <> ''""")
def archive_faults(spark: SparkSession, d: str) -> DataFrame:
    """Archives with a fault each, found by their sidecars and headers."""
    folder = fresh_path(spark, "archives")
    rows = _features(spark, d).withColumn("shard", F.expr("cast(substring(image_id, 2) as bigint) div 16"))
    written = staged(archives.write_archives(rows, folder, "shard", _META, storage="float32", change=_broken), "written")
    name = F.regexp_extract("path", r"([0-9]+)\.npz$", 1)
    return archives.archive_problems(written, "m").select(name.alias("shard"), "problem")
