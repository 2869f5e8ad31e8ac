"""Gates, the decision service and source records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.scalars import licence
from strataforge.functions.vectors import as_double, softmax
from strataforge.operators import gates, service
from strataforge.plans import query
from strataforge.plans.tables import table
from strataforge.schemas import REQUESTS
from strataforge.session import fresh_path
from strataforge.sources.records import read_records, record_files
from strataforge.streaming import decisions
from strataforge.streaming import requests as rq


@query("""with t as (select o_custkey, o_orderkey, case o_orderpriority when '1-URGENT' then 'holdout_unknown' when '2-HIGH' then 'test_only' when '5-LOW' then null else 'train_eval' end as role,
 row_number() over (partition by o_custkey order by o_orderkey) = 1 as head from orders)
select o_custkey, o_orderkey, role, 'role_not_trainable' as reason from t where not (coalesce(role, '') = 'train_eval' or coalesce(role, '') = 'test_only' and not head)""")
def role_gate(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    role = F.when(p == "1-URGENT", "holdout_unknown").when(p == "2-HIGH", "test_only").when(p != "5-LOW", "train_eval")
    return gates.role_gate(table(spark, d, "orders").select("o_custkey", "o_orderkey", role.alias("role")), "o_custkey", "o_orderkey", "role")


@query("""select o_orderkey, o_custkey from orders where o_orderstatus <> 'F' and o_custkey in (select o_custkey from orders where o_orderstatus = 'F')""")
def own_validation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return gates.own_validation(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), "o_custkey").select("o_orderkey", "o_custkey")


@query("""select l_partkey, l_returnflag, count(*) as n from lineitem group by 1, 2 having count(*) < 20""")
def too_few_rows(spark: SparkSession, d: str) -> DataFrame:
    """Groups that are too small for the strictest of three coverages."""
    return gates.too_few(table(spark, d, "lineitem"), ["l_partkey", "l_returnflag"], gates.slice_needed([0.8, 0.9, 0.95]))


@query("""select l_orderkey, count(distinct l_returnflag) as n_keys from lineitem group by 1 having count(distinct l_returnflag) > 1""")
def mixed_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return gates.mixed_cache_keys(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("""with r as (select o_custkey, case o_orderpriority when '1-URGENT' then 'healthy' when '2-HIGH' then 'rust' when '3-MEDIUM' then 'anthracnose' else 'unknown_als' end as klass, case when o_orderstatus = 'F' then 'train' else 'val' end as split from orders),
t as (select o_custkey, list_sort(coalesce(list(distinct klass) filter (where split = 'train'), [])) as t, coalesce(list(distinct klass) filter (where split = 'val'), []) as v from r group by 1),
k as (select o_custkey, v, list_filter(t, lambda x: x <> 'unknown_als') as own, list_filter(t, lambda x: x = 'unknown_als') as odd from t)
select o_custkey, 'stray' as reason, array_to_string(odd, '+') as classes from k where len(odd) > 0
union all select o_custkey, 'single', array_to_string(own, '+') from k where len(own) < 2
union all select o_custkey, 'unvalidated', array_to_string(list_filter(own, lambda x: not list_contains(v, x)), '+') from k where len(list_filter(own, lambda x: not list_contains(v, x))) > 0""")
def class_gate(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    klass = F.when(p == "1-URGENT", "healthy").when(p == "2-HIGH", "rust").when(p == "3-MEDIUM", "anthracnose").otherwise("unknown_als")
    rows = table(spark, d, "orders").select("o_custkey", klass.alias("klass"), F.when(F.col("o_orderstatus") == "F", "train").otherwise("val").alias("split"))
    return gates.class_gate(rows, "o_custkey", "klass", "split")


@query("""select p_type as klass, count(distinct p_brand) as n_tables from part where p_type is not null group by 1 having count(distinct p_brand) = (select count(distinct p_brand) from part)""")
def shared_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.col("p_type").alias("klass"))
    return gates.shared_classes(rows, "p_brand", "klass")


@query("""with f as (select 'm' || cast(c_custkey as varchar) || '_v1' as manifest, sha256(c_mktsegment) as sha256 from customer), t as (select 'm' || cast(o_custkey as varchar) || '_v1' as manifest, sha256(o_orderpriority) as sha256, o_orderkey from orders)
select o_orderkey, t.manifest, case when f.sha256 is null then 'write' when f.sha256 = t.sha256 then 'same' else 'refuse' end as action, case when f.sha256 <> t.sha256 then replace(t.manifest, '_v1', '_v2') end as next_name from t left join f using (manifest)""")
def target_action(spark: SparkSession, d: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("m"), F.col(k).cast("string"), F.lit("_v1")).alias("manifest")
    frozen = table(spark, d, "customer").select(name("c_custkey"), F.sha2("c_mktsegment", 256).alias("sha256"), F.lit("2024-01-01").alias("frozen_at"))
    targets = table(spark, d, "orders").select("o_orderkey", name("o_custkey"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return gates.target_action(targets, frozen).select("o_orderkey", "manifest", "action", "next_name")


@query("""with t as (select o_custkey as c_custkey, bool_and(o_orderstatus = 'F') as f from orders group by 1)
select c_custkey, c_acctbal > 0 and c_mktsegment <> 'BUILDING' and coalesce(f, true) as quotable,
 case when c_acctbal <= 0 then 'not quotable' when c_mktsegment = 'BUILDING' or not coalesce(f, true) then 'a manifest is not frozen: not quotable' else '' end as note from customer left join t using (c_custkey)""")
def quotable_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("quotable"), (F.col("c_mktsegment") != "BUILDING").alias("train_frozen"), F.lit(None).cast("string").alias("notes"))
    targets = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("frozen"))
    return gates.quotable(runs, targets, "c_custkey")


@query("""select p_name as model_version, case when p_size <= 10 then 'not_quotable' when p_brand <> p_type then 'stale_card' when p_name in (select c_name from customer) then 'present' else 'register' end as action from (select p_name, p_size, p_brand, case when p_retailprice > 1000 then p_brand else p_type end as p_type from part)""")
def registrable(spark: SparkSession, d: str) -> DataFrame:
    fresh = F.when(F.col("p_retailprice") > 1000, F.col("p_brand")).otherwise(F.col("p_type"))
    models = table(spark, d, "part").select(F.col("p_name").alias("model_version"), (F.col("p_size") > 10).alias("quotable"), F.col("p_brand").alias("card_sha256"), fresh.alias("fresh_sha256"))
    return gates.registrable(models, table(spark, d, "customer").select(F.col("c_name").alias("model_version")))


@query("""select distinct o_custkey as shard, o_orderpriority as cache_key from orders where not exists (select 1 from customer where c_custkey = o_custkey and (c_mktsegment = 'BUILDING' and o_orderpriority = '1-URGENT' or c_mktsegment <> 'BUILDING' and o_orderpriority = '5-LOW'))""")
def shards_left(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("shard"), F.col("o_orderpriority").alias("cache_key"))
    done = table(spark, d, "customer").select(F.col("c_custkey").alias("shard"), F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").otherwise("5-LOW").alias("cache_key"))
    return gates.shards_left(rows, done, ["cache_key"])


@query("""with c as (select o_custkey as k, count(*) as n_rows, count(distinct o_orderstatus) as s from orders group by 1), p as (select c_custkey from customer where c_acctbal > 0)
select 'parent_missing' as reason, 'c' || cast(k as varchar) as key, n_rows from c where k not in (select c_custkey from p) union all select 'group_straddles_split', 'c' || cast(k as varchar), n_rows from c where s > 1""")
def crop_violations(spark: SparkSession, d: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("c"), F.col(k).cast("string"))
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    crops = table(spark, d, "orders").select(name("o_custkey").alias("parent_image_id"), split.alias("split"))
    return gates.crop_violations(crops, table(spark, d, "customer").where("c_acctbal > 0").select(name("c_custkey").alias("image_id")))


#: Cut-offs (confidence, distance) of two coverages for the demo service.
TAU = {0.8: (0.5, 0.3), 0.9: (0.4, 0.6)}

_REQUEST = """'{"contract_version": "v0", "frame": {"frame_uid": "f' || cast(event_id as string) || '", "uri": "a/b.jpg", "sha256": "' || case when event_type = 'error' then 'zz' else sha256(cast(user_id as string)) end || '", "width": 4, "height": 3}, "metadata": {"site_id": "s", "plot_id": "p", "zone_id": "open", "timestamp_utc": "2024-01-01T00:00:00Z", "pose": {"x": 0, "y": 0, "z": 1.5, "yaw": 0.5, "frame_id": "plot", "source": "rtk"}, "platform": "cart", "camera": {"model": "m", "exposure_us": null, "gain": null, "flash": true, "white_balance": "auto"}, "illumination_mode": "flash", "sowing_batch": "b", "bbch": 12}, "request_id": "q", "options": {"coverage_target": ' || case when event_type = 'click' then '0.8' when event_type = 'signup' then '0.77' else '0.9' end || '}}'"""


def _requests(events: DataFrame) -> DataFrame:
    """Events as requests. Checking a request takes far longer than reading its event, so events are dealt to all cores first."""
    dealt = events.select("event_id", "user_id", "event_type").repartition(4 * events.sparkSession.sparkContext.defaultParallelism)
    return dealt.select("event_id", F.expr(_REQUEST.replace("sha256(cast(user_id as string))", "sha2(cast(user_id as string), 256)")).alias("body"))


def _served(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    logits = F.array((1 + n % 3).cast("double"), (1 + n % 2).cast("double"), F.lit(1.0))
    return table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"), logits.alias("v"), (F.abs("c_acctbal") / 10000).alias("knn"))


_ANSWERS = """with f as (select c_custkey as user_id, c_nationkey as nation, abs(c_acctbal) / 10000 as knn, c_mktsegment as seg from customer where c_mktsegment <> 'BUILDING'),
a as (select event_id, event_type, nation, knn, cast(case when event_type = 'click' then 0.8 else 0.9 end as double) as coverage, [1 + nation % 3, 1 + nation % 2, 1.0] as z, f.user_id as held from events left join f using (user_id)),
b as (select *, case when event_type in ('error', 'signup') then 422 when held is null then 501 else 200 end as status, list_max(z) as top, list_sum(list_transform(z, lambda v: exp(v))) as whole from a),
c as (select *, exp(top) / whole as conf, case when coverage = 0.8 then 0.5 else 0.4 end as t1, case when coverage = 0.8 then 0.3 else 0.6 end as t2 from b),
e as (select *, case when status = 200 then case when conf < t1 then 'low_confidence' when knn > t2 then 'far_from_training' end end as why from c)
select event_id, status, case when status = 200 then ['a', 'b', 'c'][list_position(z, top)] end as top1, case when status = 200 then case when why is null then 'predict' else 'abstain' end end as decision, why as abstain_reason,
 case event_type when 'error' then 'frame.sha256' when 'signup' then 'options.coverage_target' else '' end as errors, case when status <> 422 then coverage end as coverage, case when status = 200 then round(conf, 6) end as max_prob from e"""


@query(_ANSWERS)
def predict_batch(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered in one plan: contract, features by digest, scores, decisions."""
    requests = _requests(table(spark, d, "events"))
    features = _served(spark, d)
    answers = service.predict(requests, features, softmax, TAU, 0.9, ["a", "b", "c"])
    return answers.select("event_id", "status", "top1", "decision", "abstain_reason", F.array_join("errors", ",").alias("errors"), "coverage", "max_prob")


@query(_ANSWERS)
def stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as a stream: answers, quarantine and log of each batch; of two caches the first by name answers."""
    out, marks = fresh_path(spark, "decisions"), fresh_path(spark, "decisions-marks")
    requests = _requests(rq.stream(spark, d, "events"))
    held = _served(spark, d)
    both = held.withColumn("cache", F.lit("a")).union(held.withColumn("v", F.transform("v", lambda x: -x)).withColumn("cache", F.lit("b")))
    decisions.serve(requests, both, softmax, TAU, 0.9, ["a", "b", "c"], "event_id", out, marks)
    answers = rq.batches(spark, f"{out}/answers", "event_id bigint, status int, coverage double, top1 string, decision string, abstain_reason string, max_prob double")
    bad = rq.batches(spark, f"{out}/quarantine", "event_id bigint, status int, errors array<string>").select("event_id", "status", F.array_join("errors", ",").alias("errors"))
    return answers.withColumn("errors", F.lit("")).unionByName(bad, allowMissingColumns=True).select("event_id", "status", "top1", "decision", "abstain_reason", "errors", "coverage", "max_prob")


@query("""with a as (select case when event_type in ('error', 'signup') then 422 when c_custkey is null or c_mktsegment = 'BUILDING' then 501 else 200 end as status from events left join customer on user_id = c_custkey) select cast(status as bigint) as status, count(*) as n from a group by 1""")
def request_log(spark: SparkSession, d: str) -> DataFrame:
    """Requests by status, from the log that the service writes."""
    out, marks = fresh_path(spark, "logged"), fresh_path(spark, "logged-marks")
    decisions.serve(_requests(rq.stream(spark, d, "events")), _served(spark, d), softmax, TAU, 0.9, ["a", "b", "c"], "event_id", out, marks)
    return rq.batches(spark, f"{out}/log", REQUESTS).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select s_suppkey, s_nationkey % 5 as k, cast(s_suppkey as varchar) as t from supplier)
select s_suppkey, case k when 0 then 'https://zenodo.org/records/' || t when 1 then 'https://huggingface.co/datasets/o/' || t || '/tree/main' when 2 then 'https://data.mendeley.com/datasets/' || t || '/2' when 3 then 'https://dataverse.harvard.edu/dataset.xhtml?persistentId=doi:10.1/' || t end as record_url,
 case k when 0 then '1.' || t when 1 then 'main' when 2 then '2' when 3 then '4.0' end as version, case k when 0 then 'CC-BY-4.0' when 1 then 'MIT' when 2 then 'CC0-1.0' when 3 then 'unknown' end as licence,
 case k when 4 then 'unknown_kind' end as reason, case k when 0 then 'a.zip|5|md5:' || t when 1 then 'b.zip|6|sha256:' || t when 2 then 'c.zip|7|sha256:' || t when 3 then 'd.zip|8|MD5:' || t end as file from s""")
def source_records(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("s_suppkey").cast("string")
    k = F.col("s_nationkey") % 5
    text = lambda form, *more: F.format_string(form, *([t] * form.count("%s")))
    body = (
        F.when(k == 0, text('{"doi": "10.2/%s", "metadata": {"version": "1.%s", "publication_date": "2020-01-02", "title": "t", "license": "cc-by-4.0", "creators": [{"name": "n"}]}, "files": [{"key": "a.zip", "size": 5, "checksum": "md5:%s", "links": {"self": "u"}}], "stats": {"views": 3}}'))
        .when(k == 1, text('{"info": {"author": "x", "lastModified": "2021-05-06", "cardData": {"license": "mit"}}, "tree": [{"type": "directory", "path": "data"}, {"type": "file", "path": "data/b.zip", "size": 6, "lfs": {"oid": "%s"}}]}'))
        .when(k == 2, text('{"version": 2, "name": "t", "publish_date": "2022-01-01", "doi": {"id": "10.3/%s"}, "data_licence": {"short_name": "CC0 1.0"}, "contributors": [{"first_name": "a", "last_name": "b"}], "files": [{"id": "i", "filename": "c.zip", "size": 7, "content_details": {"sha256_hash": "%s"}}]}'))
        .otherwise(text('{"status": "OK", "data": {"latestVersion": {"versionNumber": 4, "versionMinorNumber": 0, "termsOfUse": "own words", "files": [{"dataFile": {"id": 9, "filename": "d.zip", "filesize": 8, "checksum": {"type": "MD5", "value": "%s"}}}]}}}'))
    )
    kind = F.when(k == 0, "zenodo").when(k == 1, "huggingface").when(k == 2, "mendeley").when(k == 3, "dataverse").otherwise("ftp")
    pinned = F.when(k == 1, F.concat(F.lit("o/"), t, F.lit("@main"))).when(k == 2, F.concat(t, F.lit(".2"))).when(k == 3, F.concat(F.lit("10.1/"), t)).otherwise(t)
    records = read_records(table(spark, d, "supplier").select("s_suppkey", kind.alias("kind"), pinned.alias("pinned"), body.alias("body")))
    files = record_files(records, ["s_suppkey"]).select("s_suppkey", F.concat_ws("|", "name", "size", "checksum").alias("file"))
    return records.join(files, "s_suppkey", "left").select("s_suppkey", "record_url", "version", F.when(F.col("reason").isNull(), licence(F.col("licence_stated"))).alias("licence"), "reason", "file")


@query()
def grey_phashes(spark: SparkSession, d: str) -> DataFrame:
    """Perceptual hashes of vectors laid out as grey images (outer products with themselves, cut to 32 x 32)."""
    from strataforge.operators.extract import grey_phashes as hashes

    e = table(spark, d, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"))
    halves = F.flatten(F.transform(F.slice("v", 1, 32), lambda a: F.transform(F.slice("v", 33, 32), lambda b: a * b)))
    return hashes(e.select("vec_id", halves.alias("pixels")), "vec_id", "pixels")
