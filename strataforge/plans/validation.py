"""Validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.scalars import licence
from strataforge.operators import crops, frames, ledger, validate
from strataforge.plans import query
from strataforge.plans.tables import table

_M = """m as (select o_orderkey as row_no, case when o_orderkey % 13 = 0 then 'v1' else '1' end as manifest_version, 'd_' || sha256(cast(o_orderkey as varchar))[1:16] as image_id, 'd' as dataset,
 case when o_orderkey % 17 = 0 then 'zz' else sha256(cast(o_orderkey as varchar)) end as sha256, case when o_orderkey % 19 = 0 then null else sha256(cast(o_orderkey as varchar))[1:16] end as phash,
 case o_orderpriority when '1-URGENT' then 'healthy' when '2-HIGH' then 'rust' when '3-MEDIUM' then 'unknown_als' when '5-LOW' then 'none' else 'other' end as class_km2,
 case o_orderstatus when 'F' then 'train' when 'O' then 'val' else 'test' end as split, case when o_orderkey % 23 = 0 then 'unknown' else 'MIT' end as licence,
 case when o_orderkey % 29 = 0 then '/abs' else 'rel/x.jpg' end as path, case when o_orderkey % 31 = 0 then 'blocked:nothing' else 'blocked:district' end as split_rule, o_custkey % 20 as grp from orders)"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = F.sha2(k.cast("string"), 256)
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        k.alias("row_no"),
        F.when(k % 13 == 0, "v1").otherwise("1").alias("manifest_version"),
        F.concat(F.lit("d_"), F.substring(h, 1, 16)).alias("image_id"),
        F.lit("d").alias("dataset"),
        F.when(k % 17 == 0, "zz").otherwise(h).alias("sha256"),
        F.when(k % 19 != 0, F.substring(h, 1, 16)).alias("phash"),
        F.when(p == "1-URGENT", "healthy").when(p == "2-HIGH", "rust").when(p == "3-MEDIUM", "unknown_als").when(p == "5-LOW", "none").otherwise("other").alias("class_km2"),
        F.when(s == "F", "train").when(s == "O", "val").otherwise("test").alias("split"),
        F.when(k % 23 == 0, "unknown").otherwise("MIT").alias("licence"),
        F.lit("jpeg").alias("format"),
        F.lit(10).alias("width"),
        F.lit(10).alias("height"),
        F.when(k % 29 == 0, "/abs").otherwise("rel/x.jpg").alias("path"),
        F.when(k % 31 == 0, "blocked:nothing").otherwise("blocked:district").alias("split_rule"),
        (F.col("o_custkey") % 20).alias("grp"),
    )


@query(f"""with {_M}
select 'bad_value' as reason, row_no, 'manifest_version' as message from m where manifest_version = 'v1'
union all select 'bad_value', row_no, 'sha256' from m where sha256 = 'zz'
union all select 'bad_value', row_no, 'phash' from m where phash is null
union all select 'bad_value', row_no, 'class_km2' from m where class_km2 = 'other'
union all select 'bad_value', row_no, 'path' from m where path = '/abs'
union all select 'bad_value', row_no, 'unknown in test' from m where class_km2 = 'unknown_als' and split = 'test'
union all select 'bad_split_rule', row_no, 'split_rule' from m where split_rule = 'blocked:nothing'
union all select 'unknown_in_train', row_no, 'class' from m where class_km2 = 'unknown_als' and split in ('train', 'val')
union all select 'unlabelled_in_train', row_no, 'class' from m where class_km2 = 'none' and split in ('train', 'val')
union all select 'licence_unknown', row_no, 'licence' from m where licence = 'unknown'""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return validate.violations(_manifest(spark, d), validate.manifest_rules())


@query("""with e as (select event_id as row_no, sha256(cast(event_id * 2 // 3 as varchar))[1:8] as image_id from events),
n as (select row_no, image_id, row_number() over (order by row_no) - 1 as pos from e), f as (select image_id, min(pos) as first from n group by 1),
x as (select pos as row_no, image_id, lag(image_id) over (order by pos) as prev, pos > first as dup from n join f using (image_id))
select case when dup then 'duplicate_image_id' else 'rows_not_sorted' end as reason, row_no, image_id as message from x where dup or image_id < prev""")
def validate_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_no"), F.substring(F.sha2(F.expr("event_id * 2 div 3").cast("string"), 256), 1, 8).alias("image_id"))
    return validate.order_violations(rows, "image_id")


@query(f"""with {_M} select cast(grp as varchar) as grp, string_agg(distinct split, ',' order by split) as splits, count(*) as n from m group by grp having count(distinct split) > 1""")
def validate_groups(spark: SparkSession, d: str) -> DataFrame:
    return validate.straddling(_manifest(spark, d), "grp")


@query(f"""with {_M}, t as (select class_km2, case when class_km2 = 'rust' and split = 'test' then 'val' else split end as split from m where class_km2 in ('healthy', 'rust', 'anthracnose')), c as (select distinct class_km2 from t), s as (select unnest(['train', 'val', 'test']) as lacks)
select class_km2, lacks from c, s where not exists (select 1 from t where t.class_km2 = c.class_km2 and t.split = s.lacks)""")
def class_missing_from_split(spark: SparkSession, d: str) -> DataFrame:
    return validate.missing_classes(_manifest(spark, d).withColumn("split", F.when((F.col("class_km2") == "rust") & (F.col("split") == "test"), "val").otherwise(F.col("split"))))


_R = """r as (select event_id as row_no, case when event_id % 7 = 0 then '2024-01-01' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as ts, case when event_id % 11 = 0 then 'N9' else 'N1' end as number,
 case event_type when 'click' then 'macro_f1' when 'view' then 'recall:a' when 'error' then 'recall:zz' when 'signup' then 'auroc:conf' else 'macro_f1:x' end as metric, value, case when event_id % 13 = 0 then value + 1 else value - 1 end as ci_low, value as ci_high,
 case when event_id % 17 = 0 then 0 else 5 end as n, case when event_id % 19 = 0 then 'x+y' else 'x' end as train_manifest, event_id % 23 = 0 as loose from events)"""


@query(f"""with {_R}
select 'bad_value' as reason, row_no, 'ts' as message from r where length(ts) = 10
union all select 'bad_number', row_no, 'number' from r where number = 'N9'
union all select 'bad_metric', row_no, 'metric' from r where metric in ('recall:zz', 'macro_f1:x')
union all select 'bad_value', row_no, 'ci_low, ci_high' from r where ci_low > ci_high
union all select 'bad_value', row_no, 'n' from r where n = 0
union all select 'bad_hash', row_no, 'train_manifest_sha256' from r where train_manifest = 'x+y'
union all select 'manifest_not_frozen', row_no, 'sha256' from r where loose""")
def validate_results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.col("event_type")
    good, loose = "a" * 64, "b" * 64
    rows = table(spark, d, "events").select(
        k.alias("row_no"),
        F.when(k % 7 == 0, "2024-01-01").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"),
        F.when(k % 11 == 0, "N9").otherwise("N1").alias("number"),
        F.when(kind == "click", "macro_f1").when(kind == "view", "recall:a").when(kind == "error", "recall:zz").when(kind == "signup", "auroc:conf").otherwise("macro_f1:x").alias("metric"),
        "value",
        (F.when(k % 13 == 0, F.col("value") + 1).otherwise(F.col("value") - 1)).alias("ci_low"),
        F.col("value").alias("ci_high"),
        F.when(k % 17 == 0, 0).otherwise(5).alias("n"),
        *[F.lit(v).alias(c) for c, v in (("backbone_id", "b"), ("token_type", "cls"), ("head", "linear"), ("train_split", "train"), ("run_id", "r"), ("res", 224), ("test_manifest", "y"), ("test_split", "test"), ("split_rule", "test_only"), ("coverage", 1.0), ("quotable", True))],
        F.lit(None).cast("bigint").alias("seed"),
        F.when(k % 19 == 0, "x+y").otherwise("x").alias("train_manifest"),
        F.lit(good).alias("train_manifest_sha256"),
        F.when(k % 23 == 0, loose).otherwise(good).alias("test_manifest_sha256"),
        F.array(F.lit("a"), F.lit("b")).alias("classes"),
        F.lit(None).cast("string").alias("superseded"),
    )
    return validate.violations(rows, validate.result_rules([good]))


_BODY = """'{"contract_version": "v0", "frame": {"frame_uid": "f' || cast(event_id as string) || '", "uri": "a/b.jpg", "sha256": "' || case when event_id % 7 = 0 then 'zz' else repeat('a', 64) end || '", "width": ' || cast(event_id % 5 as string) || ', "height": 3}, "metadata": {"site_id": "s", "plot_id": "p", "zone_id": "' || case when event_id % 11 = 0 then 'a b' else 'open' end || '", "timestamp_utc": "2024-01-01T00:00:00Z", "pose": {"x": 0, "y": 0, "z": 1.5, "yaw": ' || case when event_id % 13 = 0 then '4' else '0.5' end || ', "frame_id": "plot", "source": "rtk"' || case when event_id % 17 = 0 then ', "more": 1' else '' end || '}, "platform": "' || case when event_id % 19 = 0 then 'drone' else 'cart' end || '", "camera": {"model": "m", "exposure_us": null, "gain": null, "flash": true, "white_balance": "auto"}, "illumination_mode": "flash", "sowing_batch": "b", "bbch": ' || case when event_id % 3 = 0 then 'null' else '12' end || case when event_id % 6 = 0 then ', "bbch_null_reason": "unknown"' else '' end || '}, "request_id": "' || case when event_id % 29 = 0 then '' else 'q' end || '", "options": {"coverage_target": ' || case when event_id % 31 = 0 then '0.77' else '0.9' end || case when event_id % 37 = 0 then ', "patch": 1' else '' end || '}' || case when event_id % 41 = 0 then ', "extra": 2' else '' end || '}'"""


def _bodies(spark: SparkSession, d: str, record: bool) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.expr(_BODY).alias("body"))
    # the contract covers the record alone: the envelope's own keys are cut off
    return rows.withColumn("body", F.regexp_replace("body", r', "request_id": .*$', "}")) if record else rows


_PATHS = """select event_id, array_to_string(list_sort(list_filter([{cases}], lambda x: x is not null)), ',') as errors from events"""


@query(
    _PATHS.format(
        cases=""" case when event_id % 7 = 0 then 'frame.sha256' end, case when event_id % 5 = 0 then 'frame.width' end, case when event_id % 11 = 0 then 'metadata.zone_id' end, case when event_id % 13 = 0 then 'metadata.pose.yaw' end,
 case when event_id % 17 = 0 then 'metadata.pose' end, case when event_id % 19 = 0 then 'metadata.platform' end, case when event_id % 3 = 0 and event_id % 6 <> 0 then 'metadata.bbch_null_reason' end"""
    )
)
def frame_contract(spark: SparkSession, d: str) -> DataFrame:
    return frames.with_frame_errors(_bodies(spark, d, True)).select("event_id", F.array_join("errors", ",").alias("errors"))


@query(
    _PATHS.format(
        cases="""case when event_id % 29 = 0 then 'request_id' end, case when event_id % 31 = 0 then 'options.coverage_target' end, case when event_id % 37 = 0 then 'options.patch' end, case when event_id % 41 = 0 then 'extra' end"""
    )
)
def request_envelope(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d, False).select("event_id", F.array_join(frames.envelope_errors(F.col("body"), [0.8, 0.9, 0.95]), ",").alias("errors"))


@query("""with b as (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as x, cast(l_partkey % 60 as bigint) as y, cast(l_suppkey % 50 + 1 as bigint) as w, cast(l_orderkey % 40 + 1 as bigint) as h, l_suppkey % 2 = 0 as turned from lineitem)
select l_orderkey, l_linenumber, l_partkey, case when not turned then 'stored' when s and not u then 'stored' when u and not s then 'upright' end as frame from (select *, x + w <= 80 and y + h <= 60 as s, x + w <= 60 and y + h <= 80 as u from b)""")
def box_frame(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    box = F.struct(F.col("l_quantity").cast("bigint").alias("x"), (F.col("l_partkey") % 60).alias("y"), (F.col("l_suppkey") % 50 + 1).alias("w"), (F.col("l_orderkey") % 40 + 1).alias("h"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", frames.box_frame(box, (F.lit(80), F.lit(60)), (F.lit(60), F.lit(80)), F.col("l_suppkey") % 2 == 0).alias("frame"))


@query("""with b as (select o_orderkey, unnest(range(o_orderkey % 4)) as box_index, o_orderkey % 90 as x, o_custkey % 70 as y, o_orderkey % 50 + 1 as w, o_custkey % 30 + 1 as h from orders),
g as (select o_orderkey, box_index, greatest(cast(floor((x + box_index) - cast(0.1 as decimal(9,4)) * cast(w as decimal(12,0))) as bigint), 0) as x0, greatest(cast(floor(y - cast(0.1 as decimal(9,4)) * cast(h as decimal(12,0))) as bigint), 0) as y0,
 least(cast(ceil((x + box_index) + w + cast(0.1 as decimal(9,4)) * cast(w as decimal(12,0))) as bigint), 80) as x1, least(cast(ceil(y + h + cast(0.1 as decimal(9,4)) * cast(h as decimal(12,0))) as bigint), 60) as y1 from b)
select o_orderkey, cast(box_index as integer) as box_index, x0, y0, x1, y1 from g where x1 > x0 and y1 > y0""")
def crop_rects(spark: SparkSession, d: str) -> DataFrame:
    """Boxes exploded, grown by a tenth of their sides, and clipped."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = k % 4
    boxes = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct((k % 90 + i).alias("x"), (c % 70).alias("y"), (k % 50 + 1).alias("w"), (c % 30 + 1).alias("h"))))
    rows = frames.explode_boxes(o.select("o_orderkey", boxes.alias("boxes")))
    rect = frames.grown(F.col("box"), "0.1", F.lit(80).cast("bigint"), F.lit(60).cast("bigint"))
    return rows.select("o_orderkey", "box_index", rect.alias("r")).where("r is not null").select("o_orderkey", "box_index", "r.*")


@query("""select event_id, case event_type when 'click' then 'CC-BY-4.0' when 'view' then 'CC0-1.0' when 'error' then 'MIT' when 'signup' then 'unknown' else 'unknown' end as licence from events""")
def licence_normalise(spark: SparkSession, d: str) -> DataFrame:
    e, kind = table(spark, d, "events"), F.col("event_type")
    stated = (
        F.when(kind == "click", F.array(F.lit(" CC BY 4.0"), F.lit("https://creativecommons.org/licenses/by/4.0/")))
        .when(kind == "view", F.array(F.lit("CC0")))
        .when(kind == "error", F.array(F.lit("other words"), F.lit("MIT ")))
        .when(kind == "signup", F.array(F.lit("mit"), F.lit("cc0")))
        .otherwise(F.array(F.lit("free for all")))
    )
    return e.select("event_id", licence(stated).alias("licence"))


_STATUS = """case when event_type = 'error' then 422 else 200 end as status, case when event_type in ('error', 'view') then 'abstain' else 'predict' end as decision"""


@query(f"""select state, count(*) as n from (select case when status = 200 and decision = 'predict' then 'OK' when status = 200 then 'watch' when status = 422 then 'absent' else 'other' end as state from (select {_STATUS} from events)) group by state""")
def routing_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(_state().alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _state():
    kind = F.col("event_type")
    return ledger.routing(F.when(kind == "error", 422).otherwise(200), F.when(kind.isin("error", "view"), "abstain").otherwise("predict"))


@query(f"""select user_id as plot, cast(ts as date) as day, count(*) filter (where state = 'OK') as n_ok, count(*) filter (where state = 'watch') as n_watch, count(*) filter (where state = 'absent') as n_absent
from (select user_id, ts, case when status = 200 and decision = 'predict' then 'OK' when status = 200 then 'watch' when status = 422 then 'absent' else 'other' end as state from (select user_id, ts, {_STATUS} from events)) group by 1, 2""")
def plot_visit_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("plot"), F.to_date("ts").alias("day"), _state().alias("state"))
    count = lambda s: F.sum((F.col("state") == s).cast("bigint"))
    return e.groupBy("plot", "day").agg(count("OK").alias("n_ok"), count("watch").alias("n_watch"), count("absent").alias("n_absent"))


@query("""with b as (select o_orderkey as id, unnest(range(o_orderkey % 4)) as k, o_orderkey % 60 as x, o_custkey % 70 as y, o_orderkey % 20 + 1 as w, o_custkey % 17 + 1 as h, nullif(o_custkey % 9, 0) as t0,
  ['leaf', 'spot', 'odd', 'no', 'new'][o_orderkey % 5 + 1] as raw, case o_orderkey % 2 when 0 then 'train' else 'test' end as own from orders),
f as (select *, coalesce(t0, 1) as t, case when t >= 5 then 60 else 80 end as uw, case when t >= 5 then 80 else 60 end as uh, (x + k + w <= 80 and y + h <= 60) as s, (x + k + w <= uw and y + h <= uh) as u from b),
g as (select *, case when t = 1 then 'stored' when s and not u then 'stored' when u and not s then 'upright' end as frame, case when frame = 'upright' then uw else 80 end as fw, case when frame = 'upright' then uh else 60 end as fh,
  greatest((10 * (x + k) - w) // 10, 0) as gx0, greatest((10 * y - h) // 10, 0) as gy0, least((10 * (x + k + w) + w + 9) // 10, fw) as gx1, least((10 * (y + h) + h + 9) // 10, fh) as gy1 from f),
m as (select *, case when t in (2, 3, 7, 8) then 80 - gx1 else gx0 end as a0, case when t in (2, 3, 7, 8) then 80 - gx0 else gx1 end as a1, case when t in (3, 4, 6, 7) then 60 - gy1 else gy0 end as b0, case when t in (3, 4, 6, 7) then 60 - gy0 else gy1 end as b1,
  (frame is not null and gx1 > gx0 and gy1 > gy0) as good, case raw when 'leaf' then 'healthy' when 'spot' then 'rust' when 'odd' then 'unknown_als' when 'no' then 'excluded' end as km2 from g)
select id, cast(k as integer) as box_index, frame, km2 as class_km2, case when km2 = 'unknown_als' then 'holdout_unknown' else own end as split,
 case when good then case when frame = 'upright' then gx0 when t < 5 then a0 else b0 end end as x0, case when good then case when frame = 'upright' then gy0 when t < 5 then b0 else a0 end end as y0,
 case when good then case when frame = 'upright' then gx1 when t < 5 then a1 else b1 end end as x1, case when good then case when frame = 'upright' then gy1 when t < 5 then b1 else a1 end end as y1,
 case when frame is null then 'box_frame_unknown' when not good then 'box_outside_image' when km2 is null then 'unmapped_class' when km2 = 'excluded' then 'excluded_by_class_map' end as reason from m""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with their frame, place in the upright image, class, split and reason, for all eight orientations."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    label = F.element_at(F.array(*[F.lit(x) for x in ("leaf", "spot", "odd", "no", "new")]), (k % 5 + 1).cast("int"))
    box = lambda i: F.struct((k % 60 + i).alias("x"), (c % 70).alias("y"), (k % 20 + 1).alias("w"), (c % 17 + 1).alias("h"), label.alias("class_raw"))
    boxes = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), k % 4 - 1), box))
    split = F.when(k % 2 == 0, "train").otherwise("test")
    parents = o.select(k.alias("id"), k.cast("string").alias("image_id"), F.lit("p").alias("path"), split.alias("split"), F.lit("own").alias("split_rule"), F.lit(80).cast("bigint").alias("width"), F.lit(60).cast("bigint").alias("height"), F.nullif(c % 9, F.lit(0)).alias("orientation"), boxes.alias("boxes"))
    class_map = spark.createDataFrame([("leaf", "healthy"), ("spot", "rust"), ("odd", "unknown_als"), ("no", "excluded")], "class_raw string, class_km2 string")
    found = crops.crop_boxes(parents, class_map, "0.1", ["unknown_als"])
    return found.select("id", "box_index", "frame", "class_km2", "split", "seen.x0", "seen.y0", "seen.x1", "seen.y1", "reason")
