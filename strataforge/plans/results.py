"""Results tables, verdicts and ledgers over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators import dedupe, ledger, results
from strataforge.plans import query
from strataforge.plans.tables import table

_RUNS = """runs as (select l_orderkey as pos, l_suppkey % 10 as head, l_returnflag as metric, l_linenumber as ln, cast((l_orderkey // 7) % 5 as bigint) as seed, round(avg(l_discount) , 6) as value,
 'r' || cast(l_orderkey as varchar) as run_id, max(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')) as ts, min(l_tax) >= 0.0 as quotable from lineitem group by l_orderkey, l_suppkey % 10, l_returnflag, l_linenumber)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("pos"), (F.col("l_suppkey") % 10).alias("head"), F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("ln")).agg(
        F.round(F.avg("l_discount"), 6).alias("value"), F.max(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), (F.min("l_tax") >= 0.0).alias("quotable")
    ).withColumn("seed", F.expr("(pos div 7) % 5")).withColumn("run_id", F.concat(F.lit("r"), F.col("pos")))


@query(f"""with {_RUNS}, last as (select head, metric, ln, seed, arg_max(struct_pack(ts := ts, value := value, run_id := run_id, quotable := quotable), pos) as r from runs group by 1, 2, 3, 4)
select head, metric, ln, max(r.ts) as ts, round(avg(r.value), 4) as value, round(avg(r.value) - 2.776445 * stddev_samp(r.value) / sqrt(5.0), 4) as ci_low, round(avg(r.value) + 2.776445 * stddev_samp(r.value) / sqrt(5.0), 4) as ci_high,
 string_agg(r.run_id, '+' order by seed) as run_id, bool_and(r.quotable) as quotable from last group by 1, 2, 3 having count(*) = 5""")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return results.aggregate_seeds(_runs(spark, d), ["head", "metric", "ln"])


@query("""with n as (select distinct o_custkey, case when o_orderstatus = 'F' then 'N1' when o_orderstatus = 'O' then 'N2' end as number from orders where o_orderstatus in ('F', 'O'))
select o_custkey, case when min(number) = 'N1' then 'N2' else 'N1' end as missing from n group by 1 having count(*) = 1""")
def pairing_unmatched(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "N1").when(F.col("o_orderstatus") == "O", "N2").alias("number"))
    return results.unpaired(rows, ["o_custkey"])


_ROWS = """rows_ as (select case l_linestatus when 'F' then 'base' else 'rival' end as backbone_id, case l_returnflag when 'A' then 'linear' when 'N' then 'proto' else 'mix' end as head, cast(l_suppkey % 4 as integer) as direction,
 avg(l_discount) * 10 as value, avg(l_discount) * 10 - 0.01 as ci_low, avg(l_discount) * 10 + 0.01 as ci_high from lineitem group by 1, 2, 3)"""


def _contest(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_suppkey", "l_discount")
    who = F.when(F.col("l_linestatus") == "F", "base").otherwise("rival")
    head = F.when(F.col("l_returnflag") == "A", "linear").when(F.col("l_returnflag") == "N", "proto").otherwise("mix")
    by = li.groupBy(who.alias("backbone_id"), head.alias("head"), (F.col("l_suppkey") % 4).cast("int").alias("direction")).agg((F.avg("l_discount") * 10).alias("value"))
    return by.withColumn("ci_low", F.col("value") - 0.01).withColumn("ci_high", F.col("value") + 0.01)


@query(f"""with {_ROWS}, p as (select a.head, a.direction, a.value as va, b.value as vb, a.ci_low as la, b.ci_high as hb from rows_ a join rows_ b using (head, direction) where a.backbone_id = 'rival' and b.backbone_id = 'base')
select head, count(*) as n, round(avg(va) - avg(vb), 6) as ahead, cast(sum(case when va - vb >= 0.02 - 1e-9 and la > hb then 1 else 0 end) as bigint) as clear,
 count(*) = 4 and avg(va) - avg(vb) >= 0.02 - 1e-9 and sum(case when va - vb >= 0.02 - 1e-9 and la > hb then 1 else 0 end) >= 2 as won from p group by head""")
def champion_challenger(spark: SparkSession, d: str) -> DataFrame:
    return results.criterion_1(_contest(spark, d), "rival", "base", ["linear", "proto", "mix"], 4).withColumn("ahead", F.round("ahead", 6))


_C2 = """with {rows}, n3 as (select backbone_id, head, case when direction % 2 = 0 then 'unknown_als' else 'unknown_wm' end as held_out, 'auroc:conf' as metric, cast(direction as varchar) as train, value from rows_),
p as (select a.head, a.held_out, a.value - b.value as gap from n3 a join n3 b using (head, held_out, metric, train) where a.backbone_id = 'rival' and b.backbone_id = 'base')
select count(*) as n, cast(sum(case when gap >= 0.02 - 1e-9 then 1 else 0 end) as bigint) as cleared, count(distinct head) = 3 as all_heads, count(distinct held_out) = 2 as all_held,
 count(*) > 0 and count(*) = sum(case when gap >= 0.02 - 1e-9 then 1 else 0 end) and count(distinct head) = 3 and count(distinct held_out) = 2 as won from p"""


@query(_C2.format(rows=_ROWS))
def criterion_unknowns(spark: SparkSession, d: str) -> DataFrame:
    held = F.when(F.col("direction") % 2 == 0, "unknown_als").otherwise("unknown_wm")
    n3 = _contest(spark, d).select("backbone_id", "head", held.alias("held_out"), F.lit("auroc:conf").alias("metric"), F.col("direction").cast("string").alias("train"), "value")
    return results.criterion_2(n3, "rival", "base", ["linear", "proto", "mix"], ["unknown_als", "unknown_wm"])


@query(f"""with {_ROWS}, heads as (select a.head, b.head as other, a.backbone_id as a, avg(a.value) - avg(b.value) as ahead, count(*) as n, sum(case when a.value - b.value >= 0.02 - 1e-9 and a.ci_low > b.ci_high then 1 else 0 end) as clear
 from rows_ a join rows_ b using (head, direction) where a.backbone_id <> b.backbone_id group by a.head, b.head, a.backbone_id),
won as (select a, count(*) = 3 and bool_and(n = 4 and ahead >= 0.02 - 1e-9 and clear >= 2) as won from heads group by a)
select case when (select won from won where a = 'rival') and not (select won from won where a = 'base') then 'challenger' else 'champion' end as winner, (select max(o_orderdate) from orders) as as_of""")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = _contest(spark, d)
    heads = ["linear", "proto", "mix"]
    wins = {}
    for a, b in (("rival", "base"), ("base", "rival")):
        r = results.criterion_1(rows, a, b, heads, 4).agg((F.count(F.lit(1)) == len(heads)).alias("all"), F.bool_and("won").alias("won")).first()
        wins[a] = bool(r["all"] and r["won"])
    name = results.winner(wins["rival"], wins["base"], False)
    return table(spark, d, "orders").agg(F.lit(name).alias("winner"), F.max("o_orderdate").alias("as_of")).select("winner", "as_of")


@query(f"""with {_ROWS}, n4 as (select backbone_id, case when direction < 2 then 'balanced_accuracy:dataset' else 'balanced_accuracy:district' end as metric, max(value) as value from rows_ group by 1, 2)
select count(*) filter (where b.value - a.value >= 0.02 - 1e-9) = 2 as won from n4 a join n4 b using (metric) where a.backbone_id = 'rival' and b.backbone_id = 'base'""")
def site_tie_break(spark: SparkSession, d: str) -> DataFrame:
    metric = F.when(F.col("direction") < 2, "balanced_accuracy:dataset").otherwise("balanced_accuracy:district")
    n4 = _contest(spark, d).groupBy("backbone_id", metric.alias("metric")).agg(F.max("value").alias("value"))
    return results.tie_break(n4, "rival", "base", ["balanced_accuracy:dataset", "balanced_accuracy:district"])


_MIXED = """rows_ as (select event_id, case when event_id % 4 = 0 then 'r' || cast(user_id as varchar) || '+r' || cast((user_id + 1) % 150 as varchar) else 'r' || cast(user_id as varchar) end as run_id, case when event_id % 11 = 0 then 'older' end as superseded from events)"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    one = F.concat(F.lit("r"), F.col("user_id"))
    two = F.concat(one, F.lit("+r"), (F.col("user_id") + 1) % 150)
    return e.select("event_id", F.when(F.col("event_id") % 4 == 0, two).otherwise(one).alias("run_id"), F.when(F.col("event_id") % 11 == 0, "older").alias("superseded"))


@query(f"""with {_MIXED} select event_id, run_id, case when superseded is not null then superseded when len(list_intersect(string_split(run_id, '+'), ['r3', 'r14', 'r77'])) > 0 then 'retrained' end as superseded from rows_""")
def supersede_mark(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.createDataFrame([("r3",), ("r14",), ("r77",)], "run_id string")
    return results.mark_superseded(_mixed(spark, d), F.broadcast(runs), "retrained", "event_id")


@query(f"""with {_MIXED}, m as (select unnest(string_split(run_id, '+')) as part, case when superseded is not null or len(list_intersect(string_split(run_id, '+'), ['r3', 'r4', 'r5'])) > 0 then 1 else 0 end as s from rows_)
select part as run_id, count(*) as n_rows from m group by 1 having min(s) = 1""")
def retired_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.createDataFrame([("r3",), ("r4",), ("r5",)], "run_id string")
    return results.retired(results.mark_superseded(_mixed(spark, d), F.broadcast(runs), "retrained", "event_id"))


@query(f"""with {_MIXED} select part as run_id, count(*) as n from (select unnest(string_split(run_id, '+')) as part from rows_) group by 1""")
def index_by_run(spark: SparkSession, d: str) -> DataFrame:
    return results.run_parts(_mixed(spark, d)).groupBy(F.col("part").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey, c_mktsegment from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')""")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """Expected identities that the table lacks: what is still to be scored."""
    expected = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return dedupe.unmatched(expected, known, "c_custkey")


@query("""with s as (select o_custkey, list_sort(list_distinct(list(o_orderpriority))) as parts from orders group by 1) select o_custkey, array_to_string(parts, '+') as parts, parts = ['1-URGENT', '2-HIGH', '5-LOW'] as is_match, len(list_intersect(parts, ['1-URGENT', '5-LOW'])) = 2 as is_superset from s""")
def direction_match(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    return sets.select("o_custkey", F.array_join("p", "+").alias("parts"), (F.col("p") == lit("1-URGENT", "2-HIGH", "5-LOW")).alias("is_match"), (F.size(F.array_except(lit("1-URGENT", "5-LOW"), "p")) == 0).alias("is_superset"))


@query("""with r as (select event_type as step, case when user_id % 3 = 0 then 'NVIDIA X' when user_id % 3 = 1 then 'CPU (a)' end as device, case when event_id % 50 <> 0 then value end as w, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as t from events)
select step, cast(grouping(step) as integer) as is_total, count(*) as n_rows, round(coalesce(sum(w), 0), 6) as wallclock_s, round(coalesce(sum(case when device like 'NVIDIA%' then w end), 0), 6) as gpu_s,
 round(coalesce(sum(case when device is null or device like 'CPU%' then w end), 0), 6) as cpu_s, min(t) as first_ts, max(t) as last_ts from r group by rollup (step)""")
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    device = F.when(F.col("user_id") % 3 == 0, "NVIDIA X").when(F.col("user_id") % 3 == 1, "CPU (a)")
    return ledger.totals(e.select(F.col("event_type").alias("step"), device.alias("device"), F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("wallclock_s"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")))


_TABLE_ROWS = """rows_ as (select o_orderkey, case when o_orderkey % 9 = 0 then 'older' end as superseded, case when o_orderkey % 4 = 0 then null else o_orderkey % 3 <> 0 end as quotable, case when o_orderkey % 2 = 0 then o_orderkey % 5 end as seed,
 case when o_orderkey % 7 = 0 then 518 else 224 end as res, 'cls' as token_type, case when o_orderkey % 11 = 0 then 0.9 else 1.0 end as coverage from orders)"""


@query(f"""with {_TABLE_ROWS} select o_orderkey from rows_ where superseded is null and quotable and seed is null and res = 224 and token_type = 'cls' and coverage = 1.0""")
def current_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k, F.when(k % 9 == 0, "older").alias("superseded"), F.when(k % 4 != 0, k % 3 != 0).alias("quotable"), F.when(k % 2 == 0, k % 5).alias("seed"),
        F.when(k % 7 == 0, 518).otherwise(224).alias("res"), F.lit("cls").alias("token_type"), F.when(k % 11 == 0, 0.9).otherwise(1.0).alias("coverage"),
    )
    return results.readable(rows).select("o_orderkey")


@query("""select user_id, arg_max(event_type, ts) as event_type, arg_max(value, ts) is distinct from 10.0 as changed from events group by user_id""")
def env_change(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each key against a present state."""
    by = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max_by("value", "ts").alias("v"))
    return by.select("user_id", "event_type", (~F.col("v").eqNullSafe(F.lit(10.0))).alias("changed"))


@query("""with h as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as epoch, o_totalprice as score from orders),
b as (select *, max(score) over (partition by o_custkey order by epoch rows between unbounded preceding and 1 preceding) as before from h),
l as (select *, before is null or score > before as better, max(case when before is null or score > before then epoch end) over (partition by o_custkey order by epoch rows unbounded preceding) as last from b),
s as (select *, coalesce(max(case when epoch - last >= 3 then 1 else 0 end) over (partition by o_custkey order by epoch rows between unbounded preceding and 1 preceding), 0) as over_ from l)
select o_custkey, cast(max(epoch) as integer) as stopped_at, cast(max(case when better then epoch end) as integer) as best_epoch, max(score) as best from s where over_ = 0 group by 1""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, d, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("epoch"), F.col("o_totalprice").alias("score"))
    return results.running_best(rows, ["o_custkey"], "epoch", "score", 3)


@query("""select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'purchase') where n <= 2""")
def take_satisfying(spark: SparkSession, d: str) -> DataFrame:
    """The first two rows of each key that satisfy a predicate."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").where("event_type = 'purchase'").withColumn("n", F.row_number().over(w)).where("n <= 2").select("user_id", "event_id")
