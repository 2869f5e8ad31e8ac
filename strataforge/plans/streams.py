"""Streaming queries over events, with the SQL of the same result in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.plans import query
from strataforge.plans.tables import table
from strataforge.session import fresh_path
from strataforge.streaming import plots
from strataforge.streaming import requests as rq


def _events(spark: SparkSession, d: str) -> DataFrame:
    return rq.stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _closed(spark: SparkSession, d: str) -> DataFrame:
    return rq.with_close(_events(spark, d), "ts")


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("""select date_trunc('day', ts) as w_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2""")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = rq.windowed(_closed(spark, d), "ts", "2 hours", "1 day", None, ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    return _plain(rq.drain(rows, "append", "tumbling"), "w_start").withColumn("total", F.round("total", 6))


@query("""select w_start, event_type, count(*) as n from (select event_type, unnest([date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts)]) as w_start from events) group by 1, 2""")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = rq.windowed(_closed(spark, d), "ts", "2 hours", "2 hours", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")])
    return _plain(rq.drain(rows, "append", "sliding"), "w_start")


@query("""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from s)
select min(ts) as s_start, max(ts) + interval 30 minute as s_end, user_id, count(*) as n from g group by user_id, k""")
def session(spark: SparkSession, d: str) -> DataFrame:
    rows = rq.visits(_closed(spark, d), "ts", "2 hours", "30 minutes", ["user_id"])
    return _plain(rq.drain(rows, "append", "session"), "s_start", "s_end")


@query("""select count(*) as n from (select distinct user_id, event_type, cast(floor(value) as bigint) from events)""")
def watermarked_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("ts", "user_id", "event_type", F.floor("value").alias("v"))
    return rq.drain(rq.once(rows, "ts", "365 days", ["user_id", "event_type", "v"]), "append", "dedup").agg(F.count(F.lit(1)).alias("n"))


@query("""select case when event_type = 'error' then 'bad' else 'good' end as side, count(*) as n from events group by 1""")
def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    good, bad, marks = (fresh_path(spark, f"quarantine-{k}") for k in ("good", "bad", "marks"))
    errors = F.when(F.col("event_type") == "error", F.array(F.lit("status"))).otherwise(F.array().cast("array<string>"))
    rq.quarantine(_events(spark, d).select("event_id", "event_type"), errors, good, bad, marks)
    read = lambda p, side: rq.batches(spark, p, "event_id bigint, event_type string").select(F.lit(side).alias("side"))
    return read(good, "good").union(read(bad, "bad")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("""select e.event_id, c.c_mktsegment as segment from events e join customer c on e.user_id = c.c_custkey""")
def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    """A stream of frames joined with a static feature table."""
    static = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return rq.drain(_events(spark, d).select("event_id", "user_id").join(static, "user_id").select("event_id", "segment"), "append", "static")


@query("""with s as (select cast(user_id as varchar) as plot, case event_type when 'error' then 'absent' when 'view' then 'watch' else 'OK' end as state, row_number() over (partition by user_id order by ts, event_id) as r from events),
o as (select plot, coalesce(max(r) filter (state = 'OK'), 0) as last, count(*) as n from s group by plot), w as (select plot, any_value(n) as n, count(*) filter (state = 'watch' and r > last) as run from s join o using (plot) group by plot)
select plot, n, case when run = 0 then 'OK' when run >= 3 then 'verify' else 'watch' end as state from w""")
def plot_states(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "absent").when(F.col("event_type") == "view", "watch").otherwise("OK")
    rows = _events(spark, d).select("user_id", "ts", "event_id", state.alias("state"))
    return rq.drain(rq.plot_states(rows, "user_id", "state", "ts", "event_id"), "append", "states")


@query("""with e as (select cast(user_id as varchar) as plot, epoch_us(ts) as us, event_id, case event_type when 'error' then 'absent' when 'view' then 'watch' else 'OK' end as state from events where user_id is not null and ts is not null),
v as (select *, sum(fresh) over (partition by plot order by us, event_id rows unbounded preceding) as visit from (select *, case when us - lag(us) over (partition by plot order by us, event_id) < 86400000000 then 0 else 1 end as fresh from e)),
c as (select *, row_number() over w as n, count(*) over (partition by plot, visit) as n_visit, max(us) over (partition by plot, visit) as ends from v window w as (partition by plot, visit order by us, event_id)),
s as (select *, lag(state) over w as before, lag(us) over w as before_us, lead(state) over w as after, lead(us) over w as after_us from c where state <> 'absent' window w as (partition by plot, visit order by us, event_id)),
k as (select *, sum(case when state = 'watch' and before = 'watch' and us - before_us < 43200000000 then 0 else 1 end) over (partition by plot, visit order by us, event_id rows unbounded preceding) as chain from s),
r as (select *, row_number() over (partition by plot, visit, chain order by us, event_id) as run from k),
gone as (select r.plot, r.us + 43200000000 as at_us, 'expired' as change, (select count(*) from c where c.plot = r.plot and c.visit = r.visit and c.us < r.us + 43200000000) as n, r.run from r where state = 'watch' and (after is null or after_us - us >= 43200000000))
select plot, us as at_us, case when run = 3 then 'verify' else 'watch' end as change, n, run from r where state = 'watch' and run in (1, 3)
union all select plot, us, 'OK', n, 0 from r where state = 'OK' and before = 'watch' and us - before_us < 43200000000
union all select * from gone
union all select distinct plot, ends + 86400000000, 'evicted', n_visit, 0 from c""")
def plot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of plots by event time: a watch expires after half a day, a plot that is silent for a day is let go."""
    state = F.when(F.col("event_type") == "error", "absent").when(F.col("event_type") == "view", "watch").otherwise("OK")
    rows = rq.with_close(_events(spark, d), "ts", "2200-01-01 00:00:00").select("user_id", "ts", "event_id", state.alias("state"))
    with plots.timer_store(spark):
        return rq.drain(plots.plot_changes(rows, "user_id", "state", "ts", "event_id", "2 hours", 43_200, 86_400), "append", "changes")


@query("""with cut as (select max(ts) filter (event_id % 2 = 0) - interval 2 hour as w from events) select event_type, count(*) as n from events, cut where event_id % 2 = 1 and ts < w group by 1""")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events in two batches: those of the second that come more than two hours late are set aside."""
    folder, late, marks = (fresh_path(spark, f"late-{k}") for k in ("in", "rows", "marks"))
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rq.late_rows(rows, "ts", 7200, late, marks)
    return rq.batches(spark, late, events.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
