"""Windows, visits and states of a stream of requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataforge.session import fresh_path


def stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All that the batches of a stream wrote below ``path``, a folder for each of them, so that one that runs again replaces its own."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def put_batch(rows: DataFrame, path: str, n: int | str) -> None:
    """Writes a batch's folder below ``path``, whatever an earlier run of the batch has left there."""
    rows.write.mode("overwrite").parquet(f"{path}/batch-{n}")


def drain(rows: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over what is there now and gives its last result (complete) or all of them (append), staged as Parquet."""
    spark = rows.sparkSession
    out, marks = fresh_path(spark, label), fresh_path(spark, f"{label}-marks")

    def write(batch: DataFrame, n: int) -> None:
        put_batch(batch, out, "last" if mode == "complete" else n)

    put_batch(spark.createDataFrame([], rows.schema), out, "none")
    rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return batches(spark, out, rows.schema)


def windowed(rows: DataFrame, ts: str, late: str, size: str, slide: str | None, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Tumbling or sliding windows with a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("w_start"), *by, *[c for c in _names(aggregates)])


def _names(aggregates: list[Column]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in aggregates]


def visits(rows: DataFrame, ts: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Visits: runs of rows without a gap."""
    s = F.session_window(ts, gap)
    return rows.withWatermark(ts, late).groupBy(s.alias("s"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), *by, "n")


def once(rows: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """Rows whose keys have not been seen within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def quarantine(rows: DataFrame, errors: Column, good: str, bad: str, marks: str) -> None:
    """Writes rows without errors to one table and the others, with their errors, to another; ``batches`` reads them. A batch that runs again changes nothing."""
    marked = rows.withColumn("errors", errors)

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        put_batch(batch.where(F.size("errors") == 0).drop("errors"), good, n)
        put_batch(batch.where(F.size("errors") > 0), bad, n)
        batch.unpersist()

    marked.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def with_close(rows: DataFrame, ts: str, at: str = "2999-01-01 00:00:00") -> DataFrame:
    """A stream with one more row of its own, whose far time closes all windows before it; its own window is never given.

    Without it the last windows of a stream that ends would wait for a watermark that never comes.
    """
    spark = rows.sparkSession
    folder = fresh_path(spark, "close")
    empty = spark.createDataFrame([tuple(None for _ in rows.columns)], T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]))
    empty.withColumn(ts, F.lit(at).cast(rows.schema[ts].dataType)).write.parquet(folder)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(folder))


def late_rows(rows: DataFrame, ts: str, seconds: int, late: str, marks: str) -> None:
    """Writes the rows that come more than ``seconds`` behind the latest time of earlier batches to ``late``; ``batches`` reads them.

    The latest time by batch is kept in a small table, so a batch that runs again takes the same one.
    """
    spark = rows.sparkSession
    seen = f"{marks}-seen"
    kind = rows.schema[ts].dataType.simpleString()
    put_batch(spark.createDataFrame([], f"batch bigint, latest {kind}"), seen, "none")

    def write(batch: DataFrame, n: int) -> None:
        known = batches(batch.sparkSession, seen, f"batch bigint, latest {kind}").where(F.col("batch") < n).agg(F.max("latest").alias("l")).first()["l"]
        if known is not None:
            behind = batch.where(F.col(ts) < F.lit(known) - F.expr(f"interval {seconds} seconds"))
            put_batch(behind.withColumn("batch", F.lit(n).cast("bigint")), late, n)
        put_batch(batch.agg(F.max(ts).alias("latest")).select(F.lit(n).cast("bigint").alias("batch"), "latest"), seen, n)

    put_batch(spark.createDataFrame([], T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])), late, "none")
    rows.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def plot_states(rows: DataFrame, plot: str, state: str, ts: str, order: str, watch: int = 3) -> DataFrame:
    """The state of each plot after each batch: OK, watch after a row that abstains, verify after ``watch`` in a row.

    Rows of a plot are taken by time and then by ``order``, however they arrive within a batch; a row that is not after
    the last one taken in an earlier batch counts, but no longer changes the state. Two counts and the last place are kept for each plot.
    """

    def step(key: tuple, frames, held: GroupState):
        run, n, last, place = held.get if held.exists else (0, 0, -(1 << 62), -(1 << 62))
        pdf = pd.concat(list(frames), ignore_index=True).sort_values(["us", "place"], kind="mergesort")
        n += len(pdf)
        for us, p, s in zip(pdf["us"].tolist(), pdf["place"].tolist(), pdf["state"].tolist(), strict=True):
            if (us, p) > (last, place):
                run = 0 if s == "OK" else run + 1 if s == "watch" else run
                last, place = us, p
        held.update((run, n, last, place))
        yield pd.DataFrame({"plot": [key[0]], "n": [n], "state": ["OK" if run == 0 else "verify" if run >= watch else "watch"]})

    kept = rows.select(F.col(plot).cast("string").alias("plot"), F.col(state).alias("state"), F.unix_micros(F.col(ts)).alias("us"), F.col(order).cast("bigint").alias("place")).where("us is not null")
    return kept.groupBy("plot").applyInPandasWithState(step, "plot string, n bigint, state string", "run bigint, n bigint, last bigint, place bigint", "append", GroupStateTimeout.NoTimeout)
