"""Plot states with timers: against a plain walk over all rows in order, whatever the batches and restarts."""

import datetime as dt
import random

import pytest

from strataforge.session import fresh_path
from strataforge.streaming import plots
from strataforge.streaming.requests import batches, put_batch

SCHEMA = "plot string, ts timestamp, place bigint, state string"
START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
HOLD, IDLE = 600, 1800


def plain(rows, watch=3):
    """Changes by seconds from the start, of ``(plot, second, place, state)``."""
    out = set()
    for plot in {r[0] for r in rows if r[0] is not None}:
        n = run = watched = last = 0
        for s, _, state in [*sorted((r[1], r[2] or 0, r[3] or "") for r in rows if r[0] == plot), (10**9, 0, None)]:
            if run and watched + HOLD <= s:
                out.add((plot, watched + HOLD, "expired", n, run))
                run = 0
            if n and last + IDLE <= s:
                out.add((plot, last + IDLE, "evicted", n, 0))
                n = 0
            if state is None:
                break
            n, last = n + 1, s
            if state == "watch":
                run, watched = run + 1, s
                if run in (1, watch):
                    out.add((plot, s, "verify" if run == watch else "watch", n, run))
            elif state == "OK" and run:
                run = 0
                out.add((plot, s, "OK", n, 0))
    return out


class Stream:
    """A folder of rows, and the stream over it, which may be started again and again."""

    def __init__(self, spark):
        self.spark = spark
        self.put_in, self.out, self.marks = (fresh_path(spark, f"plots-{k}") for k in ("in", "out", "marks"))

    def put(self, rows):
        made = [(p, START + dt.timedelta(seconds=s), i, state) for p, s, i, state in rows]
        self.spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(self.put_in)

    def run(self):
        rows = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.put_in)
        changes = plots.plot_changes(rows, "plot", "state", "ts", "place", "5 minutes", HOLD, IDLE)
        with plots.timer_store(self.spark):
            changes.writeStream.foreachBatch(lambda b, n: put_batch(b, self.out, n)).option("checkpointLocation", self.marks).trigger(availableNow=True).start().awaitTermination()

    def changes(self):
        rows = batches(self.spark, self.out, plots.CHANGES).collect()
        found = [(r.plot, r.at_us // 1_000_000 - int(START.timestamp()), r.change, r.n, r.run) for r in rows]
        assert len(found) == len(set(found))
        return set(found)


def test_changes_do_not_depend_on_batches_and_restarts(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(4)}", rng.randrange(0, 9000), i, rng.choice(["watch", "watch", "OK", "absent", None])) for i in range(120)]
    rows += [("edge", 0, 1, "watch"), ("edge", HOLD, 2, "watch"), ("edge", HOLD + IDLE, None, "OK"), ("tie", 50, 2, "OK"), ("tie", 50, 1, "watch")]
    late_by = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 290))  # out of order by less than five minutes
    stream = Stream(spark)
    for i in range(0, len(late_by), 45):
        stream.put(late_by[i : i + 45])
        stream.run()
    stream.put([(None, 100_000, 0, "watch")])
    stream.run()
    assert stream.changes() == plain(rows)
    assert {c[2] for c in stream.changes()} == {"watch", "verify", "OK", "expired", "evicted"}


def test_timers_fire_without_rows_and_nothing_is_held_after(spark):
    stream = Stream(spark)
    stream.put([("a", 0, 0, "watch"), (None, 10, 0, "watch")])
    stream.run()
    assert stream.changes() == set()  # the watermark has not passed the row
    stream.put([("b", 1000, 0, "OK")])
    stream.run()
    assert stream.changes() == {("a", 0, "watch", 1, 1), ("a", HOLD, "expired", 1, 1)}
    stream.put([("b", 3000, 0, "OK"), ("a", 10, 1, "watch")])  # the second is behind the watermark
    stream.run()
    assert stream.changes() == {("a", 0, "watch", 1, 1), ("a", HOLD, "expired", 1, 1), ("a", IDLE, "evicted", 1, 0)}
    stream.put([("a", 90_000, 0, "watch")])
    stream.run()
    stream.put([(None, 200_000, 0, "OK")])
    stream.run()
    assert {c for c in stream.changes() if c[0] == "a" and c[1] >= 90_000} == {("a", 90_000, "watch", 1, 1), ("a", 90_000 + HOLD, "expired", 1, 1), ("a", 90_000 + IDLE, "evicted", 1, 0)}


def test_terms_of_changes(spark):
    rows = spark.readStream.schema(SCHEMA).parquet(_empty(spark))
    with pytest.raises(ValueError, match="hold"):
        plots.plot_changes(rows, "plot", "state", "ts", "place", "5 minutes", 10, 5)
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with plots.timer_store(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kept


def _empty(spark):
    folder = fresh_path(spark, "plots-empty")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    return folder
