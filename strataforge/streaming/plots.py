"""States of plots with timers: rows are taken by event time, a watch expires, plots that fall silent are let go."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "plot string, at_us bigint, change string, n bigint, run bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; a stream takes the setting when it is started, so it is set back after."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class PlotWatch(StatefulProcessor):
    """Holds the rows of a plot until the watermark has passed them, and a few numbers of its visit.

    Of a visit: rows ``n``, watch rows in a row ``run``, times of the last of these and of the last row, and the time of
    the only timer that is set. Rows are added to the waiting list as they come; the list is read only when a timer fires.
    """

    def __init__(self, watch: int, hold_us: int, idle_us: int):
        self.watch, self.hold, self.idle = watch, hold_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", "n bigint, run bigint, watched bigint, last bigint, timer bigint")
        self.waiting = handle.getListState("waiting", "us bigint, place bigint, state string")

    def _visit(self) -> list[int]:
        return list(self.visit.get()) if self.visit.exists() else [0, 0, 0, 0, -1]

    def _set(self, visit: list[int], us: int | None) -> None:
        """One timer, at ``us`` or where it is if that is earlier; it fires when the watermark is past it."""
        ms = None if us is None else us // 1000
        if visit[4] >= 0 and ms is not None and visit[4] > ms:
            self.handle.deleteTimer(visit[4])
            visit[4] = -1
        if visit[4] < 0 and ms is not None:
            self.handle.registerTimer(ms)
            visit[4] = ms
        self.visit.update(tuple(visit))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is not None:
            first = None
            for pdf in rows:
                own = list(zip(pdf["us"].tolist(), pdf["place"].tolist(), pdf["state"].tolist(), strict=True))
                self.waiting.appendList(own)
                first = min([r[0] for r in own] + ([] if first is None else [first]))
            if first is not None:
                self._set(self._visit(), first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        out: list[tuple] = []
        visit = self._visit()
        visit[4] = -1
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ripe = [r for r in rows if r[0] < past]
        for us, _, state in ripe:
            self._pass_time(visit, us, out)
            visit[0] += 1
            visit[3] = us
            if state == "watch":
                visit[1] += 1
                visit[2] = us
                if visit[1] in (1, self.watch):
                    out.append((us, "verify" if visit[1] == self.watch else "watch", visit[0], visit[1]))
            elif state == "OK" and visit[1]:
                visit[1] = 0
                out.append((us, "OK", visit[0], 0))
        self._pass_time(visit, past - 1, out)
        kept = rows[len(ripe) :]
        if ripe and kept:
            self.waiting.put(kept)
        elif ripe:
            self.waiting.clear()
        due = [kept[0][0]] if kept else []
        due += [visit[3] + self.idle] if visit[0] else []
        due += [visit[2] + self.hold] if visit[1] else []
        if due:
            self._set(visit, min(due))
        else:
            self.visit.clear()
        if out:
            yield pd.DataFrame({"plot": [key[0]] * len(out), "at_us": [r[0] for r in out], "change": [r[1] for r in out], "n": [r[2] for r in out], "run": [r[3] for r in out]})

    def _pass_time(self, visit: list[int], now: int, out: list[tuple]) -> None:
        """What falls due up to ``now``, at the time it was due."""
        if visit[1] and visit[2] + self.hold <= now:
            out.append((visit[2] + self.hold, "expired", visit[0], visit[1]))
            visit[1] = 0
        if visit[0] and visit[3] + self.idle <= now:
            out.append((visit[3] + self.idle, "evicted", visit[0], 0))
            visit[0] = 0

    def close(self) -> None:
        pass


def plot_changes(rows: DataFrame, plot: str, state: str, ts: str, order: str, late: str, hold: int, idle: int, watch: int = 3) -> DataFrame:
    """Changes of plots ``(plot, at_us, change, n, run)`` as a stream that appends.

    A plot's first ``watch`` row gives ``watch``, the ``watch``-th without an OK between gives ``verify``, and an OK row
    after either gives ``OK``; other states count as rows only. ``hold`` seconds after its last watch row a run is
    ``expired``. ``idle`` seconds after its last row a plot is ``evicted``: n tells its rows, and nothing of it is held any longer; a later row
    opens a new visit. Something that falls due at the time of a row comes before it.

    Rows are taken by time and then by ``order`` once the watermark, ``late`` behind the latest time, has passed them, so the
    changes do not depend on how rows arrive; what comes later than that is left out by the engine. Rows without a plot
    are left out; a null ``order`` counts as 0. Times must lie before 2262, as pandas holds them by the nanosecond. A plot holds the rows of the last ``late`` and five numbers. ``idle`` must be ``hold`` at least.
    Start the stream within ``timer_store``.
    """
    if not 0 < hold <= idle or watch < 2:
        raise ValueError(f"hold ({hold}) must be above 0 and at most idle ({idle}), watch ({watch}) 2 at least")
    named = rows.withWatermark(ts, late).select(F.col(ts).alias("ts"), F.col(plot).cast("string").alias("plot"), F.unix_micros(F.col(ts)).alias("us"), F.coalesce(F.col(order).cast("bigint"), F.lit(0)).alias("place"), F.coalesce(F.col(state), F.lit("")).alias("state"))
    return named.groupBy("plot").transformWithStateInPandas(PlotWatch(watch, hold * 1_000_000, idle * 1_000_000), CHANGES, "append", "EventTime")
