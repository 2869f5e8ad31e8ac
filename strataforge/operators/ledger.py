"""The compute ledger and request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_gpu(device: Column) -> Column:
    """A device is a GPU's name or CPU (<processor>); none counts as CPU."""
    return F.coalesce((device != "") & ~device.startswith("CPU"), F.lit(False))


def totals(rows: DataFrame) -> DataFrame:
    """Rows and seconds by step, and a last row for all steps (A22): one pass with grouping sets."""
    gpu = is_gpu(F.col("device"))
    seconds = F.col("wallclock_s")
    return (
        rows.rollup("step")
        .agg(
            F.grouping("step").cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("n_rows"),
            F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 6).alias("wallclock_s"),
            F.round(F.coalesce(F.sum(F.when(gpu, seconds)), F.lit(0.0)), 6).alias("gpu_s"),
            F.round(F.coalesce(F.sum(F.when(~gpu, seconds)), F.lit(0.0)), 6).alias("cpu_s"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


def changed_environment(rows: DataFrame, now: dict[str, str | None], ts: str = "ts") -> bool:
    """Does the latest environment row differ from ``now`` in any field."""
    latest = rows.agg(F.max_by(F.struct(*now), ts).alias("e")).first()["e"]
    return latest is None or any(latest[k] != v for k, v in now.items())


def routing(status: Column, decision: Column) -> Column:
    """What a request row means for the map (F12): OK, watch (verification load), or absent (a broken frame)."""
    return F.when((status == 200) & (decision == "predict"), "OK").when((status == 200) & (decision == "abstain"), "watch").when(status == 422, "absent").otherwise("other")
