"""The observation-frame contract and request envelope on JSON text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.vectors import once

# Keys and vocabularies of the contract.
FRAME = ("frame_uid", "uri", "sha256", "width", "height")
METADATA = ("site_id", "plot_id", "zone_id", "timestamp_utc", "pose", "platform", "camera", "illumination_mode", "sowing_batch", "bbch")
POSE = ("x", "y", "z", "yaw", "frame_id", "source")
CAMERA = ("model", "exposure_us", "gain", "flash", "white_balance")
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z$"
ENUMS = {
    "metadata.platform": ("emulator", "handheld", "cart", "robot"),
    "metadata.pose.source": ("rtk", "marker", "odometry", "manual", "synthetic"),
    "metadata.illumination_mode": ("flash", "ambient"),
}
NULL_REASONS = ("not_recorded", "not_applicable", "unknown")


SHAPES = {"": ("contract_version", "frame", "metadata"), "frame": FRAME, "metadata": METADATA, "metadata.pose": POSE, "metadata.camera": CAMERA}


def _keys(v: Column, path: str) -> Column:
    """Keys of an object within a variant; none of anything else."""
    return F.coalesce(F.map_keys(F.try_variant_get(v, f"$.{path}" if path else "$", "map<string,variant>")), F.array().cast("array<string>"))


def _named(enveloped: bool) -> dict[str, str]:
    return {path: f"k{i}" for i, path in enumerate([*SHAPES, *(("options",) if enveloped else ())])}


def frame_errors(body: Column, enveloped: bool = False) -> Column:
    """An array of sorted error paths of a frame as JSON text; empty if it keeps the contract.

    The text is parsed once into a variant, so that a key with null and a
    missing key stay apart. Each rule is a column; nothing leaves the JVM.
    ``enveloped``: further keys beside the record's own are the envelope's business. Of a table's
    column ``with_frame_errors`` and ``with_request_errors`` make the same in generated code.
    """
    named = _named(False)
    return once(F.try_parse_json(body), lambda v: once(F.struct(v.alias("v"), *[_keys(v, path).alias(k) for path, k in named.items()]), lambda s: _frame_rules(s, named, enveloped)))


def _parsed(rows: DataFrame, body: str, named: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with the variant and its keys as columns of their own, so that each is made once and rules are compiled."""
    out = rows.withColumn("__v", F.try_parse_json(F.col(body)))
    out = out.withColumns({f"__{k}": _keys(F.col("__v"), path) for path, k in named.items()})
    return out, {"v": F.col("__v"), **{k: F.col(f"__{k}") for k in named.values()}}


def _dropped(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    return rows.drop("__v", *[f"__{k}" for k in named.values()])


def with_frame_errors(rows: DataFrame, body: str = "body", name: str = "errors") -> DataFrame:
    """``rows`` with ``frame_errors`` of a column."""
    named = _named(False)
    out, s = _parsed(rows, body, named)
    return _dropped(out.withColumn(name, _frame_rules(s, named, False)), named)


def with_request_errors(rows: DataFrame, coverages: list[float], body: str = "body", name: str = "errors") -> DataFrame:
    """``rows`` with the error paths of a request, of its envelope and of the frame in it, sorted, from one parse."""
    named = _named(True)
    out, s = _parsed(rows, body, named)
    out = out.withColumns({"__e": _envelope_rules(s["v"], s[named[""]], s[named["options"]], coverages), "__f": _frame_rules(s, named, True)})
    return _dropped(out.withColumn(name, F.array_sort(F.array_distinct(F.concat("__e", "__f")))).drop("__e", "__f"), named)


def _frame_rules(s: Column | dict[str, Column], named: dict[str, str], enveloped: bool) -> Column:
    v = s["v"]
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    rules: list[tuple[str, Column]] = []
    for path, required in SHAPES.items():
        have = s[named[path]]
        need = F.array(*[F.lit(k) for k in required])
        may = F.array(*[F.lit(k) for k in (*required, *(("bbch_null_reason",) if path == "metadata" else ()))])
        rules.append((path or "(record)", (F.size(F.array_except(need, have)) == 0) & (F.lit(enveloped and not path) | (F.size(F.array_except(have, may)) == 0))))
    rules.append(("contract_version", get("contract_version", "string") == "v0"))
    for path in ("frame.frame_uid", "metadata.site_id", "metadata.plot_id", "metadata.zone_id", "metadata.pose.frame_id", "metadata.sowing_batch"):
        rules.append((path, get(path, "string").rlike(IDENTIFIER)))
    rules.append(("frame.sha256", get("frame.sha256", "string").rlike("^[0-9a-f]{64}$")))
    rules.append(("frame.uri", get("frame.uri", "string") != ""))
    for path in ("frame.width", "frame.height"):
        rules.append((path, get(path, "bigint") >= 1))
    stamp = get("metadata.timestamp_utc", "string")
    rules.append(("metadata.timestamp_utc", stamp.rlike(STAMP) & F.try_to_timestamp(F.concat(F.substring(stamp, 1, 19), F.lit("Z"))).isNotNull()))
    rules.append(("metadata.pose.yaw", F.abs(get("metadata.pose.yaw", "double")) <= math.pi))
    exposure, gain = get("metadata.camera.exposure_us", "double"), get("metadata.camera.gain", "double")
    rules.append(("metadata.camera.exposure_us", exposure.isNull() | (exposure > 0)))
    rules.append(("metadata.camera.gain", gain.isNull() | (gain >= 0)))
    for path, values in ENUMS.items():
        rules.append((path, get(path, "string").isin(*values)))
    bbch = get("metadata.bbch", "bigint")
    rules.append(("metadata.bbch", bbch.isNull() | bbch.between(0, 99)))
    why = get("metadata.bbch_null_reason", "string")
    told = F.array_contains(s[named["metadata"]], "bbch_null_reason")
    rules.append(("metadata.bbch_null_reason", F.when(bbch.isNull(), told & why.isin(*NULL_REASONS)).otherwise(~told)))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(path)) for path, ok in rules]))
    return F.when(v.isNull(), F.array(F.lit(""))).otherwise(F.array_sort(F.array_distinct(broken)))


def envelope_errors(body: Column, coverages: list[float]) -> Column:
    """Sorted error paths of a request around a frame."""
    return once(F.try_parse_json(body), lambda v: once(F.struct(v.alias("v"), _keys(v, "").alias("have"), _keys(v, "options").alias("options")), lambda s: _envelope_rules(s["v"], s["have"], s["options"], coverages)))


def _envelope_rules(v: Column, have: Column, options: Column, coverages: list[float]) -> Column:
    known = F.array(*[F.lit(k) for k in ("contract_version", "frame", "metadata", "request_id", "options")])
    allowed = F.array(F.lit("coverage_target"), F.lit("return_patch_map"))
    fitted = [f"{c:.2f}" for c in coverages]
    target = F.try_variant_get(v, "$.options.coverage_target", "double")
    flag = F.schema_of_variant(F.try_variant_get(v, "$.options.return_patch_map", "variant"))
    request = F.try_variant_get(v, "$.request_id", "string")
    extra = F.array_except(options, allowed)
    found = F.concat(
        F.array_except(have, known),
        F.when(F.size(extra) > 0, F.split(F.concat(F.lit("options."), F.array_join(extra, "\x00options.")), "\x00")).otherwise(F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                F.when(~F.coalesce(request != "", F.lit(False)), F.lit("request_id")),
                F.when(target.isNotNull() & ~F.format_string("%.2f", target).isin(*fitted), F.lit("options.coverage_target")),
                F.when(F.array_contains(options, "return_patch_map") & (flag != "BOOLEAN"), F.lit("options.return_patch_map")),
            )
        ),
    )
    return F.when(v.isNull(), F.array(F.lit(""))).otherwise(F.array_sort(F.array_distinct(found)))


def box_frame(box: Column, stored: tuple[Column, Column], upright: tuple[Column, Column], turned: Column) -> Column:
    """The frame that a box was drawn in: the one of the two that holds it; null if both or neither do."""
    fits = lambda w, h: (box["x"] >= 0) & (box["y"] >= 0) & (box["x"] + box["w"] <= w) & (box["y"] + box["h"] <= h)
    a, b = fits(*stored), fits(*upright)
    return F.when(~turned, "stored").when(a & ~b, "stored").when(b & ~a, "upright")


def grown(box: Column, margin: str, width: Column, height: Column) -> Column:
    """A box grown by ``margin`` (an exact decimal) of its side, outward to whole pixels, clipped; null if nothing is left."""
    m = F.lit(margin).cast("decimal(9,4)")
    side = lambda k: box[k].cast("decimal(12,0)")
    x0 = F.greatest(F.floor(side("x") - m * side("w")), F.lit(0)).cast("bigint")
    y0 = F.greatest(F.floor(side("y") - m * side("h")), F.lit(0)).cast("bigint")
    x1 = F.least(F.ceil(side("x") + side("w") + m * side("w")), width).cast("bigint")
    y1 = F.least(F.ceil(side("y") + side("h") + m * side("h")), height).cast("bigint")
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def explode_boxes(rows: DataFrame, boxes: str = "boxes") -> DataFrame:
    """A row for each box with its index from 0."""
    return rows.select("*", F.posexplode(boxes).alias("box_index", "box")).drop(boxes)
