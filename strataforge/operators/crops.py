"""Crops of boxes: frames, orientation, classes, splits, pixels, copies and the folder they are kept in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.dedupe import duplicate_paths, map_classes
from strataforge.operators.extract import grey_phash
from strataforge.operators.frames import box_frame, explode_boxes, grown
from strataforge.schemas import HOLDOUT
from strataforge.session import staged
from strataforge.sources.images import grey_of, png_of, resized, upright
from strataforge.sources.sinks import file_changes

EXCLUDED = "excluded"


def turned(rect: Column, turn: Column, width: Column, height: Column) -> Column:
    """A rectangle of stored pixels as it lies in the upright image, for the eight EXIF orientations.

    Each is a choice of mirrored sides and, from 5 up, a swap of the axes: no pixel is needed to say where a crop is.
    """
    mirrored_x, mirrored_y = turn.isin(2, 3, 7, 8), turn.isin(3, 4, 6, 7)
    x0, x1 = F.when(mirrored_x, width - rect["x1"]).otherwise(rect["x0"]), F.when(mirrored_x, width - rect["x0"]).otherwise(rect["x1"])
    y0, y1 = F.when(mirrored_y, height - rect["y1"]).otherwise(rect["y0"]), F.when(mirrored_y, height - rect["y0"]).otherwise(rect["y1"])
    straight = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when(turn < 5, straight).otherwise(F.struct(y0.alias("x0"), x0.alias("y0"), y1.alias("x1"), x1.alias("y1")))


def crop_boxes(parents: DataFrame, class_map: DataFrame, margin: str, held_out: list[str]) -> DataFrame:
    """A row for each box of ``parents``: where it is cut, its class and split, or why it is not cut.

    ``parents`` has ``image_id, path, split, split_rule, boxes`` (structs of ``x, y, w, h, class_raw``), the ``width`` and ``height`` of the stored pixels and their
    ``orientation``; ``class_map`` has ``(class_raw, class_km2)``. A box is cut in the frame that it was drawn in, grown by ``margin`` of its side
    and clipped. ``rect`` lies in that frame, ``seen`` in the upright image. A crop has its parent's split unless its class is held out.
    ``reason`` is, in this order, ``box_frame_unknown``, ``box_outside_image``, ``unmapped_class`` or ``excluded_by_class_map``; rows of other columns pass through.
    """
    boxes = map_classes(explode_boxes(parents).withColumn("class_raw", F.col("box")["class_raw"]), class_map, "class_raw", "class_km2")
    box, turn = F.col("box"), F.coalesce(F.col("orientation"), F.lit(1))
    stored = F.col("width"), F.col("height")
    swapped = F.when(turn >= 5, F.col("height")).otherwise(F.col("width")), F.when(turn >= 5, F.col("width")).otherwise(F.col("height"))
    framed = boxes.withColumn("frame", box_frame(box, stored, swapped, turn > 1))
    own = [F.when(F.col("frame") == "upright", a).otherwise(b) for a, b in zip(swapped, stored, strict=True)]
    cut = framed.withColumn("rect", F.when(F.col("frame").isNotNull(), grown(box, margin, *own)))
    whole = grown(box, margin, F.lit(1 << 40), F.lit(1 << 40))
    inside = (box["x"] * F.lit(1.0) - F.lit(float(margin)) * box["w"] >= 0) & (box["y"] * F.lit(1.0) - F.lit(float(margin)) * box["h"] >= 0)
    clipped = F.col("rect").isNotNull() & ~(inside & (F.col("rect") == whole))
    seen = F.when(F.col("frame") == "stored", turned(F.col("rect"), turn, *stored)).otherwise(F.col("rect"))
    reason = (
        F.when(F.col("frame").isNull(), "box_frame_unknown")
        .when(F.col("rect").isNull(), "box_outside_image")
        .when(F.col("class_km2").isNull(), "unmapped_class")
        .when(F.col("class_km2") == EXCLUDED, "excluded_by_class_map")
    )
    held = F.coalesce(F.col("class_km2").isin(held_out), F.lit(False))
    out = cut.withColumns({"clipped": clipped, "seen": F.when(F.col("rect").isNotNull(), seen), "reason": reason})
    name = F.concat("image_id", F.lit("_b"), F.col("box_index").cast("string"), F.lit(".png"))
    return out.withColumns({"name": name, "split": F.when(held, HOLDOUT).otherwise(F.col("split")), "split_rule": F.when(held, HOLDOUT).otherwise(F.col("split_rule"))})


CUT = "array<struct<name:string,content:binary,sha256:string,phash:string,width:int,height:int>>"


def cut_pixels(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """``(name, content, sha256, phash, width, height)`` of the boxes without a reason: the grey pixels of each, upright, as a PNG.

    ``images`` has ``(image_id, content)``. A parent's boxes travel to its image as one list of small rectangles, so an image is decoded once and its bytes are not repeated
    for each box. An image that cannot be decoded has no crops.
    """
    good = boxes.where("reason is null")
    asked = good.groupBy("image_id").agg(F.collect_list(F.struct("name", "frame", F.coalesce("orientation", F.lit(1)).cast("int").alias("turn"), "rect.x0", "rect.y0", "rect.x1", "rect.y1")).alias("asked"))

    @F.arrow_udf(CUT)
    def cut(content: pa.Array, asked: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary()), ("sha256", pa.string()), ("phash", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))
        return pa.array([list(_crops(c.as_py(), a.as_py())) for c, a in zip(content, asked, strict=True)], kind)

    both = asked.join(images.select("image_id", "content"), "image_id")
    return both.select(F.explode(cut("content", "asked")).alias("c")).select("c.*")


def _crops(content: bytes, asked: list[dict]) -> Iterator[dict]:
    pixels = grey_of(content)
    if pixels is None:
        return
    for a in asked:
        source = pixels if a["frame"] == "stored" else upright(pixels, a["turn"])
        part = source[a["y0"] : a["y1"], a["x0"] : a["x1"]]
        part = np.ascontiguousarray(upright(part, a["turn"]) if a["frame"] == "stored" else part)
        data = png_of(part)
        yield {"name": a["name"], "content": data, "sha256": hashlib.sha256(data).hexdigest(), "phash": grey_phash(resized(part)), "width": part.shape[1], "height": part.shape[0]}


def first_of_copies(crops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first crop by name of each digest, and the other names of each: ``(rows, (sha256, name))``."""
    kept = crops.groupBy("sha256").agg(F.min("name").alias("__name"))
    rows = crops.join(kept.select(F.col("__name").alias("name"), F.col("sha256").alias("__sha")), "name", "left_semi")
    return rows, duplicate_paths(crops.select("sha256", "name"), "sha256", [], "name")


def publish_files(crops: DataFrame, folder: str) -> DataFrame:
    """Makes the files of ``folder`` those of ``crops(name, content, sha256)``; gives ``(name, action)``: keep, replace, add or delete.

    Files are listed and digested by Spark. New ones are written beside their place and renamed into it, so a reader sees the old bytes or the new, and
    stale ones go last; a run that is repeated finds less to do.
    """
    spark = crops.sparkSession
    place, root = _place(folder)
    place.create_dir(root, recursive=True)
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    old = held.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    changes = file_changes(old, crops.select("name", F.col("sha256").alias("digest")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        for b in batches:
            for name, data, sha in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                part = f"{root}/_{name}.{sha[:16]}.part"
                with place.open_output_stream(part) as f:
                    f.write(data)
                place.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], names=["name", "action"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                if place.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    place.delete_file(f"{root}/{name}")
            yield b

    changes = staged(changes, "file-changes")
    todo = crops.join(changes.where(F.col("action").isin("add", "replace")), "name").select("name", "content", "sha256", "action")
    done = staged(todo.mapInArrow(put, "name string, action string"), "files-put")
    gone = staged(changes.where("action = 'delete'").mapInArrow(drop, "name string, action string"), "files-dropped")
    return done.union(gone).union(changes.where("action = 'keep'"))


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if folder.startswith("file:") or "://" in folder else (fs.LocalFileSystem(), folder)
