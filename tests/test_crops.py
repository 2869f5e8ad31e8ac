"""Crops from boxes to files, against plain versions."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from strataforge.operators import crops
from strataforge.sources.images import grey_of, png_of, upright

PARENT = "image_id string, path string, split string, split_rule string, width int, height int, orientation int, boxes array<struct<x:double,y:double,w:double,h:double,class_raw:string>>"
MAP = [("leaf", "healthy"), ("spot", "rust"), ("odd", "unknown_als"), ("no", "excluded")]


def pixels_of(k, width, height):
    return np.random.default_rng(k).integers(0, 256, (height, width)).astype(np.uint8)


def parents():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(200):
        width, height, turn = int(rng.integers(8, 30)), int(rng.integers(8, 30)), k % 9 or None
        boxes = [(float(rng.integers(-3, 28)), float(rng.integers(-3, 28)), float(rng.integers(1, 14)), float(rng.integers(1, 14)), str(rng.choice(["leaf", "spot", "odd", "no", "new"]))) for _ in range(k % 5)]
        rows.append((f"im{k:03d}", f"p/{k}.png", ["train", "val", "test"][k % 3], "own", width, height, turn, boxes))
    return [*rows, ("none", "p/n.png", "train", "own", 9, 9, 1, None)]


def plain(row, margin=Fraction("0.1")):
    """What is cut of each box, or why not: by exact fractions and by cutting whole arrays."""
    name, _, split, _, width, height, turn, boxes = row
    turn = turn or 1
    stored = pixels_of(int(name[2:]), width, height) if name != "none" else None
    out = {}
    for k, (x, y, w, h, label) in enumerate(boxes or []):
        seen = (height, width) if turn >= 5 else (width, height)
        fits = [x >= 0 and y >= 0 and x + w <= a and y + h <= b for a, b in ((width, height), seen)]
        frame = "stored" if turn == 1 else None if fits[0] == fits[1] else "stored" if fits[0] else "upright"
        if frame is None:
            out[k] = "box_frame_unknown"
            continue
        source = stored if frame == "stored" else upright(stored, turn)
        b = [Fraction(v) for v in (x, y, w, h)]
        x0, y0 = max(0, math.floor(b[0] - margin * b[2])), max(0, math.floor(b[1] - margin * b[3]))
        x1, y1 = min(source.shape[1], math.ceil(b[0] + b[2] + margin * b[2])), min(source.shape[0], math.ceil(b[1] + b[3] + margin * b[3]))
        grown = (math.floor(b[0] - margin * b[2]), math.floor(b[1] - margin * b[3]), math.ceil(b[0] + b[2] + margin * b[2]), math.ceil(b[1] + b[3] + margin * b[3]))
        if x1 <= x0 or y1 <= y0:
            out[k] = "box_outside_image"
            continue
        km2 = dict(MAP).get(label)
        if km2 in (None, "excluded"):
            out[k] = "excluded_by_class_map" if km2 else "unmapped_class"
            continue
        part = source[y0:y1, x0:x1]
        part = upright(part, turn) if frame == "stored" else part
        out[k] = (km2, "holdout_unknown" if km2 == "unknown_als" else split, (x0, y0, x1, y1) != grown, part)
    return out


def boxes_of(spark):
    class_map = spark.createDataFrame(MAP, "class_raw string, class_km2 string")
    return crops.crop_boxes(spark.createDataFrame(parents(), PARENT).withColumn("notes", F.lit("n")), class_map, "0.1", ["unknown_als", "unknown_wm"])


def images_of(spark):
    return spark.createDataFrame([(r[0], bytearray(png_of(pixels_of(int(r[0][2:]), r[4], r[5])))) for r in parents() if r[0] != "none"], "image_id string, content binary")


def test_boxes_and_pixels_equal_plain_ones(spark):
    rows = boxes_of(spark).cache()
    got = {r.name: r for r in crops.cut_pixels(rows, images_of(spark)).collect()}
    cut = 0
    for r in rows.collect():
        want = plain(next(p for p in parents() if p[0] == r.image_id))[r.box_index]
        if isinstance(want, str):
            assert r.reason == want and r.name not in got
            continue
        km2, split, clipped, part = want
        cut += 1
        assert (r.reason, r.class_km2, r.split, r.clipped) == (None, km2, split, clipped), r
        assert (grey_of(bytes(got[r.name].content)) == part).all() and (got[r.name].width, got[r.name].height) == part.shape[::-1]
        # where it lies in the upright image
        p = next(p for p in parents() if p[0] == r.image_id)
        whole = upright(pixels_of(int(p[0][2:]), p[4], p[5]), p[6] or 1)
        s = r.seen
        assert (whole[s.y0 : s.y1, s.x0 : s.x1] == part).all()
    assert cut > 20 and len(got) == cut


def test_an_image_that_cannot_be_decoded_has_no_crops(spark):
    rows = boxes_of(spark)
    broken = images_of(spark).withColumn("content", F.lit(b"no image"))
    assert crops.cut_pixels(rows, broken).count() == 0


def test_copies_and_files(spark, tmp_path):
    folder = str(tmp_path / "crops")
    rows = [("a", b"1"), ("b", b"2"), ("c", b"1"), ("d", b"1")]

    def table(pairs):
        return spark.createDataFrame([(f"{n}.png", bytearray(b)) for n, b in pairs], "name string, content binary").withColumn("sha256", F.sha2("content", 256))

    kept, copies = crops.first_of_copies(table(rows))
    assert sorted(r.name for r in kept.collect()) == ["a.png", "b.png"] and sorted(r.name for r in copies.collect()) == ["c.png", "d.png"]
    acts = lambda pairs: {r.name[0]: r.action for r in crops.publish_files(table(pairs), folder).collect()}
    assert acts(rows) == dict.fromkeys("abcd", "add")
    assert acts(rows) == dict.fromkeys("abcd", "keep")
    assert acts([("a", b"1"), ("b", b"3"), ("e", b"5")]) == {"a": "keep", "b": "replace", "c": "delete", "d": "delete", "e": "add"}
    assert {p.name: p.read_bytes() for p in (tmp_path / "crops").glob("*.png")} == {"a.png": b"1", "b.png": b"3", "e.png": b"5"}
    assert not list((tmp_path / "crops").glob("*.part"))
    assert acts([]) == dict.fromkeys("abe", "delete")


def test_published_tables_have_no_gap(spark, tmp_path, monkeypatch):
    import pytest

    from strataforge.sources import sinks

    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path)
    assert sinks.publish(spark.range(3), path) == 1 and sinks.publish(spark.range(5), path, 1) == 2
    assert sinks.read_published(spark, path).count() == 5 and sinks.read_published(spark, path, 1).count() == 3
    with pytest.raises(sinks.ConcurrentWrite, match="version 2 is there"):
        sinks.publish(spark.range(9), path, 1)
    # another writer takes the number between this one's look and its entry
    seen = sinks._versions(spark, path)
    sinks.publish(spark.range(7), path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_versions", lambda *_: seen)
        with pytest.raises(sinks.ConcurrentWrite, match="taken by another"):
            sinks.publish(spark.range(9), path, 2)
    assert sinks.read_published(spark, path).count() == 7
    # a writer that fails after its rows, or after it has taken a number, leaves the old table
    rows = spark.range(11)
    rows.write.parquet(f"{path}/data-lost")
    (tmp_path / "table" / "_versions" / f"{4:012d}").touch()
    assert sinks.read_published(spark, path).count() == 7
    assert sinks.publish(rows, path) == 5 and sinks.read_published(spark, path).count() == 11


def test_unchanged_rows_are_not_published(spark, tmp_path):
    from strataforge.sources import sinks

    path = str(tmp_path / "table")
    rows = spark.range(4).withColumn("built", F.lit("now"))
    assert sinks.write_if_changed(rows, path, ("built",)) and not sinks.write_if_changed(rows.withColumn("built", F.lit("later")).repartition(3), path, ("built",))
    assert sinks.write_if_changed(rows.limit(2), path, ("built",)) and sinks.read_published(spark, path).count() == 2
