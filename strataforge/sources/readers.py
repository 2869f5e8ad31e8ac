"""Readers: files and texts to label rows. Each reader is a function of DataFrames, kept in a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.functions.scalars import day_from_exif, day_from_iso, day_from_millis, file_stem, trailing_digits

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str) -> Callable:
    """Registers a reader."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[name] = f
        return f

    return add


def scan_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, length, sha256, content)`` of all files below a folder (S01, S09). Columns that aren't asked for are not computed; a listing reads no file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(F.expr(f"substring(path, locate('{folder.rstrip('/')}', path) + {len(folder.rstrip('/')) + 1})").alias("path"), "length", F.sha2("content", 256).alias("sha256"), "content")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines with a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def parse_jsonl(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    return lines.where(F.trim(column) != "").select(F.from_json(column, schema).alias("r")).select("r.*")


def parse_sums(lines: Column) -> tuple[Column, Column]:
    """Digest and path of a checksum line, ``<hex> [*]<path>``."""
    pattern = r"^([0-9a-fA-F]{64})\s+\*?(.+)$"
    return F.nullif(F.lower(F.regexp_extract(lines, pattern, 1)), F.lit("")), F.nullif(F.regexp_extract(lines, pattern, 2), F.lit(""))


def provenance(records: DataFrame) -> DataFrame:
    """Source address and version of download records (S12): a DOI's address before the record's, a version before the day of publication."""
    return records.withColumn("source_record", F.coalesce(F.concat(F.lit("https://doi.org/"), F.nullif("doi", F.lit(""))), "record_url")).withColumn("source_version", F.coalesce(F.nullif("version", F.lit("")), F.substring("published", 1, 10)))


@reader("folder")
def folder_labels(files: DataFrame) -> DataFrame:
    """<split>/<label>/<name>: the middle part is the label; other depths have none."""
    parts = F.split("path", "/")
    return files.withColumn("class_raw", F.when(F.size(parts) == 3, F.element_at(parts, 2))).withColumn("excluded", F.when(F.col("class_raw").isNull(), "no_label"))


@reader("chunks")
def chunk_labels(files: DataFrame) -> DataFrame:
    """The label is the folder's name without its trailing digits; the day comes from EXIF."""
    parent = F.element_at(F.split("path", "/"), -2)
    return files.withColumn("class_raw", trailing_digits(parent)).withColumn("day", day_from_exif(F.col("exif")))


BOXES = "array<struct<x:bigint,y:bigint,w:bigint,h:bigint,class_raw:string>>"


def voc_boxes(xml: Column) -> Column:
    """Boxes of a Pascal VOC text in the file's order; incomplete ones are skipped, numbers rounded half to even."""
    kind = "object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
    objects = F.from_xml(xml, kind, {"rowTag": "annotation"})["object"]
    number = lambda x: F.bround(x.try_cast("double"), 0).cast("bigint")

    def box(o: Column) -> Column:
        b = o["bndbox"]
        x0, y0, x1, y1 = (number(b[k]) for k in ("xmin", "ymin", "xmax", "ymax"))
        whole = o["name"].isNotNull() & x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
        return F.when(whole, F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"), o["name"].alias("class_raw")))

    return F.coalesce(F.array_compact(F.transform(objects, box)), F.array().cast(BOXES))


@reader("voc")
def voc_labels(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """The label is the distinct box names, sorted and joined by `` + ``; drawn boxes are excluded; day and session come from the name."""
    notes = annotations.select(file_stem(F.col("path")).alias("__stem"), voc_boxes(F.col("xml")).alias("boxes"))
    out = files.withColumn("__file", file_stem(F.col("path"))).join(notes, F.col("__file") == F.col("__stem"), "left")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("boxes", lambda b: b["class_raw"]))), " + ")
    day = F.nullif(F.regexp_extract("__file", r"^ds-([0-9]{4}-[0-9]{2}-[0-9]{2})-", 1), F.lit(""))
    drawn = F.element_at(F.split("path", "/"), -2) == "bbox"
    label = F.when(~drawn, F.nullif(names, F.lit("")))
    out = out.withColumn("class_raw", label).withColumn("excluded", F.when(drawn, "drawn_boxes").when(label.isNull(), "no_label"))
    return out.withColumn("day", day).withColumn("session", F.when(day.isNotNull(), F.regexp_replace("__file", "-[^-]*$", ""))).drop("__file", "__stem")


@reader("sidecar")
def sidecar_labels(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Label, place, day, variety and age from an XML beside the image; images in a healthy folder need none."""
    kind = "class string, district string, subcounty string, datetime string, variety string, age string"
    notes = annotations.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("__stem"), F.from_xml("xml", kind, {"rowTag": "annotation"}).alias("a"), voc_boxes(F.col("xml")).alias("__boxes"))
    out = files.withColumn("__file", F.regexp_replace("path", r"\.[^./]+$", "")).join(notes, F.col("__file") == F.col("__stem"), "left")
    told = F.coalesce(F.col("a.class") != "", F.lit(False))
    healthy = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "_[0-9]+$", "") == "healthy"
    return out.select(
        "path",
        F.when(told, F.col("a.class")).when(healthy, "healthy").alias("class_raw"),
        F.when(told, F.col("a.district")).alias("district"),
        F.when(told, F.col("a.subcounty")).alias("subcounty"),
        F.when(told, day_from_iso(F.col("a.datetime"))).when(healthy, day_from_millis(file_stem(F.col("path")))).alias("day"),
        F.when(told, F.col("a.variety")).alias("variety"),
        F.when(told, F.bround(F.col("a.age").try_cast("double"), 0).cast("bigint")).alias("plant_age"),
        F.when(told, F.col("__boxes")).alias("boxes"),
        F.when(~told & ~healthy, "no_label").alias("excluded"),
    )


def download_status(wanted: Column, size: Column, expected: Column, digest: Column, listed: Column, failed: Column) -> Column:
    """The state of a file of a record (the algebra of S17): not_requested, failed, missing, failed on a wrong size or digest, verified, unverified."""
    return (
        F.when(~wanted, "not_requested")
        .when(failed, "failed")
        .when(size.isNull(), "missing")
        .when(expected.isNotNull() & (size != expected), "failed")
        .when(listed.isNotNull() & (digest != listed), "failed")
        .when(listed.isNotNull(), "verified")
        .otherwise("unverified")
    )
