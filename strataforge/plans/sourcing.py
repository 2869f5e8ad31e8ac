"""Reader queries: labels, boxes, days and addresses from names and texts."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import scalars
from strataforge.plans import query
from strataforge.plans.tables import table
from strataforge.session import fresh_path
from strataforge.sources import images, readers, sinks
from strataforge.sources.images import PNG


@query("""select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as class_raw, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, len(regexp_extract_all(html, '<a href=')) as n_links from pages""")
def parse_html_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("class_raw"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_count("html", F.lit("<a href=")).cast("bigint").alias("n_links"))


@query("""select c_custkey, case when c_custkey % 4 = 0 then null else c_mktsegment end as class_raw, case when c_custkey % 4 = 0 then 'no_label' end as excluded from customer""")
def folder_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    deep = F.concat_ws("/", F.lit("train"), "c_mktsegment", "c_name")
    files = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("train/"), F.col("c_name"))).otherwise(deep).alias("path"))
    return readers.READERS["folder"](files).select("c_custkey", "class_raw", "excluded")


@query("""select c_custkey, regexp_replace(c_mktsegment, '[0-9]+$', '') as class_raw, case when c_custkey % 3 = 0 then null else '2024-0' || cast(c_custkey % 9 + 1 as varchar) || '-15' end as day from customer""")
def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    exif = F.when(k % 3 == 0, "0000:00:00 00:00:00").otherwise(F.concat(F.lit("2024:0"), (k % 9 + 1).cast("string"), F.lit(":15 10:00:00")))
    files = c.select("c_custkey", F.concat_ws("/", F.concat("c_mktsegment", (k % 12).cast("string")), "c_name").alias("path"), exif.alias("exif"))
    return readers.READERS["chunks"](files).select("c_custkey", "class_raw", "day")


def _annotation(k, name):
    """A VOC text with two boxes; the second lacks a corner on every fifth row."""
    box = lambda n, x, end: F.concat(F.lit("<object><name>"), n, F.lit("</name><bndbox><xmin>"), x.cast("string"), F.lit(".5</xmin><ymin>2</ymin>"), end, F.lit("<ymax>40.5</ymax></bndbox></object>"))
    full = F.lit("<xmax>90</xmax>")
    return F.concat(F.lit("<annotation>"), box(name, k % 7, full), box(F.lit("rust"), k % 5, F.when(k % 5 == 0, F.lit("")).otherwise(full)), F.lit("</annotation>"))


@query("""with b as (select p_partkey, p_type as name, p_partkey % 7 as x, 0 as box_index from part union all select p_partkey, 'rust', p_partkey % 5, 1 from part where p_partkey % 5 <> 0)
select p_partkey, cast(box_index as integer) as box_index, cast(round_even(x + 0.5, 0) as bigint) as x, cast(2 as bigint) as y, cast(90 - round_even(x + 0.5, 0) as bigint) as w, cast(38 as bigint) as h, name as class_raw from b""")
def voc_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", readers.voc_boxes(_annotation(F.col("p_partkey"), F.col("p_type"))).alias("boxes"))
    return p.select("p_partkey", F.posexplode("boxes").alias("box_index", "b")).select("p_partkey", "box_index", "b.*")


@query("""select p_partkey, case when p_partkey % 4 = 3 then null when p_partkey % 5 = 0 then p_type when p_type = 'rust' then 'rust' else least(p_type, 'rust') || ' + ' || greatest(p_type, 'rust') end as class_raw,
 case when p_partkey % 4 = 3 then 'drawn_boxes' end as excluded, case when p_partkey % 2 = 0 then '2021-05-0' || cast(p_partkey % 9 + 1 as varchar) end as day from part""")
def voc_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    name = F.when(k % 2 == 0, F.concat(F.lit("ds-2021-05-0"), (k % 9 + 1).cast("string"), F.lit("-field-"), k.cast("string"))).otherwise(F.concat(F.lit("im"), k.cast("string")))
    folder = F.when(k % 4 == 3, "train/bbox/").otherwise("train/images/")
    files = p.select("p_partkey", F.concat(folder, name, F.lit(".jpg")).alias("path"))
    notes = p.select(F.concat(F.lit("voc/train/"), name, F.lit(".xml")).alias("path"), _annotation(k, F.col("p_type")).alias("xml"))
    return readers.READERS["voc"](files, notes).select("p_partkey", "class_raw", "excluded", "day")


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_type when p_partkey % 3 = 1 then 'healthy' end as class_raw, case when p_partkey % 3 = 0 then '2020-11-03' when p_partkey % 3 = 1 then '2021-03-15' end as day,
 case when p_partkey % 3 = 0 then cast(3 as bigint) end as plant_age, case when p_partkey % 3 = 2 then 'no_label' end as excluded from part""")
def sidecar_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    stem = F.when(k % 3 == 1, F.concat(F.lit("healthy_"), F.expr("p_partkey div 100000"), F.lit("/16157999"), F.lpad((k % 100000).cast("string"), 5, "0"))).otherwise(F.concat(F.lit("sick_1/"), k.cast("string")))
    files = p.select("p_partkey", F.concat(stem, F.lit(".jpg")).alias("path"))
    xml = F.concat(F.lit("<annotation><class>"), F.col("p_type"), F.lit("</class><district>d</district><datetime>2020-11-03T23:30:00+03:00</datetime><variety>v</variety><age>2.6</age></annotation>"))
    notes = p.where(k % 3 == 0).select(F.concat(stem, F.lit(".xml")).alias("path"), xml.alias("xml"))
    out = readers.READERS["sidecar"](files, notes)
    return files.join(out, "path").select("p_partkey", "class_raw", "day", "plant_age", "excluded")


@query("""select o_orderkey, sha256(cast(o_orderkey as varchar)) as digest, 'dir/f' || cast(o_orderkey as varchar) as path from orders where o_orderkey % 5 <> 0""")
def sums_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, "# comment").otherwise(F.concat(F.upper(F.sha2(k.cast("string"), 256)), F.when(k % 2 == 0, " *").otherwise("  "), F.lit("dir/f"), k.cast("string")))
    rows = table(spark, d, "orders").select(k, line.alias("line"))
    digest, path = readers.parse_sums(F.col("line"))
    return rows.select("o_orderkey", digest.alias("digest"), path.alias("path")).where("digest is not null")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'https://doi.org/10.1/' || cast(c_custkey as varchar) else 'https://r.example/' || cast(c_custkey as varchar) end as source_record, case when c_custkey % 2 = 0 then 'v2' else '2020-02-03' end as source_version from customer""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k)).otherwise("").alias("doi"), F.concat(F.lit("https://r.example/"), k).alias("record_url"), F.when(k % 2 == 0, "v2").alias("version"), F.lit("2020-02-03T00:00:00Z").alias("published"))
    return readers.provenance(rows).select("c_custkey", "source_record", "source_version")


@query("""select event_id, cast(ts + interval 3 hour as date)::varchar as day from events""")
def millis_day(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", scalars.day_from_millis(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("day"))


@query("""select event_id, case event_type when 'click' then 'relative' when 'view' then 'absolute' when 'error' then 'unserved' when 'signup' then 'escape' else 'file' end as kind from events""")
def uri_classify(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    uri = F.when(kind == "click", "a/./b/../c.jpg").when(kind == "view", "/data/c.jpg").when(kind == "error", "mcap://bag/topic/1").when(kind == "signup", "a/../../c.jpg").otherwise("file:///data/c.jpg")
    return table(spark, d, "events").select("event_id", scalars.uri_kind(uri).alias("kind"))


@query("""select state, count(*) as n from (select case when event_type = 'click' then 'not_requested' when event_type = 'error' then 'failed' when event_id % 5 = 0 then 'missing' when event_id % 7 = 0 then 'failed' when event_id % 2 = 0 then 'verified' else 'unverified' end as state from events) group by state""")
def download_states(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    size = F.when(k % 5 != 0, F.when(k % 7 == 0, 3).otherwise(4))
    state = readers.download_status(kind != "click", size, F.lit(4), F.lit("x"), F.when(k % 2 == 0, "x"), kind == "error")
    return table(spark, d, "events").select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where props is not null""")
def jsonl_rows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    lines = table(spark, d, "events").select("event_id", F.from_json("props", T.StructType([T.StructField("k", T.LongType())])).alias("r"))
    return lines.select("event_id", "r.k")


@query()
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The files of the data folder with their sizes; contents are not read."""
    return readers.scan_files(spark, d, "*.parquet").select("path", "length")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _tags(turn: int, taken: str) -> bytes:
    """An EXIF block with an orientation and a time."""
    own = struct.pack("<HHHIIHHIII", 2, 0x0112, 3, 1, turn, 0x8769, 4, 1, 38, 0)
    return b"II*\0" + struct.pack("<I", 8) + own + struct.pack("<HHHIII", 1, 0x9003, 2, len(taken) + 1, 56, 0) + taken.encode() + b"\0"


def _picture(key: int, text: bytes) -> bytes:
    """A document as a grey image of all its bytes; every fifth is a JPEG's head, no image, cut off, or turned."""
    width, kind = 16 + key % 17, key % 5
    height = max(1, -(-len(text) // width))
    if kind == 2:
        return text
    if kind == 1:
        block = b"Exif\0\0" + _tags(6, f"2024:{key % 14:02d}:11 10:00:00")
        return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, height % 65536, width, 1)
    pixels = text.ljust(width * height, b"\0")
    lines = b"".join(b"\0" + pixels[y * width : (y + 1) * width] for y in range(height))
    turn = _chunk(b"eXIf", _tags(3, "none")) if kind == 4 else b""
    whole = PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + turn + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")
    return whole[:-20] if kind == 3 else whole


@query("""with d as (select doc_id as id, doc_id % 5 as k, 16 + doc_id % 17 as w, greatest(1, (coalesce(strlen(text), 0) + 15 + doc_id % 17) // (16 + doc_id % 17)) as h from documents)
select id, case k when 1 then 'jpeg' when 0 then 'png' when 4 then 'png' end as format, cast(case when k = 1 then h when k in (0, 4) then w end as integer) as width, cast(case when k = 1 then w when k in (0, 4) then h end as integer) as height,
  cast(case k when 1 then 6 when 0 then 1 when 4 then 3 end as integer) as orientation, case when k = 1 and id % 14 between 1 and 12 then '2024-' || lpad(cast(id % 14 as varchar), 2, '0') || '-11' end as exif_day,
  k in (0, 4) as hashed, case k when 2 then 'not_an_image' when 3 then 'decode_error' end as reason from d""")
def image_inspect(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn as images, and what their bytes say."""

    @F.arrow_udf("binary")
    def draw(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_picture(k, (t or "").encode()) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)], pa.binary())

    docs = table(spark, d, "documents")
    files = docs.select(F.col("doc_id").alias("id"), draw("doc_id", "text").alias("content"))
    return images.inspect_images(files).select("id", "format", "width", "height", "orientation", "exif_day", F.col("phash").isNotNull().alias("hashed"), "reason")


@query("""select 1 as version, c_nationkey as nation, count(*) as n from customer where c_custkey % 2 = 0 group by 2 union all select 2, c_nationkey, count(*) from customer group by 2""")
def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table that is published, found unchanged, and published again: both versions can be read."""
    path = fresh_path(spark, "published")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    for part in (rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 0").repartition(3, "nation"), rows):
        sinks.write_if_changed(part, path)
    read = lambda v: sinks.read_published(spark, path, v).groupBy("nation").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "nation", "n")
    return read(1).union(read(2))
