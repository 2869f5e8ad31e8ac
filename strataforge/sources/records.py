"""Source records: saved answers of four kinds of repositories as one table of records and one of files.

Nothing is fetched here. An adapter takes the answer's JSON text and what the
configuration pins, and gives a struct; a registry names the adapters by kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADAPTERS: dict[str, Callable[[Column], Column]] = {}

# The parts of each answer that are read.
SHAPES = {
    "zenodo": "doi string, links struct<self_html:string>, metadata struct<version:string,publication_date:string,title:string,license:string,creators:array<struct<name:string>>>, files array<struct<key:string,size:bigint,checksum:string,links:struct<self:string>>>",
    "huggingface": "repo string, revision string, path string, info struct<author:string,lastModified:string,cardData:struct<pretty_name:string,license:string>>, tree array<struct<type:string,path:string,size:bigint,lfs:struct<oid:string>>>",
    "mendeley": "id string, version bigint, name string, publish_date string, doi struct<id:string>, data_licence struct<short_name:string,url:string>, contributors array<struct<first_name:string,last_name:string>>, files array<struct<id:string,filename:string,size:bigint,content_details:struct<size:bigint,sha256_hash:string,download_url:string>>>",
    "dataverse": "status string, data struct<publicationDate:string,latestVersion:struct<versionNumber:bigint,versionMinorNumber:bigint,releaseTime:string,license:string,termsOfUse:string,metadataBlocks:struct<citation:struct<fields:array<struct<typeName:string,value:string>>>>,files:array<struct<dataFile:struct<id:bigint,filename:string,filesize:bigint,md5:string,checksum:struct<type:string,value:string>>>>>>",
}
FILES = "array<struct<name:string,size:bigint,checksum:string,url:string>>"


def adapter(kind: str) -> Callable:
    """Registers an adapter for answers of ``kind``: it is given the parsed struct and the id that the configuration pins."""

    def add(f: Callable) -> Callable:
        ADAPTERS[kind] = f
        return f

    return add


def _record(title: Column, url: Column, doi: Column, version: Column, published: Column, creators: Column, licence: Column, files: Column) -> Column:
    return F.struct(
        title.alias("title"), url.alias("record_url"), doi.alias("doi"), version.alias("version"), published.alias("published"),
        F.coalesce(creators, F.array().cast("array<string>")).alias("creators"), F.array_compact(licence).alias("licence_stated"), F.coalesce(files, F.array()).cast(FILES).alias("files"),
    )


def _file(name: Column, size: Column, checksum: Column, url: Column) -> Column:
    return F.struct(name.alias("name"), size.alias("size"), checksum.alias("checksum"), url.alias("url"))


def _tagged(tag: Column, value: Column) -> Column:
    """``<algorithm>:<hex>``; null without a value."""
    return F.concat(tag, F.lit(":"), F.nullif(value, F.lit("")))


@adapter("zenodo")
def zenodo(r: Column, pinned: Column) -> Column:
    files = F.transform(r["files"], lambda f: _file(f["key"], f["size"], f["checksum"], f["links"]["self"]))
    m = r["metadata"]
    page = F.coalesce(r["links"]["self_html"], F.concat(F.lit("https://zenodo.org/records/"), pinned))
    return _record(m["title"], page, r["doi"], m["version"], m["publication_date"], F.transform(m["creators"], lambda c: c["name"]), F.array(m["license"]), files)


@adapter("huggingface")
def huggingface(r: Column, pinned: Column) -> Column:
    """``pinned`` is <repository>@<revision>; only files of the tree are listed."""
    base = F.concat(F.lit("https://huggingface.co/datasets/"), F.substring_index(pinned, "@", 1))
    revision = F.substring_index(pinned, "@", -1)
    own = F.filter(r["tree"], lambda t: t["type"] == "file")
    files = F.transform(own, lambda t: _file(F.substring_index(t["path"], "/", -1), t["size"], _tagged(F.lit("sha256"), t["lfs"]["oid"]), F.concat(base, F.lit("/resolve/"), revision, F.lit("/"), t["path"])))
    page = F.rtrim(F.concat(base, F.lit("/tree/"), revision, F.lit("/"), F.coalesce(r["path"], F.lit(""))), F.lit("/"))
    return _record(r["info"]["cardData"]["pretty_name"], page, F.lit(None).cast("string"), revision, r["info"]["lastModified"], F.array_compact(F.array(r["info"]["author"])), F.array(r["info"]["cardData"]["license"]), files)


@adapter("mendeley")
def mendeley(r: Column, pinned: Column) -> Column:
    """``pinned`` is <id>.<version>."""
    key, version = F.substring_index(pinned, ".", 1), F.substring_index(pinned, ".", -1)
    own = lambda f: F.concat(F.lit("https://data.mendeley.com/public-files/datasets/"), key, F.lit("/files/"), f["id"], F.lit("/file_downloaded"))
    files = F.transform(
        r["files"],
        lambda f: _file(f["filename"], F.coalesce(F.nullif(f["content_details"]["size"], F.lit(0)), f["size"]), _tagged(F.lit("sha256"), f["content_details"]["sha256_hash"]), F.coalesce(f["content_details"]["download_url"], own(f))),
    )
    names = F.transform(r["contributors"], lambda c: F.concat_ws(", ", F.nullif(c["last_name"], F.lit("")), F.nullif(c["first_name"], F.lit(""))))
    return _record(r["name"], F.concat(F.lit("https://data.mendeley.com/datasets/"), key, F.lit("/"), version), r["doi"]["id"], version, r["publish_date"], names, F.array(r["data_licence"]["short_name"], r["data_licence"]["url"]), files)


@adapter("dataverse")
def dataverse(r: Column, pinned: Column) -> Column:
    """``pinned`` is the DOI without its prefix."""
    server, v = "https://dataverse.harvard.edu", r["data"]["latestVersion"]

    def one(f: Column) -> Column:
        d = f["dataFile"]
        return _file(d["filename"], d["filesize"], F.coalesce(_tagged(d["checksum"]["type"], d["checksum"]["value"]), _tagged(F.lit("md5"), d["md5"])), F.concat(F.lit(f"{server}/api/access/datafile/"), d["id"].cast("string")))

    version = F.concat_ws(".", v["versionNumber"].cast("string"), v["versionMinorNumber"].cast("string"))
    page = F.concat(F.lit(f"{server}/dataset.xhtml?persistentId=doi:"), pinned)
    # a field's value is a text or a list of parts: it stays JSON until its type is known
    field = lambda name: F.get(F.filter(v["metadataBlocks"]["citation"]["fields"], lambda x: x["typeName"] == name), F.lit(0))["value"]
    authors = F.transform(F.from_json(field("author"), "array<struct<authorName:struct<value:string>>>"), lambda a: a["authorName"]["value"])
    return _record(field("title"), page, pinned, version, F.coalesce(v["releaseTime"], r["data"]["publicationDate"]), authors, F.array(v["license"], v["termsOfUse"]), F.transform(v["files"], one))


def _broken(kind: str, r: Column, pinned: Column) -> Column:
    """Why an answer is not the record that the configuration pins."""
    if kind == "mendeley":
        return F.when(~F.coalesce(r["version"].cast("string") == F.substring_index(pinned, ".", -1), F.lit(False)), "another_version")
    if kind == "dataverse":
        return F.when(~F.coalesce(r["status"] == "OK", F.lit(False)), "bad_status")
    return F.when(r["files" if kind == "zenodo" else "tree"].isNull(), "no_files")


def read_records(answers: DataFrame, kind: str = "kind", pinned: str = "pinned", body: str = "body") -> DataFrame:
    """``answers`` with ``title, record_url, doi, version, published, creators, licence_stated, files`` and ``reason``.

    ``reason`` is null for a good record; ``unknown_kind``, ``not_json``, ``another_version``,
    ``bad_status`` or ``no_files`` otherwise, and then the rest is null. One pass; a bad answer never fails the job.
    """
    record, why, told = None, None, F.col(kind)
    for name, f in ADAPTERS.items():
        r = F.from_json(F.col(body), SHAPES[name])
        valid = F.try_parse_json(F.col(body)).isNotNull()
        bad = F.when(~F.coalesce(valid, F.lit(False)), "not_json").otherwise(_broken(name, r, F.col(pinned)))
        own = F.when(bad.isNull(), f(r, F.col(pinned)))
        record = F.when(told == name, own) if record is None else record.when(told == name, own)
        why = F.when(told == name, bad) if why is None else why.when(told == name, bad)
    out = answers.withColumn("__r", record).withColumn("reason", why.when(told.isNull() | ~told.isin(*ADAPTERS), "unknown_kind"))
    return out.select(*answers.columns, "__r.*", "reason")


def record_files(records: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each file of good records, with its place from 0."""
    return records.select(*keys, F.posexplode("files").alias("place", "f")).select(*keys, "place", "f.*")
