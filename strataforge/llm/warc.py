"""Operator 10: WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.arrow_text import rows_per_batch
from strataforge.llm.joins import spread_join
from strataforge.session import fresh_path, staged

#: Captures of a compressed index block, bytes of an archive file, bytes that one range read takes at most when neighbours are read together.
LINES, FILE_BYTES, READ_BYTES = 3000, 1 << 30, 4 << 20
#: Records that one task reads back, about.
RECORDS = 1 << 14
#: Directory entries (about 300 bytes each) that one round of look-ups broadcasts.
DIRECTORY = 200_000
DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def reversed_host_key(url: str | None) -> str:
    """Host labels from the top domain down, then port, path and query: ``com,example)/a?b``."""
    try:
        u = urlsplit(url or "")
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return f"){url}"
    if not host:
        return f"){url or ''}"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def _uri(url: str | None, page: int | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else f"urn:page:{page}"


def _record_id(page: int | None, digest: str) -> str:
    h = hashlib.sha1(f"{page}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """A WARC/1.1 response record, or a revisit record (``payload`` None) that names the page it repeats."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": _record_id(page, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": _uri(url, page),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page is not None:
        head["Page-Id"] = str(page)
    if payload is None:
        head |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": _record_id(refers, digest), "Refers-To-Page-Id": str(refers), "WARC-Truncated": "length"}
    body = answer + (payload or b"")
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(body))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    head, _, body = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    body = body[: int(fields["Content-Length"])]
    answer, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in answer.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-Id"), "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _task_name() -> str:
    """A name of this attempt alone, so that a task that runs again never writes over files that are in use."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def roles(pages: DataFrame, least: int) -> DataFrame:
    """``(__page, __digest, refers)``: for each page and payload the page that it repeats, null for responses."""
    body = F.coalesce("html", F.lit(""))
    named = pages.select(F.col("page_id").alias("__page"), F.sha1(F.encode(body, "UTF-8")).alias("__digest"), F.octet_length(body).alias("__n")).distinct()
    named = staged(named, "payloads")
    first = named.where(F.col("__n") >= least).groupBy("__digest").agg(F.min("__page").alias("__first"))
    # an id that is null cannot be referred to and does not repeat another
    refers = F.when(F.col("__page") != F.col("__first"), F.col("__first"))
    # one payload may be that of a third of all pages
    counts = named.groupBy("__digest").agg(F.count(F.lit(1)).alias("n"))
    return spread_join(named, first, "__digest", counts, ["__page"], "left").select("__page", "__digest", refers.alias("refers"))


def write_archive(pages: DataFrame, folder: str, least: int = 0, lines: int = LINES) -> DataFrame:
    """Writes WARC files and the capture index of ``pages(page_id, url, html)`` under ``folder``; gives the block directory.

    Of pages with equal payloads of at least ``least`` bytes, that with the
    smallest id is a response record and the others revisit it. Null html is an empty payload; a null id is always
    a response. Each record is a gzip member of its own. Index lines,
    sorted by reversed-host key and page, are cut into gzip blocks of ``lines`` lines; the directory
    has a row for each block: first and last key and page, file, offset, length. Repeated rows have a record each; extra columns,
    whatever their names, are ignored; an empty table gives an empty directory.
    """
    spark = pages.sparkSession
    rows_per_batch(spark, 500)
    place, base = fs.FileSystem.from_uri(folder)
    place.create_dir(f"{base}/warc")
    place.create_dir(f"{base}/index")

    said = roles(pages.select("page_id", "html"), least)
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    marked = rows.withColumn("digest", digest).join(said, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")))
    ready = marked.select("page_id", "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), F.octet_length("html").cast("bigint").alias("size"), "digest", "refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        stream, name, offset, count = None, "", 0, 0
        try:
            for batch in batches:
                out = []
                for page, url, html, size, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if stream is None or offset >= FILE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, offset, count = f"{_task_name()}-{count:04d}.warc.gz", 0, count + 1
                        stream = where.open_output_stream(f"{root}/warc/{name}", compression=None)
                    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                    data = _gzip(record(page, url, None if html is None else html.encode(), size, b32, refers))
                    stream.write(data)
                    line = json.dumps({"page": page, "url": url, "digest": b32, "file": name, "offset": offset, "length": len(data)}, ensure_ascii=False)
                    out.append((reversed_host_key(url), page, line))
                    offset += len(data)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["key", "page", "line"])
        finally:
            if stream is not None:
                stream.close()

    captures = staged(ready.mapInArrow(write, "key string, page bigint, line string"), "captures")
    ordered = captures.repartitionByRange("key", "page").sortWithinPartitions("key", "page", "line")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        stream, name, offset, held, out = None, f"{_task_name()}.cdx.gz", 0, [], []

        def flush() -> None:
            nonlocal stream, offset
            if stream is None:
                stream = where.open_output_stream(f"{root}/index/{name}", compression=None)
            data = _gzip("".join(f"{json.dumps(k, ensure_ascii=False)} {x}\n" for k, x, _ in held).encode())
            stream.write(data)
            out.append((held[0][0], held[-1][0], name, offset, len(data), len(held), held[0][2], held[-1][2]))
            offset += len(data)
            held.clear()

        for batch in batches:
            for key, page, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((key, line, page))
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if stream is not None:
            stream.close()
        if out:
            kinds = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["first_key", "last_key", "file", "offset", "length", "lines", "first_page", "last_page"])

    return staged(ordered.mapInArrow(index, "first_key string, last_key string, file string, offset bigint, length bigint, lines bigint, first_page bigint, last_page bigint"), "directory")


def block_lines(where: fs.FileSystem, root: str, file: str, offset: int, length: int) -> list[tuple[str, dict]]:
    """One index block by a range read: (key, capture) in order."""
    with where.open_input_file(f"{root}/index/{file}") as f:
        text = zlib.decompress(f.read_at(length, offset), 31).decode()
    out, decode = [], json.JSONDecoder().raw_decode
    for line in text.split("\n")[:-1]:
        key, at = decode(line)
        out.append((key, json.loads(line[at + 1 :])))
    return out


_CAPTURE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _place(key: str, page: int | None) -> tuple:
    """The order of index lines: by key, then by page, null first."""
    return key, page is not None, page or 0


def _slices(directory: DataFrame) -> Iterator[list]:
    """The directory's rows, sorted, in slices of bounded size."""
    n = directory.count()
    parts = max(1, -(-n // DIRECTORY))
    for k in range(parts):
        part = directory if parts == 1 else directory.where(F.pmod(F.xxhash64("file", "offset"), F.lit(parts)) == k)
        yield sorted((_place(r.first_key, r.first_page), _place(r.last_key, r.last_page), r.file, r.offset, r.length) for r in part.collect())


def captures_of(directory: DataFrame, folder: str, pages: DataFrame) -> DataFrame:
    """``(file, offset, length)`` of the records of ``pages(url, page_id)``, by two bisections.

    Each distinct key, reversed host and page, is sought in the directory, which is broadcast in slices. The
    keys are then dealt by the block that may hold them and sorted, so that a task reads a block once, by range, and
    searches it for the keys of its batch. A block has a bounded number of lines, so that a key that many pages share is
    spread over its blocks.
    """
    spark = directory.sparkSession
    wanted = pages.select("url", "page_id").distinct()
    tasks = max(1, -(-(directory.agg(F.sum("lines")).first()[0] or 0) // RECORDS))
    located = None
    for rows in _slices(directory):
        shared = spark.sparkContext.broadcast(rows)

        def locate(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            firsts = [b[0] for b in blocks]
            for batch in batches:
                out = []
                for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = reversed_host_key(url)
                    own = _place(key, page)
                    k = bisect.bisect_right(firsts, own) - 1
                    while k >= 0 and blocks[k][1] >= own:  # equal lines may lie in more than one block
                        out.append((*blocks[k][2:], key, page))
                        k -= 1
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["file", "offset", "length", "key", "page"])

        found = wanted.mapInArrow(locate, "file string, offset bigint, length bigint, key string, page bigint")
        located = found if located is None else located.unionByName(found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        block, lines, places = None, [], []
        for batch in batches:
            out = []
            for file, offset, length, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, offset) != block:
                    block, lines = (file, offset), [x for x in block_lines(where, root, file, offset, length)]
                    places = [_place(k, x["page"]) for k, x in lines]
                own = _place(key, page)
                for _, x in lines[bisect.bisect_left(places, own) : bisect.bisect_right(places, own)]:
                    out.append((x["file"], x["offset"], x["length"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    dealt = located.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key", "page")
    return dealt.mapInArrow(search, "file string, offset bigint, length bigint")


def every_capture(directory: DataFrame, folder: str) -> DataFrame:
    """``(file, offset, length)`` of all records, block by block."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [x for _, x in block_lines(where, root, file, offset, length)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows]) for k in ("file", "offset", "length")], names=["file", "offset", "length"])

    return directory.select("file", "offset", "length").mapInArrow(entries, "file string, offset bigint, length bigint")


def read_archive(directory: DataFrame, folder: str, captures: DataFrame | None = None) -> DataFrame:
    """The records of ``captures`` (None: of all): ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Captures are dealt by file and offset, so that each task reads neighbouring records with few large range reads.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        name, source, data, start = None, None, b"", 0
        for batch in batches:
            table = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            out = []
            for i, (file, offset, length) in enumerate(table):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source, data, start = file, where.open_input_file(f"{root}/warc/{file}"), b"", 0
                if not start <= offset <= offset + length <= start + len(data):
                    end = offset + length
                    for f, o, n in table[i + 1 :]:
                        if f != file or o != end or o + n - offset > READ_BYTES:
                            break
                        end = o + n
                    data, start = source.read_at(end - offset, offset), offset
                out.append(read_record(zlib.decompress(data[offset - start : offset - start + length], 31)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in _FIELDS], names=[k for k, _ in _FIELDS])
        if source is not None:
            source.close()

    # pointers are far smaller than what they point at: the number of tasks follows the records
    tasks = max(1, -(-(directory.agg(F.sum("lines")).first()[0] or 0) // RECORDS))
    captures = every_capture(directory, folder) if captures is None else captures
    near = captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(records, _CAPTURE)


def look_up(directory: DataFrame, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of the given urls: ``(url, page_id, record_type, payload)``, by binary search.

    The directory, sorted by first key, is broadcast in slices of bounded size. For a
    url, the blocks that may hold its key are found by binary search, each is read by range
    and searched, and the record is read by range. Urls without a capture give no row.
    """
    spark = directory.sparkSession
    n = directory.count()
    out = None
    for at in range(max(1, -(-n // DIRECTORY))):
        part = directory if n <= DIRECTORY else directory.where(F.pmod(F.xxhash64("file", "offset"), F.lit(-(-n // DIRECTORY))) == at)
        rows = sorted((tuple(r) for r in part.select("first_key", "last_key", "file", "offset", "length").collect()))
        shared = spark.sparkContext.broadcast(rows)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            where, root = fs.FileSystem.from_uri(folder)
            blocks = shared.value
            firsts = [b[0] for b in blocks]
            for batch in batches:
                out = []
                for url in batch.column(0).to_pylist():
                    key = reversed_host_key(url)
                    k = bisect.bisect_right(firsts, key) - 1
                    while k >= 0 and (blocks[k][1] >= key):
                        lines = block_lines(where, root, *blocks[k][2:])
                        keys = [x for x, _ in lines]
                        for _, x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                            if x["url"] == url:
                                with where.open_input_file(f"{root}/warc/{x['file']}") as f:
                                    r = read_record(zlib.decompress(f.read_at(x["length"], x["offset"]), 31))
                                out.append((url, r["page_id"], r["record_type"], r["payload"]))
                        k -= 1
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["url", "page_id", "record_type", "payload"])

        found = urls.select(F.col(url_col).alias("url")).where("url is not null").mapInArrow(find, "url string, page_id bigint, record_type string, payload binary")
        out = found if out is None else out.unionByName(found)
    return out


def archive_and_read(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes ``pages`` as an archive and reads each page's record back, found by its key through the index."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    directory = write_archive(pages, folder, least)
    return read_archive(directory, folder, captures_of(directory, folder, pages))
