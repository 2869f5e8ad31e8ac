"""Feature archives: zipped arrays with a JSON sidecar, written by Spark tasks and read as a data source.

An archive is a zip file of arrays: ``image_id`` and ``sha256`` (strings), ``cls`` and ``meanpatch``
(rows x width). Its sidecar ``<stem>.meta.json`` has the five fields of the cache key, the key,
the digest of the manifest, the number of images, the type and the shapes. The zip's directory and the arrays'
headers are parsed here, so that only the arrays that are asked for are read, by ranges.
"""

from __future__ import annotations

import ast
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataforge.operators.caches import cache_problems
from strataforge.schemas import KEY_FIELDS, STORAGE_TYPE, TOKEN_TYPES

#: Columns of the data source, and rows that a batch has at most.
COLUMNS = {"image_id": "string", "sha256": "string", "cls": "array<float>", "meanpatch": "array<float>"}
ROWS = 4096
SUFFIX, SIDECAR = ".npz", ".meta.json"


class ArchiveError(Exception):
    """An archive that may not be loaded."""


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def key_of(meta: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the five key fields as a JSON list."""
    return hashlib.sha256(json.dumps([meta[k] for k in KEY_FIELDS]).encode()).hexdigest()[:16]


class Archive:
    """The directory of one zip file, and its arrays by ranges of rows."""

    def __init__(self, place: fs.FileSystem, path: str) -> None:
        self.file = place.open_input_file(path)
        size = self.file.size()
        tail = self._read(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ArchiveError(f"{path}: no zip directory")
        entries, length, start = struct.unpack_from("<HII", tail, at + 10)
        if start == 0xFFFFFFFF or length == 0xFFFFFFFF or entries == 0xFFFF:  # the larger form
            at = struct.unpack_from("<Q", tail, tail.rfind(b"PK\x06\x07") + 8)[0]
            entries, length, start = struct.unpack_from("<QQQ", self._read(at, 56), 32)
        directory, at = self._read(start, length), 0
        #: by name of an array: method, bytes held, bytes in full, place of the member
        self.members: dict[str, tuple[int, int, int, int]] = {}
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ArchiveError(f"{path}: broken zip directory")
            method, held, full = (struct.unpack_from(f, directory, at + k)[0] for f, k in (("<H", 10), ("<I", 20), ("<I", 24)))
            name, extra, comment = struct.unpack_from("<HHH", directory, at + 28)
            place_of = struct.unpack_from("<I", directory, at + 42)[0]
            more = directory[at + 46 + name : at + 46 + name + extra]
            held, full, place_of = _large(more, full, held, place_of)
            self.members[directory[at + 46 : at + 46 + name].decode().removesuffix(".npy")] = (method, held, full, place_of)
            at += 46 + name + extra + comment
        self.headers: dict[str, tuple[np.dtype, tuple[int, ...], int]] = {}

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _start(self, name: str) -> int:
        at = self.members[name][3]
        names, extra = struct.unpack_from("<HH", self._read(at, 30), 26)
        return at + 30 + names + extra

    def header(self, name: str) -> tuple[np.dtype, tuple[int, ...], int]:
        """Type, shape and length of the header of an array."""
        if name not in self.headers:
            method, held, _, _ = self.members[name]
            # a header is 128 bytes as a rule, and says at its start how long it is
            head = self._read(self._start(name), min(held, 1 << 16 if method == 8 else 128))
            if method == 8:
                head = zlib.decompressobj(-15).decompress(head, 1 << 16)
            if head[:6] != b"\x93NUMPY":
                raise ArchiveError(f"{name} is no array")
            wide = head[6] >= 2
            length = struct.unpack_from("<I" if wide else "<H", head, 8)[0]
            skip = 12 if wide else 10
            if method == 0 and length + skip > len(head):
                head = self._read(self._start(name), length + skip)
            fields = ast.literal_eval(head[skip : skip + length].decode("latin-1"))
            kind = np.dtype(fields["descr"])
            if kind.hasobject or fields["fortran_order"] and len(fields["shape"]) > 1:
                raise ArchiveError(f"{name}: objects and arrays by columns are not read")
            self.headers[name] = kind, tuple(fields["shape"]), length + skip
        return self.headers[name]

    def rows(self, name: str, first: int, end: int) -> np.ndarray:
        """Rows of an array; of a member that is held as it is only their bytes are read."""
        kind, shape, skip = self.header(name)
        method, held, _, _ = self.members[name]
        width = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        if method == 0:
            data = self._read(self._start(name) + skip + first * width, (end - first) * width)
        elif method == 8:
            if not hasattr(self, "whole"):
                self.whole: dict[str, bytes] = {}
            if name not in self.whole:
                self.whole[name] = zlib.decompress(self._read(self._start(name), held), -15)
            data = self.whole[name][skip + first * width : skip + end * width]
        else:
            raise ArchiveError(f"{name}: method {method} is not read")
        if len(data) < (end - first) * width:
            raise ArchiveError(f"{name} is cut off")
        return np.frombuffer(data, kind).reshape(end - first, *shape[1:])


def _large(extra: bytes, full: int, held: int, place: int) -> tuple[int, int, int]:
    """Sizes and place of a member; those that do not fit 32 bits stand in the extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            full, held, place = (next(values) if x == 0xFFFFFFFF else x for x in (full, held, place))
        at += 4 + n
    return held, full, place


def sidecar_of(path: str) -> str:
    return path.removesuffix(SUFFIX) + SIDECAR


def _meta(place: fs.FileSystem, path: str) -> dict | None:
    """The sidecar; None if it or the archive is not there."""
    both = place.get_file_info([path, sidecar_of(path)])
    if any(x.type != fs.FileType.File for x in both):
        return None
    with place.open_input_stream(sidecar_of(path)) as f:
        return json.loads(f.read())


def _arrays(archive: Archive) -> dict[str, tuple[str, list[int]]]:
    """Type and shape of each array."""
    headers = {k: archive.header(k) for k in archive.members}
    return {k: ("str" if kind.kind == "U" else kind.name, [int(n) for n in shape]) for k, (kind, shape, _) in headers.items()}


def problem_of(meta: dict | None, arrays: dict[str, tuple[str, list[int]]], manifest_sha256: str | None = None) -> str | None:
    """The first of the checks that fails, by the same names as in ``operators.caches.cache_problems``."""
    if meta is None:
        return "missing"
    if any(meta.get(k) is None for k in KEY_FIELDS):
        return "lacks_key_field"
    if key_of(meta) != meta.get("cache_key"):
        return "wrong_key"
    if manifest_sha256 is not None and meta.get("manifest_sha256") != manifest_sha256:
        return "other_manifest"
    tokens = meta.get("token_types") or TOKEN_TYPES
    if any(t not in arrays or arrays[t][1] != list((meta.get("shapes") or {}).get(t) or []) for t in tokens):
        return "shape"
    if any(arrays[t][0] != (meta.get("storage_dtype") or STORAGE_TYPE) for t in tokens):
        return "dtype"
    if any(t not in arrays or arrays[t][1][:1] != [meta.get("n_images")] for t in ("image_id", "sha256")):
        return "n_images"
    return None


class Shard(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict) -> None:
        self.columns, self.root, self.manifest = columns, options["path"], options.get("manifest_sha256")

    def partitions(self) -> list[InputPartition]:
        """One for each archive below the path."""
        place, root = _place(self.root)
        scheme = self.root[: len(self.root) - len(root)] if self.root.endswith(root) else ""
        if place.get_file_info(root).type == fs.FileType.File:
            return [Shard(scheme + root)]
        found = place.get_file_info(fs.FileSelector(root, recursive=True))
        return [Shard(p) for p in sorted(scheme + x.path for x in found if x.type == fs.FileType.File and x.path.endswith(SUFFIX))]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was no archive
            return
        place, path = _place(partition.path)
        meta = _meta(place, path)
        archive = Archive(place, path) if meta is not None else None
        if problem := problem_of(meta, _arrays(archive) if archive else {}, self.manifest):
            raise ArchiveError(f"{partition.path}: {problem}")
        for at in range(0, meta["n_images"], ROWS):
            end = min(at + ROWS, meta["n_images"])
            out = []
            for c in self.columns:
                x = archive.rows(c, at, end)
                if COLUMNS[c] == "string":
                    out.append(pa.array(x.tolist(), pa.string()))
                else:
                    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat))
            yield pa.RecordBatch.from_arrays(out, names=self.columns)


class FeatureArchive(DataSource):
    """``spark.read.format("feature_archive").option("columns", "image_id,cls").load(folder)``.

    ``columns`` names the arrays to read, all four if it is not given; of the others not a byte is read. ``manifest_sha256`` is the
    digest of the manifest that the archives must have been built from. Each archive is a partition, and is checked before its first row: a broken
    one fails the read with its reason. A folder without archives gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_archive"

    def _columns(self) -> list[str]:
        asked = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        if unknown := [c for c in asked if c not in COLUMNS]:
            raise ValueError(f"unknown columns {unknown}")
        return asked

    def schema(self) -> str:
        return ", ".join(f"{c} {COLUMNS[c]}" for c in self._columns())

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self._columns(), dict(self.options))


def read_archives(spark: SparkSession, folder: str, columns: list[str] | None = None, manifest_sha256: str | None = None) -> DataFrame:
    spark.dataSource.register(FeatureArchive)
    options = {"columns": ",".join(columns)} if columns else {}
    if manifest_sha256 is not None:
        options["manifest_sha256"] = manifest_sha256
    return spark.read.format("feature_archive").options(**options).load(folder)


def write_archives(rows: DataFrame, folder: str, shard: str, meta: dict, order: str = "image_id", storage: str = STORAGE_TYPE, change=None) -> DataFrame:
    """Writes ``rows(image_id, sha256, cls, meanpatch)`` as one archive for each value of ``shard``, in the order of ``order``; gives ``(path, n_images)``.

    A shard is held by one task, as an archive is: choose shards of bounded size. Files are written under a name of the attempt
    and renamed, so that a task that runs again replaces its file whole. ``meta`` has the key fields and the manifest's digest.
    ``change(shard, meta)`` may alter the sidecar, for tests and migrations; None leaves it out.
    """

    def put(table: pa.Table) -> pa.Table:
        place, root = _place(folder)
        name = table["shard"][0].as_py()
        table = table.sort_by(order)
        tokens = {t: np.array(table[t].to_pylist(), storage).reshape(table.num_rows, -1) for t in TOKEN_TYPES}
        arrays = {"image_id": np.array(table["image_id"].to_pylist(), str), "sha256": np.array(table["sha256"].to_pylist(), str), **tokens}
        side = {**meta, "cache_key": key_of(meta), "n_images": table.num_rows, "storage_dtype": storage, "token_types": list(TOKEN_TYPES), "shapes": {t: list(x.shape) for t, x in tokens.items()}}
        side = side if change is None else change(name, side)
        place.create_dir(root, recursive=True)
        path, attempt = f"{root}/{name}{SUFFIX}", f"{root}/_{name}-{uuid.uuid4().hex}"
        whole = io.BytesIO()
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED) as z:
            for k, x in arrays.items():
                member = io.BytesIO()
                np.lib.format.write_array(member, np.ascontiguousarray(x), allow_pickle=False)
                z.writestr(zipfile.ZipInfo(f"{k}.npy"), member.getvalue())
        parts = [(path, whole.getvalue())] + ([] if side is None else [(sidecar_of(path), json.dumps(side).encode())])
        for target, data in parts:
            with place.open_output_stream(f"{attempt}.part") as f:
                f.write(data)
            place.move(f"{attempt}.part", target)
        return pa.table({"path": [f"{folder}/{name}{SUFFIX}"], "n_images": pa.array([table.num_rows], pa.int64())})

    return rows.select(F.col(shard).cast("string").alias("shard"), *COLUMNS).groupBy("shard").applyInArrow(put, "path string, n_images bigint")


ARRAY = "map<string,struct<dtype:string,shape:array<int>>>"
METADATA = "path string, present boolean, " + ", ".join(f"{k} {'int' if k == 'resolution' else 'string'}" for k in KEY_FIELDS) + f", cache_key string, manifest_sha256 string, n_images int, storage_dtype string, shapes map<string,array<int>>, arrays {ARRAY}"


def archive_metadata(paths: DataFrame) -> DataFrame:
    """What sidecars and array headers say of the archives at ``path``, in the shape that ``cache_problems`` takes; no array is read."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                place, own = _place(path)
                meta = _meta(place, own)
                arrays = _arrays(Archive(place, own)) if meta is not None else {}
                meta = meta or {}
                row = {"path": path, "present": bool(meta), **{k: meta.get(k) for k in (*KEY_FIELDS, "cache_key", "manifest_sha256", "n_images", "storage_dtype")}}
                row["shapes"] = list((meta.get("shapes") or {}).items())
                row["arrays"] = [(k, {"dtype": t, "shape": s}) for k, (t, s) in arrays.items()]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    shape = pa.list_(pa.int32())
    kinds = {"present": pa.bool_(), "resolution": pa.int32(), "n_images": pa.int32(), "shapes": pa.map_(pa.string(), shape), "arrays": pa.map_(pa.string(), pa.struct([("dtype", pa.string()), ("shape", shape)]))}
    kind = pa.schema([(k, kinds.get(k, pa.string())) for k in ("path", "present", *KEY_FIELDS, "cache_key", "manifest_sha256", "n_images", "storage_dtype", "shapes", "arrays")])
    return paths.select("path").mapInArrow(look, METADATA)


def archive_problems(paths: DataFrame, manifest_sha256: str | None = None) -> DataFrame:
    """``(path, problem)`` of the archives at ``path`` that may not be loaded."""
    return cache_problems(archive_metadata(paths), manifest_sha256)
