"""Sinks: tables that are appended to by identity, frozen, or rewritten only when they change."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators.dedupe import append_new
from strataforge.operators.validate import in_order, violations
from strataforge.schemas import LEDGER, REQUESTS, STAMP, STEPS


def table_digest(rows: DataFrame) -> str:
    """A digest of a table's rows whatever their order: sums of two row hashes, and the count. Null and missing values differ."""
    text = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    h = F.sha2(text, 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(20,0)"))
    return "-".join(str(x) for x in rows.agg(F.count(F.lit(1)), part(1), part(13), part(25)).first())


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_results(rows: DataFrame, path: str, identity: list[str], rules: list, order: list[Column], row_no: str) -> int:
    """Appends rows with new identities; one invalid row and nothing is written (S19). Gives the number written."""
    broken = violations(rows, rules, row_no).orderBy(row_no).first()
    if broken is not None:
        raise ValueError(f"{broken['reason']}: {broken['message']} in row {broken[row_no]}")
    spark = rows.sparkSession
    held = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], rows.schema)
    new = append_new(held, rows, identity, order).select(*rows.columns)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


class ConcurrentWrite(Exception):
    """Another writer has published the next version meanwhile."""


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Log entries of a published table by version; an entry without content is not published."""
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    files = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(log) if files.exists(log) else []
    return {int(f.getPath().getName()): f.getPath().toString() if f.getLen() else "" for f in found}


def publish(rows: DataFrame, path: str, expected: int | None = None) -> int:
    """Publishes ``rows`` as the next version of the table at ``path`` and gives its number.

    The rows are written to a folder of their own; then a small file, named by the version's number, is created in the table's log and says which folder it is. A
    reader takes the highest number that says so: it sees the old rows or the new ones, whatever fails between, and never a gap. A file is created only
    if it is not there, so of two writers one gets the number; the other, or one that finds another last version than
    ``expected``, publishes nothing and raises ``ConcurrentWrite``. A folder that was written but not published is seen by no one.
    """
    spark = rows.sparkSession
    last = max(_versions(spark, path), default=0)
    if expected is not None and expected != last:
        raise ConcurrentWrite(f"{path}: version {last} is there, not {expected}")
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    entry = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{last + 1:012d}")
    files = entry.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = files.create(entry, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise ConcurrentWrite(f"{path}: version {last + 1} was taken by another writer") from None
    out.write(bytearray(folder.encode()))
    out.close()
    return last + 1


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the last version, or of the one that is named."""
    found = {k: entry for k, entry in _versions(spark, path).items() if entry}
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"{path}: no version {'' if version is None else version}".rstrip())
    entry = spark.read.text(found[max(found) if version is None else version]).first()[0]
    return spark.read.parquet(f"{path}/{entry}")


def write_if_changed(rows: DataFrame, path: str, volatile: tuple[str, ...] = ()) -> bool:
    """Publishes a table's next version only if its rows, without volatile columns, differ from the last one's."""
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in volatile]
    found = _versions(spark, path)
    last = max(found, default=0)
    if any(found.values()) and table_digest(read_published(spark, path).select(*kept)) == table_digest(rows.select(*kept)):
        return False
    publish(rows, path, last)
    return True


def freeze(frozen: DataFrame, manifest: str, digest: str, n_violations: int, unknown_licences: int) -> str:
    """What freezing a table comes to (G07, F02): ``refused``, ``same``, ``conflict`` or ``new``. The first record of a name wins."""
    if unknown_licences or n_violations:
        return "refused"
    held = frozen.where(F.col("manifest") == manifest).agg(F.min_by("sha256", "frozen_at").alias("d")).first()["d"]
    return "new" if held is None else "same" if held == digest else "conflict"


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(name, action)`` that turn one set of files into another: keep, replace, add, delete."""
    a, b = old.select("name", F.col("digest").alias("was")), new.select("name", F.col("digest").alias("now"))
    both = a.join(b, "name", "full_outer")
    return both.select("name", F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "delete").when(F.col("was") == F.col("now"), "keep").otherwise("replace").alias("action"))


def markdown(rows: DataFrame, columns: list[str], order: list[Column], limit: int = 10_000) -> str:
    """A small table as Markdown (S21); tables of more than ``limit`` rows are refused."""
    table = rows.select(*columns).orderBy(*order).limit(limit + 1).collect()
    if len(table) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in table)]) + "\n"


def log_once(table: DataFrame, run: DataFrame, tag: str) -> DataFrame:
    """Rows of ``run`` whose tag is not in the tracking table yet."""
    return run.join(table.select(tag).distinct(), tag, "left_anti")


def ledger_rules() -> list[tuple[str, str, Column]]:
    """Rules of a ledger row: a stamp, a known step, and no negative or endless time or count."""
    seconds = F.col("wallclock_s")
    return [
        ("bad_value", "ts", F.col("ts").rlike(STAMP)),
        ("bad_value", "step", F.col("step").isin(*STEPS)),
        ("bad_value", "wallclock_s", seconds.isNull() | ((seconds >= 0) & (seconds < float("inf")))),
        ("bad_value", "n_items", F.col("n_items").isNull() | (F.col("n_items") >= 0)),
    ]


def append_ledger(rows: DataFrame, path: str) -> None:
    """Appends rows to the ledger, its fields in order; one invalid row and nothing is written (S20). Equal rows are all kept."""
    rows = in_order(rows, LEDGER)
    broken = violations(rows.withColumn("__row", F.to_json(F.struct("*"))), ledger_rules(), "__row").first()
    if broken is not None:
        raise ValueError(f"{broken['reason']}: {broken['message']} in {broken['__row']}")
    rows.write.mode("append").parquet(path)


def append_requests(rows: DataFrame, path: str, batch: int) -> str | None:
    """Logs the requests of a batch below ``path``; a failure is told as a warning, so that answers are given all the same.

    A batch has a folder of its own, so one that runs again replaces what it wrote before.
    """
    try:
        in_order(rows, REQUESTS).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    except PySparkException as e:
        return f"request log not written: {str(e).splitlines()[0]}"
    except Py4JJavaError as e:  # of the file system
        return f"request log not written: {e.java_exception.getMessage()}"
    return None
