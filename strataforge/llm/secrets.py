"""Operator 1: secret scans with an incremental blob ledger, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.joins import without
from strataforge.session import fresh_path, staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, the least length, and a version.

    A change to a rule must change its version; only then are blobs that were
    scanned before scanned again with it.
    """

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Matches that one inner fold takes; texts with many matches stay far from quadratic work.
FOLD = 256

FINDINGS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """All leftmost, non-overlapping matches of a rule, as spans in code points.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the lengths
    of the pieces between matches and of the matches give every position.
    """
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(found)), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("len"),
        F.transform(kept, lambda x: F.length(x)).alias("own"),
    )
    none = F.array().cast(FINDINGS)

    def one(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["len"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(
            (start + x["len"]).alias("at"),
            F.when(x["own"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    def block(state: Column, x: Column) -> Column:
        inner = F.aggregate(x, F.struct(state["at"].alias("at"), none.alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], inner["out"]).alias("out"))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / F.lit(FOLD)).cast("int")),
        lambda i: F.slice(steps, i * FOLD + 1, F.lit(FOLD)),
    )
    folded = F.aggregate(blocks, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), block)["out"]
    return F.when(text.rlike(rule.pattern), folded).otherwise(none)


def scan_secrets(
    docs: DataFrame,
    ledger: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES,
    salts: int = 16,
) -> DataFrame:
    """Findings of every row (path or version) of ``docs``, through the ledger at ``ledger``.

    1. Every text is addressed by its SHA-256 (null counts as empty).
    2. One row id per blob is chosen by an aggregation over (address, id), and
       blobs that the ledger has for all rule versions are left out.
    3. Only the chosen rows' texts are shuffled, and scanned with the rules
       that the blob lacks; what was found, nothing included, is appended to the ledger.
    4. Findings are joined back to all rows by address. Copies may be most of
       the rows, so addresses are salted there.

    The ledger is a Parquet table (blob, rules array<string>, findings); a
    rule's findings count only while its version is asked for. ``ledger``
    None scans into a new ledger in the shared folder. Returns
    ``(id, blob_id, findings)``, one row for each row of ``docs``; findings are ordered
    by start, then by the order of the rules. Rows with a null id are kept; extra
    columns, whatever their names, are ignored; repeated rows are each returned; texts are scanned whole, however
    long; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    tags = [r.tag for r in rules]
    text = F.coalesce(F.col(text_col), F.lit(""))
    address = F.unhex(F.sha2(text, 256))
    named = docs.select(F.col(id_col).alias("__id"), address.alias("blob_id"))
    # the row that stands for a blob: the null id only where there is no other
    chosen = named.groupBy("blob_id").agg(F.min("__id").alias("__id"))

    seen = read_ledger(spark, ledger)
    every = F.array(*[F.lit(t) for t in tags])
    if seen is not None:
        done = seen.groupBy("blob_id").agg(F.flatten(F.collect_set("rules")).alias("rules"))
        chosen = chosen.join(done, "blob_id", "left").withColumn("todo", F.array_except(every, F.coalesce("rules", F.array().cast("array<string>")))).drop("rules").where(F.size("todo") > 0)
    else:
        chosen = chosen.withColumn("todo", every)

    body = docs.select(F.col(id_col).alias("__doc"), text.alias("__text"))
    pick = chosen.select(F.col("__id"), F.col("blob_id").alias("__blob"), "todo")
    # ids may repeat with other texts, null ones too: the address is part of the key
    blobs = body.join(pick, F.col("__doc").eqNullSafe(F.col("__id")) & (F.unhex(F.sha2(F.col("__text"), 256)) == F.col("__blob")))
    wanted = [F.when(F.array_contains("todo", r.tag), rule_spans(F.col("__text"), r, k)).otherwise(F.array().cast(FINDINGS)) for k, r in enumerate(rules)]
    found = blobs.select(F.col("__blob").alias("blob_id"), F.col("todo").alias("rules"), F.array_sort(F.concat(*wanted)).alias("findings"))
    found.write.mode("append").parquet(ledger)

    current = read_ledger(spark, ledger)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    versions = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.tag))])
    hits = current.where(F.size("findings") > 0).select(
        "blob_id",
        F.filter("findings", lambda x: F.array_contains(F.col("rules"), versions[x["kind"]])).alias("findings"),
    )
    # a blob that was picked twice (repeated rows) or scanned in two versions has several ledger rows
    hits = hits.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    hits = hits.select("blob_id", F.transform("findings", lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("findings"))
    hits = hits.where(F.size("findings") > 0).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    paths = named.withColumn("salt", F.expr(f"cast(pmod(xxhash64(__id), {salts}) as int)"))
    joined = paths.join(hits, ["blob_id", "salt"], "left")
    return joined.select(F.col("__id").alias("id"), F.lower(F.hex("blob_id")).alias("blob_id"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def read_ledger(spark, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"blob_id binary, rules array<string>, findings {FINDINGS}").parquet(path)


def span_list(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """The counts and digests by document that the query returns."""
    base = [r.kind for r in BASE_RULES]
    own = F.filter("findings", lambda x: x["kind"].isin(base))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in base],
        F.sha2(span_list(own), 256).alias("base_sha256"),
        span_list(F.col("findings")).alias("spans"),
    )


def drop_secret_documents(docs: DataFrame) -> DataFrame:
    """Documents without a finding; ``docs`` keeps its columns. Copies of a text share its fate.

    Null and empty texts hold none and stay, whatever their ids; an empty table gives an empty result.
    """
    bad = scan_secrets(docs).where(F.size("findings") > 0).select(F.col("blob_id").alias("__bad")).distinct()
    return without(docs, staged(bad, "secret-blobs"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col("__bad"))
