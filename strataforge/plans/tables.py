"""Driver tables in the shapes that the operators take, and the same shapes in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.scalars import content_id, median_code
from strataforge.functions.vectors import argmax, as_double, dot, literal, logsumexp, softmax
from strataforge.operators.knn import kth_distance
from strataforge.session import staged

#: Neighbour that the distance score looks at, temperature of the demo head, known classes.
NEIGHBOUR, TEMPERATURE, KNOWN = 20, 0.05, 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a manifest: content-addressed rows with a class, a block key and a day."""
    docs = table(spark, d, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    klass = F.when(F.col("lang") == "en", "healthy").when(F.col("lang") == "de", "rust").when(F.col("lang") == "fr", "anthracnose").otherwise("unknown_als")
    return docs.select(
        F.col("doc_id").alias("id"),
        digest.alias("sha256"),
        content_id("doc", digest).alias("image_id"),
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("class_raw"),
        klass.alias("class_km2"),
        "source",
        "n_chars",
    )


MANIFEST = """manifest as (select doc_id as id, sha256(coalesce(text, '')) as sha256, 'doc_' || sha256(coalesce(text, ''))[1:16] as image_id,
  source || '/' || lang || '/' || cast(doc_id as varchar) as path, lang as class_raw,
  case when lang = 'en' then 'healthy' when lang = 'de' then 'rust' when lang = 'fr' then 'anthracnose' else 'unknown_als' end as class_km2, source, n_chars from documents)"""


def codes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return staged(e.select(F.col("vec_id").alias("id"), "label", median_code(as_double(F.col("embedding"))).alias("code")), "codes")


CODES = """codes as (select vec_id as id, label, cast(case when u >= 9223372036854775808 then u - 18446744073709551616 else u end as bigint) as code from (
  select vec_id, label, list_reduce(list_transform(embedding, lambda x: cast(case when cast(x as double) > m then 1 else 0 end as hugeint)), lambda a, b: a * 2 + b) as u
  from (select *, (s[32] + s[33]) / 2 as m from (select *, list_sort(list_transform(embedding, lambda x: cast(x as double))) as s from embeddings))))"""


def near_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of which every third has a near copy of one and of two bits, and every ninth an exact one."""
    rows = codes(spark, d)
    one = lambda k: F.expr(f"shiftleft(1L, cast((id + {k}) % 61 as int))")
    flips = F.when(F.col("id") % 3 == 1, one(0)).when((F.col("id") % 3 == 2) & (F.col("id") % 9 != 2), one(0).bitwiseOR(one(7))).otherwise(F.lit(0).cast("bigint"))
    base = rows.select(F.col("id").alias("base"), F.col("code").alias("base_code"))
    near = rows.join(base, F.col("id") - F.col("id") % 3 == F.col("base"), "left")
    return staged(near.select("id", "label", F.coalesce("base_code", "code").bitwiseXOR(flips).alias("code")), "near-codes")


NEAR = f"""{CODES}, near as (select c.id, c.label, xor(coalesce(b.code, c.code), case when c.id % 3 = 1 then cast(1 as bigint) << (c.id % 61) when c.id % 3 = 2 and c.id % 9 <> 2 then (cast(1 as bigint) << (c.id % 61)) | (cast(1 as bigint) << ((c.id + 7) % 61)) else 0 end) as code
  from codes c left join codes b on b.id = c.id - c.id % 3)"""


def split_part(id_col: Column) -> Column:
    return F.when(id_col % 10 < 7, "train").when(id_col % 10 == 7, "val").otherwise("test")


def bank(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", as_double(F.col("embedding")).alias("v"))
    return e.where((F.col("vec_id") % 10 < 7) & (F.col("label") < KNOWN))


def class_means(train: DataFrame) -> list[list[float]]:
    """Means of each class: classes x components numbers, the parameters of the demo head."""
    rows = train.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("m"))
    return [[x["m"] for x in r["m"]] for r in rows.orderBy("label").collect()]


def scored(spark: SparkSession, d: str, knn: bool = True) -> DataFrame:
    """Validation and test rows of embeddings scored by the class-mean head."""
    train = bank(spark, d)
    means = class_means(train)
    e = table(spark, d, "embeddings").where("vec_id % 10 >= 7").select("vec_id", F.col("label").alias("y"), split_part(F.col("vec_id")).alias("part"), as_double(F.col("embedding")).alias("v"))
    z = F.transform(literal(means), lambda m: dot(F.col("v"), m))
    out = e.withColumn("z", z).withColumn("pred", argmax(F.col("z"))).withColumn("conf", F.array_max("z")).withColumn("energy", -logsumexp(F.col("z"))).withColumn("p", softmax(F.col("z"), TEMPERATURE))
    if not knn:
        return out
    near = kth_distance(e, train, NEIGHBOUR, "vec_id", "v")
    return staged(out.join(near.select(F.col("id").alias("vec_id"), "knn"), "vec_id"), "scored")


SCORED = f"""e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
bank as (select *, sqrt(list_dot_product(v, v)) as size from e where vec_id % 10 < 7 and label < {KNOWN}),
mu as (select label, list(m order by i) as m from (select label, i, avg(v[i]) as m from bank, range(1, 65) r(i) group by 1, 2) group by label),
held as (select vec_id, label as y, case when vec_id % 10 = 7 then 'val' else 'test' end as part, v, sqrt(list_dot_product(v, v)) as size from e where vec_id % 10 >= 7),
logits as (select h.vec_id, list(list_dot_product(h.v, mu.m) order by mu.label) as z from held h, mu group by h.vec_id),
near as (select vec_id, d as knn from (select h.vec_id, sqrt(greatest(2 - 2 * list_dot_product(h.v, b.v) / (h.size * b.size), 0)) as d,
  row_number() over (partition by h.vec_id order by sqrt(greatest(2 - 2 * list_dot_product(h.v, b.v) / (h.size * b.size), 0))) as r from held h, bank b) where r = {NEIGHBOUR}),
scored as (select h.vec_id, h.y, h.part, z, list_max(z) as conf, list_position(z, list_max(z)) - 1 as pred,
  -(list_max(z) + ln(list_sum(list_transform(z, lambda t: exp(t - list_max(z)))))) as energy,
  list_transform(z, lambda t: exp((t - list_max(z)) / {TEMPERATURE}) / list_sum(list_transform(z, lambda s: exp((s - list_max(z)) / {TEMPERATURE})))) as p,
  near.knn from held h join logits using (vec_id) join near using (vec_id))"""
