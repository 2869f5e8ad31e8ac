"""Models over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.vectors import argmax, as_double, mixture, softmax
from strataforge.operators import abstain, knn, metrics, ml
from strataforge.plans import query
from strataforge.plans.tables import KNOWN, SCORED, TEMPERATURE, bank, scored, table
from strataforge.session import staged


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id % 10 >= 7")
    return e.select("vec_id", F.col("label").alias("y"), as_double(F.col("embedding")).alias("v"))


@query()
def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    return knn.mahalanobis(_rows(spark, d), knn.fit_gaussians(bank(spark, d), "label", "v"), "vec_id", "v")


@query()
def temperature(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d, knn=False).where((F.col("part") == "val") & (F.col("y") < KNOWN)).select("z", "y")
    out = abstain.fit_temperature(staged(rows, "logits"), "z", "y")
    return spark.createDataFrame([out], "t double, nll_before double, nll_after double")


@query(f"""with {SCORED} select vec_id, round(list_max(m), 6) as best from (select vec_id, list_transform(p, lambda t: ln(0.75 * t + 0.25 / {KNOWN})) as m from scored)""")
def mix_head(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of the demo head and an even one, as log probabilities."""
    even = F.transform("p", lambda x: F.lit(1.0 / KNOWN))
    return scored(spark, d, knn=False).select("vec_id", F.round(F.array_max(mixture(F.col("p"), even, 0.75)), 6).alias("best"))


@query()
def linear_head(spark: SparkSession, d: str) -> DataFrame:
    model = ml.logistic(bank(spark, d), "label", "v")
    out = ml.apply_logistic(model, _rows(spark, d), "v")
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("y")).cast("double")).alias("recall"))


@query()
def proto_head(spark: SparkSession, d: str) -> DataFrame:
    centres = ml.prototypes(bank(spark, d), "label", "v", 2, 0)
    rows = staged(_rows(spark, d).select("vec_id", "y", ml.prototype_logits(F.col("v"), centres, TEMPERATURE).alias("z")), "prototype-logits")
    return rows.select("vec_id", "y", argmax(F.col("z")).alias("pred"), F.array_max(softmax(F.col("z"))).alias("top"))


@query()
def focal_heads(spark: SparkSession, d: str) -> DataFrame:
    grid = [{"rate": 0.02, "decay": 1e-4, "gamma": g, "smoothing": 0.05, "epochs": 5, "seed": s} for g in (0.0, 2.0) for s in (0, 1)]
    return ml.train_heads(bank(spark, d), "label", "v", grid).select("config", F.size("weights").alias("n_weights"))


@query()
def site_probe(spark: SparkSession, d: str) -> DataFrame:
    """Which half of the ids a vector comes from: a probe with cell weights, by balanced accuracy."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).cast("int").alias("site"), as_double(F.col("embedding")).alias("v"))
    weights = metrics.cell_weights(rows, "site", "label").select("site", "label", "weight")
    train = rows.where("vec_id % 10 < 7").join(F.broadcast(weights), ["site", "label"])
    out = ml.apply_logistic(ml.logistic(train, "site", "v", "weight", standardise=True), rows.where("vec_id % 10 >= 7"), "v")
    return metrics.balanced_accuracy(out, "site", "label", F.col("pred") == F.col("site"))


@query("""with b as (select doc_id as id, lang as l from documents where lang is not null), c as (select l, count(*) as n, row_number() over (order by l) as k from b group by l), m as (select count(*) as kk from c),
d as (select l, n, unnest(range(1, 1 + 1000 // kk + case when k <= 1000 % kk then 1 else 0 end)) as j from c, m),
p as (select l, cast('0x' || substring(md5('3:' || l || ':' || cast(j as varchar)), 1, 15) as bigint) % n + 1 as place, count(*) as times from d group by 1, 2),
r as (select *, row_number() over (partition by l order by id) as place from b) select id, times from r join p using (l, place)""")
def balanced_draw(spark: SparkSession, d: str) -> DataFrame:
    return ml.balanced_draw(table(spark, d, "documents").select("doc_id", "lang"), "lang", 1000, 3, "doc_id")
