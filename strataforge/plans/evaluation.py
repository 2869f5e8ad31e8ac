"""Scores, thresholds and metrics of the class-mean head over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.vectors import argmax, entropy
from strataforge.operators import abstain, metrics
from strataforge.plans import query
from strataforge.plans.tables import KNOWN, SCORED, scored, table



def _known():
    return F.col("y") < KNOWN


def _right():
    return F.col("pred") == F.col("y")


_TAU = f"""tau as (select round(quantile_cont(conf, 0.1), 6) as tau_conf, round(quantile_cont(knn, 0.95), 6) as tau_knn from scored where part = 'val' and y < {KNOWN})"""


def _thresholds(rows: DataFrame, coverages: list[float]) -> DataFrame:
    return abstain.thresholds(rows.where((F.col("part") == "val") & _known()), coverages)


@query(f"""with {SCORED}, {_TAU} select cast(y as integer) as y, count(*) as n, round(avg(case when pred = y then 1.0 else 0.0 end), 6) as recall,
 round(avg(case when conf < tau_conf or knn > tau_knn then 1.0 else 0.0 end), 6) as abstention_rate from scored, tau where part = 'test' group by y""")
def slice_abstain_recall(spark: SparkSession, d: str) -> DataFrame:
    """The whole slice: features, scores, thresholds, decisions, and recall and abstention by class."""
    rows = scored(spark, d)
    tau = _thresholds(rows, [0.9]).first()
    why = abstain.reason(F.col("conf"), F.col("knn"), F.lit(tau["tau_conf"]), F.lit(tau["tau_knn"]))
    return rows.where("part = 'test'").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(_right().cast("double")), 6).alias("recall"), F.round(F.avg(why.isNotNull().cast("double")), 6).alias("abstention_rate"))


@query(f"""with {SCORED}, c as (select unnest(range(0, {KNOWN})) as k), t as (select * from scored where part = 'test' and y < {KNOWN}),
f as (select k, (select count(*) from t where y = k and pred = k) as tp, (select count(*) from t where y <> k and pred = k) as fp, (select count(*) from t where y = k and pred <> k) as fn from c)
select round(avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end), 6) as macro_f1, cast(sum(tp + fn) as bigint) as n from f""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d, knn=False).where("part = 'test'").where(_known())
    return metrics.macro_f1(rows, list(range(KNOWN))).select(F.round("macro_f1", 6).alias("macro_f1"), "n")


@query(f"""with {SCORED} select cast(y as integer) as y, count(*) as n, round(avg(case when pred = y then 1.0 else 0.0 end), 6) as recall from scored where y < {KNOWN} group by y""")
def recall_by_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall_by_class(scored(spark, d, knn=False).where(_known())).withColumn("recall", F.round("recall", 6))


@query(f"""with {SCORED} select cast(y as integer) as y, cast(pred as integer) as pred, count(*) as n from scored group by 1, 2""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scored(spark, d, knn=False))


@query(f"""with {SCORED}, cell as (select part, y, avg(case when pred = y then 1.0 else 0.0 end) as r from scored where y < {KNOWN} group by 1, 2)
select round(avg(r), 6) as balanced_accuracy from (select avg(r) as r from cell group by part)""")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d, knn=False).where(_known())
    return metrics.balanced_accuracy(rows, "part", "y", _right()).select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(f"""with {SCORED}, s as (select 'conf' as score, -conf as v, y >= {KNOWN} as pos from scored where part = 'test' union all select 'knn', knn, y >= {KNOWN} from scored where part = 'test' union all select 'energy', energy, y >= {KNOWN} from scored where part = 'test'),
r as (select *, rank() over (partition by score order by v) + (count(*) over (partition by score, v) - 1) / 2.0 as rk from s)
select score, round((sum(case when pos then rk end) - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) as auroc, n_pos, n_neg
from (select *, count(*) filter (where pos) over (partition by score) as n_pos, count(*) filter (where not pos) over (partition by score) as n_neg from r) group by score, n_pos, n_neg""")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("part = 'test'")
    scores = F.explode(F.array(*[F.struct(F.lit(k).alias("score"), v.alias("v")) for k, v in (("conf", -F.col("conf")), ("knn", F.col("knn")), ("energy", F.col("energy")))]))
    long = rows.select("y", scores.alias("s")).select("y", "s.score", "s.v")
    return metrics.auroc(long, ~_known(), F.col("v"), ["score"]).withColumn("auroc", F.round("auroc", 6))


@query("""with s as (select l_returnflag as grp, l_quantity as v, l_discount > 0.05 as pos from lineitem),
r as (select *, rank() over (partition by grp order by v) + (count(*) over (partition by grp, v) - 1) / 2.0 as rk from s)
select grp, round((sum(case when pos then rk end) - n_pos * (n_pos + 1) / 2.0) / (cast(n_pos as double) * n_neg), 6) as auroc, n_pos, n_neg
from (select *, count(*) filter (where pos) over (partition by grp) as n_pos, count(*) filter (where not pos) over (partition by grp) as n_neg from r) group by grp, n_pos, n_neg""")
def auroc_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity", "l_discount")
    return metrics.auroc(rows, F.col("l_discount") > 0.05, F.col("l_quantity"), ["grp"]).withColumn("auroc", F.round("auroc", 6))


@query(f"""with {SCORED}, c as (select list_max(p) as conf, case when pred = y then 1.0 else 0.0 end as ok from scored where y < {KNOWN}),
b as (select len(list_filter(list_transform(range(1, 15), lambda i: i / 15.0::double), lambda e: conf > e)) as bin, conf, ok from c)
select round(sum(n * abs(acc - conf)) / sum(n), 6) as ece, cast(sum(n) as bigint) as n from (select bin, count(*) as n, avg(ok) as acc, avg(conf) as conf from b group by bin)""")
def ece(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d, knn=False).where(_known()).withColumn("top", F.array_max("p"))
    return metrics.ece(rows, "top", _right()).select(F.round("ece", 6).alias("ece"), "n")


_COVERAGES = (0.8, 0.9, 0.95, 1.0)


@query(f"""with {SCORED}, v as (select * from scored where part = 'val' and y < {KNOWN}), q as (select quantile_cont(knn, 0.95) as knn from v),
c as (select unnest([0.8, 0.9, 0.95, 1.0]::double[]) as coverage), t as (select coverage, (select quantile_cont(conf, 1 - coverage) from v) as conf from c)
select coverage, round(any_value(t.conf), 6) as tau_conf, round(any_value(q.knn), 6) as tau_knn, round(avg(case when v.conf >= t.conf and v.knn <= q.knn then 1.0 else 0.0 end), 6) as coverage_achieved, false as degenerate from t, q, v group by coverage""".replace(
    "(select quantile_cont(conf, 1 - coverage) from v)",
    "case coverage " + " ".join(f"when {c} then (select quantile_cont(conf, {1 - c!r}) from v)" for c in _COVERAGES) + " end",
))
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _thresholds(scored(spark, d), list(_COVERAGES))


@query(f"""with {SCORED}, v as (select * from scored where part = 'val' and y < {KNOWN}), q as (select round(quantile_cont(knn, 0.95), 6) as tau_knn from v),
t as ({" union all ".join(f"select {c}::double as coverage, (select round(quantile_cont(conf, {1 - c!r}), 6) from v) as tau_conf" for c in _COVERAGES)})
select coverage, count(*) as n, cast(sum(case when ok then 1 else 0 end) as bigint) as n_accepted, round(avg(case when ok then case when pred <> y then 1.0 else 0.0 end end), 6) as selective_risk, round(avg(case when ok then 0.0 else 1.0 end), 6) as abstention_rate
from (select coverage, pred, y, not (conf < tau_conf or knn > tau_knn) as ok from scored, t, q where part = 'test' and y < {KNOWN}) group by coverage""")
def selective_risk_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    taus = _thresholds(rows, list(_COVERAGES)).collect()
    each = F.explode(F.array(*[F.struct(F.lit(t["coverage"]).alias("coverage"), F.lit(t["tau_conf"]).alias("tau_conf"), F.lit(t["tau_knn"]).alias("tau_knn")) for t in taus]))
    wide = rows.where("part = 'test'").where(_known()).select("y", "pred", "conf", "knn", each.alias("t")).select("*", "t.*")
    ok = abstain.reason(F.col("conf"), F.col("knn"), F.col("tau_conf"), F.col("tau_knn")).isNull()
    out = metrics.selective(wide, ok, _right(), ["coverage"])
    return out.withColumns({k: F.round(k, 6) for k in ("selective_risk", "abstention_rate")})


@query(f"""with {SCORED}, {_TAU} select cast(y as integer) as y, coalesce(case when conf < tau_conf then 'low_confidence' when knn > tau_knn then 'far_from_training' end, 'predict') as decision, count(*) as n from scored, tau where part = 'test' group by 1, 2""")
def abstain_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    tau = _thresholds(rows, [0.9]).first()
    why = abstain.reason(F.col("conf"), F.col("knn"), F.lit(tau["tau_conf"]), F.lit(tau["tau_knn"]))
    return rows.where("part = 'test'").groupBy("y", F.coalesce(why, F.lit("predict")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SCORED}, {_TAU} select round(avg(case when conf < tau_conf or knn > tau_knn then 1.0 else 0.0 end), 6) as unknown_recall, count(*) as n from scored, tau where part = 'test' and y >= {KNOWN}""")
def unknown_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    tau = _thresholds(rows, [0.9]).first()
    why = abstain.reason(F.col("conf"), F.col("knn"), F.lit(tau["tau_conf"]), F.lit(tau["tau_knn"]))
    return rows.where("part = 'test'").where(~_known()).agg(F.round(F.avg(why.isNotNull().cast("double")), 6).alias("unknown_recall"), F.count(F.lit(1)).alias("n"))


@query(f"""with {SCORED} select vec_id, cast(list_position(z[2:4], list_max(z[2:4])) as integer) as pred from scored""")
def argmax_subset(spark: SparkSession, d: str) -> DataFrame:
    """The decision among the classes 1 to 3 alone; the first of equal ones."""
    return scored(spark, d, knn=False).select("vec_id", (argmax(F.slice("z", 2, 3)) + 1).alias("pred"))


@query(f"""with {SCORED} select vec_id, round(knn, 6) as knn from scored""")
def knn_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("vec_id", F.round("knn", 6).alias("knn"))


@query(f"""with {SCORED} select vec_id, round(list_max(p), 6) as max_prob, round(-list_sum(list_transform(p, lambda t: t * ln(greatest(t, 1e-12)))), 6) as entropy, round(energy, 6) as energy from scored""")
def uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, knn=False).select("vec_id", F.round(F.array_max("p"), 6).alias("max_prob"), F.round(entropy(F.col("p")), 6).alias("entropy"), F.round("energy", 6).alias("energy"))


@query(f"""with {SCORED} select round(avg(l), 6) as loss from (select avg(-ln(p[y + 1])) as l from scored where y < {KNOWN} group by y)""")
def class_averaged_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d, knn=False).where(_known()).withColumn("loss", -F.log(F.element_at("p", F.col("y") + 1)))
    return metrics.class_averaged_loss(rows, "y", "loss").select(F.round("loss", 6).alias("loss"))


@query("""with c as (select source, lang, count(*) as n from documents group by 1, 2), k as (select *, count(*) over (partition by source) as classes from c), w as (select *, 1.0 / (n * classes) as w from k)
select source, lang, n, round(w * (select sum(n) from w) / (select sum(w * n) from w), 6) as weight from w""")
def cell_weights(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cell_weights(table(spark, d, "documents").select("source", "lang"), "source", "lang").withColumn("weight", F.round("weight", 6))


@query(f"""with {SCORED}, cell as (select part, y, count(*) as n, count(*) filter (where pred = y) as ok from scored where y < {KNOWN} group by 1, 2),
ends as (select *, case when ok = 0 or ok = n then ok else greatest(0, floor(ok - 12.0 * sqrt(ok * (1 - ok / n)) - 12)) end as lo, case when ok = 0 or ok = n then ok else least(n, ceil(ok + 12.0 * sqrt(ok * (1 - ok / n)) + 12)) end as hi from cell),
ks as (select *, unnest(range(cast(lo as bigint), cast(hi as bigint) + 1)) as k from ends),
logs as (select *, sum(case when k > lo then ln((n - k + 1) * ok / (k * (n - ok))) else 0.0 end) over (partition by part, y order by k rows unbounded preceding) as l from ks),
mass as (select *, exp(l - max(l) over (partition by part, y)) as m from logs),
cdf as (select part, y, k, case when k = hi then 1.0 else sum(m) over (partition by part, y order by k rows unbounded preceding) / sum(m) over (partition by part, y) end as below from mass),
u as (select part, y, n, draw, cast('0x' || substr(md5('0:' || draw || ':' || part || ':' || y), 1, 13) as bigint) / 4503599627370496.0 as at from cell, range(1, 1001) as t(draw)),
drawn as (select u.part, u.y, u.draw, min(cdf.k) / any_value(u.n) as r from u join cdf on u.part = cdf.part and u.y = cdf.y and cdf.below >= u.at group by 1, 2, 3),
by_draw as (select draw, avg(r) as r from (select draw, part, avg(r) as r from drawn group by 1, 2) group by 1)
select round((select avg(r) from (select avg(ok / n) as r from cell group by part)), 6) as value, round(quantile_cont(r, 0.025), 6) as ci_low, round(quantile_cont(r, 0.975), 6) as ci_high from by_draw""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d, knn=False).where(_known())
    return metrics.bootstrap(rows, "part", "y", _right(), 0).select(*[F.round(c, 6).alias(c) for c in ("value", "ci_low", "ci_high")])


@query("""select event_type, count(*) as n, round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.withColumns({k: F.round(k, 6) for k in ("p05", "p50", "p95")})


@query("""select event_type, max(value) - min(value) <= 1e-9 as degenerate from events group by 1""")
def degenerate_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(((F.max("value") - F.min("value")) <= abstain.FLAT).alias("degenerate"))
