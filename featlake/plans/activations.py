"""Queries over sparse activations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from featlake.operators import activations as A
from featlake.plans.registry import query
from featlake.sources import views as V

R = 6
_rounded = lambda *names: [F.round(n, R).alias(n) for n in names]

STATS = f"""WITH {V.ACTS}, feats AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS feature),
st AS (SELECT f.feature, count(a.value) FILTER (a.value > 0::FLOAT) AS c0, count(a.value) FILTER (a.value > 0.01::FLOAT) AS c1, count(a.value) FILTER (a.value > 0.05::FLOAT) AS c2,
 coalesce(sum(CAST(a.value AS DOUBLE)), 0) AS s1, coalesce(sum(CAST(a.value AS DOUBLE) * a.value), 0) AS s2, coalesce(max(CAST(a.value AS DOUBLE)), 0) AS largest
 FROM feats f LEFT JOIN acts a ON a.feature = f.feature GROUP BY f.feature)"""


@query("D05_long_form", f"WITH {V.ACTS} SELECT row_id, feature, round(CAST(value AS DOUBLE), 6) AS value FROM acts")
def long_form(spark, d):
    return V.acts(spark, d).select("row_id", "feature", F.round(F.col("value").cast("double"), R).alias("value"))


@query("A08_fixed_topk_scan", f"WITH {V.ACTS} SELECT row_id, feature, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature) AS r FROM acts) WHERE r <= 8")
def fixed_topk(spark, d):
    fixed = A.to_fixed(V.acts(spark, d), 8)
    return A.from_fixed(fixed).select("row_id", "feature", F.round(F.col("value").cast("double"), R).alias("value"))


@query("C02_positive_filter", f"WITH {V.ACTS} SELECT feature, count(*) AS n FROM acts GROUP BY feature")
def positive(spark, d):
    return V.acts(spark, d).groupBy("feature").agg(F.count("*").alias("n"))


@query("C03_strict_presence", f"WITH {V.ACTS} SELECT row_id, count(*) AS n FROM acts WHERE value > 0.05::FLOAT GROUP BY row_id")
def presence(spark, d):
    return V.acts(spark, d).filter(F.col("value") > F.lit(0.05).cast("float")).groupBy("row_id").agg(F.count("*").alias("n"))


@query("C12_selectivity", f"WITH {V.ACTS} SELECT row_id, round(own, 6) AS own, round(rest, 6) AS rest FROM (SELECT row_id, max(CASE WHEN feature = 7 THEN CAST(value AS DOUBLE) END) AS own, coalesce(max(CASE WHEN feature <> 7 THEN CAST(value AS DOUBLE) END), 0) AS rest FROM acts GROUP BY row_id) WHERE own >= 0.09 AND rest <= 0.3")
def selectivity(spark, d):
    return A.selective(V.acts(spark, d), 7, 0.09, 0.3).select("row_id", *_rounded("own", "rest"))


@query("F01_feature_stats", STATS + " SELECT feature, c0, c1, c2, round(s1, 6) AS s1, round(s2, 6) AS s2, round(largest, 6) AS largest FROM st")
def stats(spark, d):
    return A.feature_stats(V.acts(spark, d), V.features(spark)).select("feature", "c0", "c1", "c2", *_rounded("s1", "s2", "largest"))


@query("F01_row_stats", f"WITH {V.ACTS} SELECT e.vec_id AS row_id, count(a.value) AS l0, round(coalesce(sum(CAST(a.value AS DOUBLE)), 0), 6) AS l1 FROM embeddings e LEFT JOIN acts a ON a.row_id = e.vec_id GROUP BY e.vec_id")
def row_stats(spark, d):
    return A.row_stats(V.acts(spark, d), V.rows(spark, d)).select("row_id", "l0", *_rounded("l1"))


@query("F02_feature_summary", STATS + """, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings) SELECT feature, round(c0 / n, 6) AS rate, round(s1 / n, 6) AS mean, round(sqrt(greatest(0, s2 / n - (s1 / n) * (s1 / n))), 6) AS std,
 round(CASE WHEN c0 > 0 THEN s1 / c0 END, 6) AS positive_mean, round(CASE WHEN c0 > 0 THEN sqrt(greatest(0, s2 / c0 - (s1 / c0) * (s1 / c0))) END, 6) AS positive_std, CAST(c0 = 0 AS INTEGER) AS dead FROM st, n""")
def summary(spark, d):
    stats = A.feature_stats(V.acts(spark, d), V.features(spark))
    n = V.table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    out = A.feature_summary(stats.join(F.broadcast(n)), F.col("n"))  # n is one row
    return out.select("feature", *_rounded("rate", "mean", "std", "positive_mean", "positive_std"), "dead")


@query("F03_describe", """SELECT round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.01), 4) AS p1, round(quantile_cont(c_acctbal, 0.05), 4) AS p5, round(quantile_cont(c_acctbal, 0.25), 4) AS p25,
 round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.75), 4) AS p75, round(quantile_cont(c_acctbal, 0.95), 4) AS p95, round(quantile_cont(c_acctbal, 0.99), 4) AS p99, max(c_acctbal) AS largest FROM customer""")
def describe(spark, d):
    out = A.describe(V.table(spark, d, "customer"), "c_acctbal")
    return out.select(*(F.round(c, 4).alias(c) if c not in ("least", "largest") else F.col(c) for c in out.columns))


@query("F04_histogram", "WITH e AS (SELECT unnest(range(8)) AS bin) SELECT CAST(e.bin AS INTEGER) AS bin, count(c.c_custkey) AS n FROM e LEFT JOIN customer c ON c.c_acctbal >= -1000 + 1500 * e.bin AND (c.c_acctbal < -1000 + 1500 * (e.bin + 1) OR (e.bin = 7 AND c.c_acctbal = 11000)) GROUP BY e.bin")
def histogram(spark, d):
    return A.histogram(V.table(spark, d, "customer"), "c_acctbal", [-1000 + 1500 * i for i in range(9)])


@query("F05_moments", STATS + " SELECT feature, round(s1, 6) AS s1, round(s2, 6) AS s2, c0 AS support FROM st")
def moments(spark, d):
    return A.moments(V.acts(spark, d), V.features(spark)).select("feature", *_rounded("s1", "s2"), "support")


@query("I09_moment_subtraction", f"WITH {V.ACTS}, feats AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS feature) SELECT f.feature, round(coalesce(sum(CAST(a.value AS DOUBLE)), 0), 6) AS s1, round(coalesce(sum(CAST(a.value AS DOUBLE) * a.value), 0), 6) AS s2, count(a.value) AS support FROM feats f LEFT JOIN acts a ON a.feature = f.feature AND a.row_id % 5 <> 0 GROUP BY f.feature")
def subtraction(spark, d):
    a, f = V.acts(spark, d), V.features(spark)
    return A.subtract_moments(A.moments(a, f), A.moments(a.filter("row_id % 5 = 0"), f)).select("feature", *(F.round(F.col(c) + F.lit(0.0), R).alias(c) for c in ("s1", "s2")), "support")


MEDIAN = f"WITH {V.ACTS} SELECT count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 9) AS median FROM acts"


@query("F09_pooled_median", MEDIAN)
def median(spark, d):
    return A.pooled_median(V.acts(spark, d)).select("n", F.round("median", 9).alias("median"))


@query("F09_pooled_median_bracketed", MEDIAN)
def median_bracketed(spark, d):
    return A.pooled_median_bracketed(V.acts(spark, d)).select("n", F.round("median", 9).alias("median"))


@query("F10_counts_above_median", f"WITH {V.ACTS}, m AS (SELECT quantile_cont(CAST(value AS DOUBLE), 0.5) AS m FROM acts) SELECT e.label, a.feature, count(*) AS n FROM acts a JOIN embeddings e ON e.vec_id = a.row_id, m WHERE CAST(a.value AS DOUBLE) > m.m GROUP BY e.label, a.feature")
def above_median(spark, d):
    a = V.acts(spark, d)
    both = a.join(V.rows(spark, d), "row_id").join(F.broadcast(A.pooled_median(a)))  # the median is one row
    return A.counts_above(both, F.col("median"), "label", "feature")


@query("F11_cluster_counts", "WITH c AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS label) SELECT c.label, count(e.vec_id) AS n FROM c LEFT JOIN embeddings e ON e.label = c.label GROUP BY c.label")
def clusters(spark, d):
    counts = V.rows(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return spark.range(12).select(F.col("id").cast("int").alias("label")).join(counts, "label", "left").fillna(0)


@query("G05_rate_rank", STATS + " SELECT feature, c0, CAST(row_number() OVER (ORDER BY c0 DESC, feature) AS INTEGER) AS rank FROM st QUALIFY rank <= 16")
def rate_rank(spark, d):
    s = A.feature_stats(V.acts(spark, d), V.features(spark)).orderBy(F.desc("c0"), "feature").limit(16)
    from pyspark.sql import Window

    return s.select("feature", "c0", F.row_number().over(Window.orderBy(F.desc("c0"), "feature")).alias("rank"))


@query("H01_row_topk", f"WITH {V.ACTS} SELECT row_id, feature, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature) AS INTEGER) AS rank FROM acts) WHERE rank <= 8")
def row_topk(spark, d):
    return A.top_per_row(V.acts(spark, d), 8).select("row_id", "feature", "rank")


@query("H02_batch_topk", f"WITH {V.ACTS} SELECT batch, row_id, feature FROM (SELECT *, row_id // 64 AS batch, row_number() OVER (PARTITION BY row_id // 64 ORDER BY value DESC, row_id, feature) AS r FROM acts) WHERE r <= 4 * 64")
def batch_topk(spark, d):
    return A.top_per_batch(V.acts(spark, d), F.expr("row_id div 64"), 4, 64).select("batch", "row_id", "feature")


@query("G13_rank_in_row", f"WITH {V.ACTS} SELECT row_id, feature, rank FROM (SELECT *, CAST(rank() OVER (PARTITION BY row_id ORDER BY value DESC) AS INTEGER) AS rank FROM acts) WHERE feature = 3")
def encoder_rank(spark, d):
    return A.rank_in_row(V.acts(spark, d)).filter("feature = 3").select("row_id", "feature", "rank")


#: A small model from the table itself: the vectors of ids 0 to 15 as directions, without bias.
ENCODED = """WITH x AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), dots AS (SELECT x.row_id, CAST(e.vec_id AS INTEGER) AS feature, list_inner_product(x.v, CAST(e.embedding AS DOUBLE[])) AS value FROM x JOIN embeddings e ON e.vec_id < 16),
enc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature) AS r FROM dots WHERE value > 0) WHERE r <= 4)"""


def _dictionary(spark, d):
    e = V.table(spark, d, "embeddings").filter("vec_id < 16")
    return e.select(F.col("vec_id").cast("int").alias("feature"), F.col("embedding").alias("enc"), F.col("embedding").alias("dec"))


@query("L01_encode", ENCODED + " SELECT row_id, feature FROM enc")
def encode(spark, d):
    rows = sorted(_dictionary(spark, d).collect())  # 16 rows
    enc = np.array([r["enc"] for r in rows], np.float32).T
    out = A.encode(V.table(spark, d, "embeddings"), "vec_id", "embedding", enc.astype(np.float64), np.zeros(len(enc)), 4)
    return out.select("row_id", "feature")  # values are float32, and round unlike doubles


@query("L01_encode_relational", ENCODED + " SELECT row_id, feature, round(value, 6) AS value FROM enc")
def encode_relational(spark, d):
    out = A.project(V.table(spark, d, "embeddings"), "vec_id", "embedding", F.broadcast(_dictionary(spark, d)), 4)  # 16 rows
    return out.select("row_id", "feature", F.round("value", R).alias("value"))


@query("L02_reconstruct", ENCODED + ", comp AS (SELECT CAST(vec_id AS INTEGER) AS feature, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS w FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t WHERE vec_id < 16) SELECT row_id, comp.i, round(sum(value * w), 5) AS x FROM enc JOIN comp USING (feature) GROUP BY row_id, comp.i")
def reconstruct(spark, d):
    dictionary = F.broadcast(_dictionary(spark, d))  # 16 rows
    coded = A.project(V.table(spark, d, "embeddings"), "vec_id", "embedding", dictionary, 4)
    return A.reconstruct(coded, dictionary).select("row_id", "i", F.round("x", 5).alias("x"))


@query("L03_selected_columns", ENCODED + " SELECT r.vec_id AS row_id, f.feature, round(coalesce(enc.value, 0), 6) AS value FROM embeddings r CROSS JOIN (SELECT unnest([1, 5, 9]) AS feature) f LEFT JOIN enc ON enc.row_id = r.vec_id AND enc.feature = f.feature")
def selected(spark, d):
    coded = A.project(V.table(spark, d, "embeddings"), "vec_id", "embedding", F.broadcast(_dictionary(spark, d)), 4).drop("rank")
    wanted = V.rows(spark, d).select("row_id", F.explode(F.array(F.lit(1), F.lit(5), F.lit(9))).alias("feature"))
    return A.cross_lookup(wanted, coded).select("row_id", "feature", F.round("value", R).alias("value"))


@query("L04_validate_candidates", ENCODED + ", cand AS (SELECT row_id, feature, value + CASE WHEN row_id % 7 = 0 THEN 0.01 ELSE 0 END AS claimed FROM dots WHERE value > 0.1) SELECT c.row_id, c.feature, CAST(abs(c.claimed - d.value) <= 0.0002 AS INTEGER) AS agrees, CAST(e.r IS NOT NULL AS INTEGER) AS survives, CAST(e.r AS INTEGER) AS rank FROM cand c JOIN dots d USING (row_id, feature) LEFT JOIN enc e USING (row_id, feature)")
def validate(spark, d):
    vectors, dictionary = V.table(spark, d, "embeddings"), F.broadcast(_dictionary(spark, d))
    every = A.project(vectors, "vec_id", "embedding", dictionary, 16)
    claims = every.filter("value > 0.1").select("row_id", "feature", (F.col("value") + F.when(F.col("row_id") % 7 == 0, 0.01).otherwise(0.0)).alias("claimed"))
    both = claims.join(every, ["row_id", "feature"])
    return both.select("row_id", "feature", (F.abs(F.col("claimed") - F.col("value")) <= 2e-4).cast("int").alias("agrees"), (F.col("rank") <= 4).cast("int").alias("survives"), F.when(F.col("rank") <= 4, F.col("rank")).alias("rank"))


@query("L23_inactivity", f"WITH {V.ACTS}, feats AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS feature), m AS (SELECT max(vec_id // 64) AS last FROM embeddings) SELECT f.feature, CAST(m.last - coalesce(max(a.row_id // 64), -1) AS BIGINT) AS inactive FROM feats f CROSS JOIN m LEFT JOIN acts a ON a.feature = f.feature AND a.value > 0.3::FLOAT GROUP BY f.feature, m.last")
def inactivity(spark, d):
    last = V.table(spark, d, "embeddings").agg(F.expr("max(vec_id div 64)")).first()[0]
    strong = V.acts(spark, d).filter(F.col("value") > F.lit(0.3).cast("float"))
    return A.last_active(strong, F.expr("row_id div 64"), V.features(spark), last)


@query("E09_cross_lookup", f"WITH {V.ACTS} SELECT e.vec_id AS row_id, f.feature, round(coalesce(CAST(a.value AS DOUBLE), 0), 6) AS value FROM embeddings e CROSS JOIN (SELECT unnest([2, 11]) AS feature) f LEFT JOIN acts a ON a.row_id = e.vec_id AND a.feature = f.feature")
def lookup(spark, d):
    wanted = V.rows(spark, d).select("row_id", F.explode(F.array(F.lit(2), F.lit(11))).alias("feature"))
    return A.cross_lookup(wanted, V.acts(spark, d)).select("row_id", "feature", F.round(F.col("value").cast("double"), R).alias("value"))


@query("E01_acts_labels", f"WITH {V.ACTS} SELECT e.label, a.feature, count(*) AS n FROM acts a JOIN embeddings e ON e.vec_id = a.row_id GROUP BY e.label, a.feature")
def acts_labels(spark, d):
    return V.acts(spark, d).join(V.rows(spark, d), "row_id").groupBy("label", "feature").agg(F.count("*").alias("n"))
