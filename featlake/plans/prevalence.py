"""Queries on rank statistics and densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import prevalence as P
from featlake.plans.registry import query
from featlake.sources import views as V

BASE = "WITH b AS (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS v, CAST(c_nationkey % 3 = 0 AS INTEGER) AS y FROM customer)"
RANKED = BASE + ", r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk, rank() OVER (PARTITION BY seg ORDER BY v) + (count(*) OVER (PARTITION BY seg, v) - 1) / 2.0::DOUBLE AS rs FROM b)"


def base(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("v"), (F.col("c_nationkey") % 3 == 0).cast("int").alias("y"))


@query("G04_average_ranks", RANKED + " SELECT c_custkey, CAST(rs AS DOUBLE) AS rank FROM r")
def ranks(spark, d):
    return P.average_ranks(base(spark, d), "v", ["seg"]).select("c_custkey", "rank")


@query("F21_auc", RANKED + " SELECT seg, CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0, round((sum(rs) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY seg")
def auc(spark, d):
    return P.auc(base(spark, d), "v", "y", ["seg"]).select("seg", "n1", "n0", F.round("auc", 6).alias("auc"))


@query("F22_effect", BASE + ", m AS (SELECT quantile_cont(v, 0.5) FILTER (y = 1) AS s, quantile_cont(v, 0.5) FILTER (y = 0) AS o FROM b) SELECT round(s, 6) AS selected, round(o, 6) AS others, round(s / o, 6) AS ratio FROM m")
def effect(spark, d):
    return P.effect(base(spark, d), "v", "y").select(*(F.round(c, 6).alias(c) for c in ("selected", "others", "ratio")))


CUTS = BASE + ", q AS (SELECT " + ", ".join(f"quantile_cont(v, {i / 10}) AS c{i}" for i in range(1, 10)) + " FROM b), k AS (SELECT b.*, " + " + ".join(f"CAST(v >= c{i} AS INTEGER)" for i in range(1, 10)) + " AS bin FROM b, q)"


@query("F23_decile_curve", CUTS + " SELECT bin, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, CAST(sum(y) AS BIGINT) AS selected, round(sum(y) / count(*), 6) AS rate FROM k GROUP BY bin")
def deciles(spark, d):
    c = P.curve(P.quantile_bins(base(spark, d), "v", 10), "v", "y")
    return c.select("bin", "n", F.round("median", 6).alias("median"), "selected", F.round("rate", 6).alias("rate"))


@query("F24_conditional_auc", CUTS + ", r AS (SELECT *, rank() OVER (PARTITION BY bin ORDER BY c_custkey) AS rk FROM k), a AS (SELECT bin, sum(y) AS n1, sum(1 - y) AS n0, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY bin HAVING sum(y) > 0 AND sum(1 - y) > 0) SELECT round(sum(auc * n1 * n0) / sum(n1 * n0), 6) AS auc FROM a")
def conditional(spark, d):
    return P.conditional_auc(P.quantile_bins(base(spark, d), "v", 10), "c_custkey", "y").select(F.round("auc", 6).alias("auc"))


@query("F25_matched_pairs", "WITH r AS (SELECT feature, label, avg(CAST(value > 0.1::FLOAT AS INTEGER)) AS rate FROM (" + "WITH " + V.COMPONENTS + " SELECT c.feature, e.label, c.value FROM comp c JOIN embeddings e ON e.vec_id = c.row_id WHERE e.label < 2) GROUP BY ALL) SELECT round(quantile_cont(a.rate, 0.5), 6) AS median_a, round(quantile_cont(b.rate, 0.5), 6) AS median_b, round(quantile_cont(least(a.rate, b.rate), 0.5), 6) AS median_least, count(*) FILTER (a.rate > 0 AND b.rate > 0) AS both FROM r a JOIN r b ON a.feature = b.feature AND a.label = 0 AND b.label = 1")
def matched(spark, d):
    rows = V.rows(spark, d).filter("label < 2")
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    hits = V.acts(spark, d).filter(F.col("value") > F.lit(0.1).cast("float")).join(rows, "row_id").groupBy("feature", "label").agg(F.count("*").alias("c"))
    r = V.features(spark).join(n).join(hits, ["feature", "label"], "left").select("feature", "label", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("rate"))  # features times two labels
    p = r.groupBy("feature").agg(F.max(F.when(F.col("label") == 0, F.col("rate"))).alias("a"), F.max(F.when(F.col("label") == 1, F.col("rate"))).alias("b"))
    m = lambda c: F.round(F.percentile(c, 0.5), 6)
    return p.agg(m(F.col("a")).alias("median_a"), m(F.col("b")).alias("median_b"), m(F.least("a", "b")).alias("median_least"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both"))


@query("J31_log_density", "WITH v AS (SELECT log10(CAST(n_chars AS DOUBLE) / 1000000) AS v FROM documents WHERE n_chars > 0), g AS (SELECT CAST(i AS INTEGER) AS i, -6 + i * (6.0::DOUBLE / 99) AS x FROM (SELECT unnest(range(100)) AS i)) SELECT g.i, round(sum(exp(-0.5 * ((x - v) / 0.12) * ((x - v) / 0.12))) / (0.12 * sqrt(2 * pi())), 5) AS density FROM g, v GROUP BY g.i, g.x")
def density(spark, d):
    v = V.table(spark, d, "documents").select((F.col("n_chars") / 1000000).alias("rate"))
    return P.log_density(v, "rate", points=100).select("i", F.round("density", 5).alias("density"))


@query("J18_histogram_percentile", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 5000 THEN 0.6 + least(1, (c_acctbal - 5000) / 5000) * 0.4 WHEN c_acctbal >= 0 THEN 0.1 + least(1, c_acctbal / 5000) * 0.5 WHEN c_acctbal >= -1000 THEN least(1, (c_acctbal + 1000) / 1000) * 0.1 ELSE 0 END, 9) AS share FROM customer")
def histogram_percentile(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", F.round(P.histogram_percentile(F.col("c_acctbal"), [-1000, 0, 5000, 10000], [10, 50, 40]), 9).alias("share"))


@query("F30_scalar_audit", "SELECT l_linestatus AS status, round(min(r), 6) AS least, round(max(r), 6) AS largest, round(median(r), 6) AS median, CAST(abs(max(r) - 1) <= 1.5 AS INTEGER) AS expected FROM (SELECT l_linestatus, l_linenumber, sum(l_tax) / sum(l_discount) AS r FROM lineitem GROUP BY ALL) GROUP BY l_linestatus")
def audit(spark, d):
    r = V.table(spark, d, "lineitem").groupBy("l_linestatus", "l_linenumber").agg((F.sum("l_tax") / F.sum("l_discount")).alias("r"))
    return r.groupBy(F.col("l_linestatus").alias("status")).agg(F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("largest"), F.round(F.median("r"), 6).alias("median"), (F.abs(F.max("r") - 1) <= 1.5).cast("int").alias("expected"))
