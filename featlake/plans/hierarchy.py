"""Queries on categories, taxonomies and trajectories.

Trajectories: for each brand (dataset) and each order priority's initial (model), a score along the line number.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featlake.operators import hierarchy as H
from featlake.operators import probes as P
from featlake.plans.registry import query
from featlake.sources import views as V

R6 = lambda *n: [F.round(c, 6).alias(c) for c in n]

#: (mode, status, category, width, score): average discount by supplier over line numbers 1 to 7 with counts.
POINTS = """WITH p AS (SELECT l_returnflag AS dataset, l_linestatus AS model, CAST(l_suppkey % 5 AS VARCHAR) AS category, l_linenumber AS width, count(*) FILTER (l_discount >= 0.05) AS tp, count(*) FILTER (l_tax >= 0.05) AS fp, count(*) AS n,
 2.0::DOUBLE * count(*) FILTER (l_discount >= 0.05) / (count(*) FILTER (l_discount >= 0.05) + count(*) FILTER (l_tax >= 0.05) + count(*)) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, max(score) OVER (PARTITION BY dataset, model, category) - score AS regret FROM p)"""


def points(spark, d):
    li = V.table(spark, d, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model"), (F.col("l_suppkey") % 5).cast("string").alias("category"), F.col("l_linenumber").alias("width"))
    p = g.agg(F.count_if(F.col("l_discount") >= 0.05).alias("tp"), F.count_if(F.col("l_tax") >= 0.05).alias("fp"), F.count("*").alias("n"))
    return p.withColumn("score", 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n")))


KEYS = ["dataset", "model", "category"]


@query("F15_regret", POINTS + " SELECT dataset, model, category, width, round(score, 6) AS score, round(regret, 6) AS regret FROM r")
def regret(spark, d):
    return H.regrets(points(spark, d), KEYS, "score").select(*KEYS, "width", *R6("score", "regret"))


@query("F15_trajectory_check", POINTS + ", w AS (SELECT count(DISTINCT width) AS k FROM p) SELECT dataset, model, category, count(*) AS n, count(DISTINCT width) AS places FROM p, w GROUP BY dataset, model, category, w.k HAVING count(*) <> 8")
def trajectory_check(spark, d):
    return H.check_trajectories(points(spark, d), KEYS, "width", 8)


@query("F16_cell_summary", POINTS + " SELECT dataset, width, count(*) AS n, round(avg(regret), 6) AS mean_regret, round(median(regret), 6) AS median_regret, count(*) FILTER (regret <= 0.01 + 1e-12) AS within, round(avg(score), 6) AS mean_score FROM r GROUP BY dataset, width")
def cell_summary(spark, d):
    c = H.cells(H.regrets(points(spark, d), KEYS, "score"), ["dataset", "width"], 0.01)
    return c.select("dataset", "width", "n", *R6("mean_regret", "median_regret"), "within", *R6("mean_score"))


@query("F17_mean_score", POINTS + " SELECT width, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (abs(score - 2.0::DOUBLE * tp / (tp + fp + n)) > 1e-9) AS inconsistent FROM p GROUP BY width")
def mean_score(spark, d):
    again = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n"))
    return points(spark, d).groupBy("width").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.abs(F.col("score") - again) > 1e-9).alias("inconsistent"))


@query("G11_distinct_places", POINTS + " SELECT dataset, model, category, width, place FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY dataset, model, category ORDER BY round(score, 12) DESC) AS INTEGER) AS place FROM p) WHERE place <= 2")
def places(spark, d):
    return H.marks(points(spark, d), KEYS, "score").filter("place <= 2").select(*KEYS, "width", "place")


@query("G12_trajectory_max", POINTS + " SELECT dataset, model, category, round(max(score), 6) AS best FROM p GROUP BY ALL")
def trajectory_max(spark, d):
    return points(spark, d).groupBy(*KEYS).agg(F.round(F.max("score"), 6).alias("best"))


@query("F18_recovery_rollup", POINTS + " SELECT dataset, width, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n, CAST(sum(CAST(2 * tp * 100 >= 55 * (tp + fp + n) AS INTEGER)) AS BIGINT) AS recovered FROM p GROUP BY GROUPING SETS ((dataset, width, category), (dataset, width))")
def rollup(spark, d):
    ok = P.passes(F.col("tp"), F.col("fp"), F.col("n") - F.col("tp"), 55, 100).cast("long")
    return H.rolled_up(points(spark, d), ["dataset", "width"], "category", {"recovered": ok}).select("dataset", "width", "category", "n", "recovered")


@query("B07_rank_marks", POINTS + " SELECT dataset, width, round(s, 6) AS mean_score, CASE rk WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark FROM (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY round(s, 12) DESC) AS rk FROM (SELECT dataset, width, avg(score) AS s FROM p GROUP BY ALL))")
def rank_marks(spark, d):
    t = points(spark, d).groupBy("dataset", "width").agg(F.avg("score").alias("s"))
    m = H.marks(t, ["dataset"], "s")
    return m.select("dataset", "width", F.round("s", 6).alias("mean_score"), F.when(F.col("place") == 1, "best").when(F.col("place") == 2, "second").otherwise("").alias("mark"))


@query("F12_category_counts", "SELECT level, category, level || ':' || category AS category_id, count(*) AS positive_count FROM (SELECT p_partkey, 'brand' AS level, p_brand AS category FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part) GROUP BY level, category HAVING count(*) >= 20")
def category_counts(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return H.category_targets(p, "p_partkey", ["brand", "type"], 20)[0].select("level", "category", "category_id", "positive_count")


@query("D20_membership", "WITH l AS (SELECT p_partkey AS row_id, 'brand:' || p_brand AS category_id FROM part UNION ALL SELECT p_partkey, 'type:' || p_type FROM part) SELECT category_id, row_id FROM l WHERE category_id IN (SELECT category_id FROM l GROUP BY 1 HAVING count(*) >= 20)")
def membership(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return H.category_targets(p, "p_partkey", ["brand", "type"], 20)[1].select("category_id", F.col("row_id"))


@query("I08_union_levels", "SELECT 'region' AS level, r_name AS category, CAST(r_regionkey AS INTEGER) AS key FROM region UNION ALL SELECT 'nation', n_name, n_nationkey FROM nation")
def union_levels(spark, d):
    r = V.table(spark, d, "region").select(F.lit("region").alias("level"), F.col("r_name").alias("category"), F.col("r_regionkey").alias("key"))
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.lit("nation").alias("level"), F.col("n_name").alias("category"))
    return r.unionByName(n)


PREFIX = "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), l AS (SELECT word, 1 AS size, left(word, 1) AS prefix FROM w UNION ALL SELECT word, 2, left(word, 2) FROM w WHERE length(word) >= 2)"


def words(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


@query("J09_prefix_targets", PREFIX + " SELECT size, prefix, count(*) AS positive_count FROM l GROUP BY size, prefix HAVING count(*) >= 50")
def prefix_targets(spark, d):
    return H.prefix_targets(words(spark, d).select("word", F.col("word").alias("t")), "word", "t", (1, 2), 50)[0]


@query("C09_prefix_predicate", PREFIX + " SELECT prefix, count(*) AS n FROM l WHERE size = 2 AND starts_with(prefix, 'a') GROUP BY prefix")
def prefix_predicate(spark, d):
    return words(spark, d).filter(F.length("word") >= 2).select(F.substr("word", F.lit(1), F.lit(2)).alias("prefix")).filter(F.col("prefix").startswith("a")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("F19_prefix_parent_child", PREFIX + ", c AS (SELECT size, prefix, count(*) AS n, avg(length(word)) AS score FROM l GROUP BY size, prefix) SELECT p.prefix, round(p.score, 6) AS parent, round(avg(c.score), 6) AS mean_child, count(c.prefix) AS children FROM c p LEFT JOIN c ON c.size = 2 AND left(c.prefix, 1) = p.prefix WHERE p.size = 1 GROUP BY p.prefix, p.score")
def prefix_parent_child(spark, d):
    _, m = H.prefix_targets(words(spark, d).select("word", F.col("word").alias("t")), "word", "t", (1, 2), 1)
    c = m.groupBy("size", "prefix", F.substr("prefix", F.lit(1), F.lit(1)).alias("first")).agg(F.avg(F.length("row_id")).alias("score"))
    parent = F.max(F.when(F.col("size") == 1, F.col("score")))
    return c.groupBy(F.col("first").alias("prefix")).agg(F.round(parent, 6).alias("parent"), F.round(F.avg(F.when(F.col("size") == 2, F.col("score"))), 6).alias("mean_child"), F.count_if(F.col("size") == 2).alias("children"))


@query("F13_species_per_category", "SELECT CAST(row_number() OVER (ORDER BY level, category) - 1 AS INTEGER) AS category_index, level, category, n_species FROM (SELECT level, category, count(DISTINCT c_custkey) AS n_species FROM (SELECT c_custkey, 'nation' AS level, n_name AS category FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'region', r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY level, category HAVING count(DISTINCT c_custkey) >= 60)")
def species(spark, d):
    c, n, r = (V.table(spark, d, t) for t in ("customer", "nation", "region"))
    wide = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return H.eligible_categories(wide, "c_custkey", ["nation", "region"], 60).select("category_index", "level", "category", "n_species")


@query("E14_dimension_join", "SELECT s_suppkey, coalesce(r_name, '') AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey <> 3 LEFT JOIN region ON r_regionkey = n_regionkey")
def dimension(spark, d):
    s, n, r = V.table(spark, d, "supplier"), V.table(spark, d, "nation").filter("n_nationkey <> 3"), V.table(spark, d, "region")
    dim = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "r_name")
    return s.join(F.broadcast(dim), s["s_nationkey"] == dim["n_nationkey"], "left").select("s_suppkey", F.coalesce("r_name", F.lit("")).alias("region"))


@query("E10_taxon_membership", "SELECT DISTINCT 'nation:' || n_name AS category_id, s_suppkey AS row_id FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT DISTINCT 'nation:' || n_name, c_custkey + 1000000 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def taxa(spark, d):
    s, c, n = V.table(spark, d, "supplier"), V.table(spark, d, "customer"), V.table(spark, d, "nation")
    names = s.select(F.col("s_suppkey").alias("row_id"), F.lit("common").alias("kind"), F.col("s_name").alias("text")).unionAll(c.select(F.col("c_custkey") + 1000000, F.lit("scientific"), F.col("c_name")))
    a = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.lit("-").alias("scientific"), F.col("s_suppkey").alias("common_row"), F.col("n_name").alias("nation"))
    b = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_name").alias("scientific"), F.lit(-1).cast("long").alias("common_row"), F.col("n_name").alias("nation"))
    wanted = n.select(F.concat(F.lit("nation:"), "n_name").alias("category_id"))
    return H.taxon_membership(names, a.unionAll(b), wanted, ["nation"])


@query("E11_eligible_semi_join", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) >= 5)")
def eligible(spark, d):
    big = V.table(spark, d, "supplier").groupBy("s_nationkey").count().filter("count >= 5")
    c = V.table(spark, d, "customer")
    return c.join(big, c["c_nationkey"] == big["s_nationkey"], "left_semi").select("c_custkey")


@query("E12_parent_resolution", "WITH g AS (SELECT p_brand || '/' || p_size AS child, list_distinct(list(split_part(p_type, ' ', 1))) AS p FROM part GROUP BY 1) SELECT child, p[1] AS parent FROM g WHERE len(p) = 1")
def parents(spark, d):
    p = V.table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("child"), F.split("p_type", " ")[0].alias("parent"))
    names = p.select(F.col("child").alias("category")).unionAll(p.select("parent")).distinct()
    return H.unambiguous_parents(p, names)


@query("E13_probe_pairs", POINTS + " SELECT a.dataset, a.model, a.width, a.category AS parent, b.category AS child, round(a.score, 6) AS parent_score, round(b.score, 6) AS child_score FROM p a JOIN p b USING (dataset, model, width) WHERE CAST(b.category AS INTEGER) = CAST(a.category AS INTEGER) + 1")
def probe_pairs(spark, d):
    p = points(spark, d)
    pairs = spark.createDataFrame([(str(i), str(i + 1)) for i in range(4)], "parent string, child string")
    a = p.select("dataset", "model", "width", F.col("category").alias("parent"), F.col("score").alias("parent_score"))
    b = p.select("dataset", "model", "width", F.col("category").alias("child"), F.col("score").alias("child_score"))
    return a.join(F.broadcast(pairs), "parent").join(b, ["dataset", "model", "width", "child"]).select("dataset", "model", "width", "parent", "child", *R6("parent_score", "child_score"))


@query("F20_detector_recall", f"WITH {V.ACTS}, f AS (SELECT feature AS detector, row_id FROM acts WHERE feature < 5 AND value > 0.1::FLOAT), t AS (SELECT label AS category, count(*) AS total FROM embeddings GROUP BY label) SELECT x.detector, t.category, count(f.row_id) AS hit, t.total, round(count(f.row_id) / t.total, 6) AS recall FROM (SELECT DISTINCT detector FROM f) x CROSS JOIN t LEFT JOIN embeddings e ON e.label = t.category LEFT JOIN f ON f.row_id = e.vec_id AND f.detector = x.detector GROUP BY x.detector, t.category, t.total")
def recall(spark, d):
    fired = V.acts(spark, d).filter((F.col("feature") < 5) & (F.col("value") > F.lit(0.1).cast("float"))).select(F.col("feature").alias("detector"), "row_id")
    return H.detector_recall(fired, V.rows(spark, d).select("row_id", F.col("label").alias("category"))).select("detector", "category", "hit", "total", F.round("recall", 6).alias("recall"))


@query("F36_best_recall", POINTS + " SELECT width, feature, string_agg(category, '|' ORDER BY category) AS categories, round(max(recall), 6) AS best FROM (SELECT width, CAST(CAST(category AS INTEGER) % 2 AS INTEGER) AS feature, category, sum(tp) / sum(n) AS recall FROM p GROUP BY width, category) GROUP BY width, feature HAVING max(recall) >= 0.5")
def best_recall(spark, d):
    g = points(spark, d).groupBy("width", "category").agg((F.sum("tp") / F.sum("n")).alias("recall"))
    out = H.best_recall_per_feature(g.withColumn("feature", F.col("category").cast("int") % 2), 0.5)
    return out.select("width", "feature", "categories", F.round("best", 6).alias("best"))


@query("I05_category_intersection", POINTS + " SELECT category FROM p WHERE width = 1 AND score > 0.5 INTERSECT SELECT category FROM p WHERE width = 2 AND score > 0.5")
def category_intersection(spark, d):
    p = points(spark, d).filter("score > 0.5")
    return p.filter("width = 1").select("category").intersect(p.filter("width = 2").select("category"))


@query("F26_sweep_stats", POINTS + " SELECT width, model, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS largest, count(*) AS n FROM p GROUP BY width, model")
def sweep(spark, d):
    g = points(spark, d).groupBy("width", "model").agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("largest"), F.count("*").alias("n"))
    return g.select("width", "model", *R6("mean", "least", "largest"), "n")


@query("G10_prefix_with_misses", POINTS + ", o AS (SELECT dataset, model, category, width, CAST(score > 0.6 AS INTEGER) AS ok, row_number() OVER w AS n, sum(CAST(score > 0.6 AS INTEGER)) OVER (PARTITION BY dataset, model, category ORDER BY width ROWS UNBOUNDED PRECEDING) AS q FROM p WINDOW w AS (PARTITION BY dataset, model, category ORDER BY width)) SELECT dataset, model, category, CAST(coalesce(max(n) FILTER (q >= (1 - 0.3) * n - 1e-10), 0) AS INTEGER) AS prefix FROM o GROUP BY dataset, model, category")
def prefix_with_misses(spark, d):
    w = Window.partitionBy(*KEYS).orderBy("width")
    o = points(spark, d).withColumns({"n": F.row_number().over(w), "q": F.sum((F.col("score") > 0.6).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    fine = F.when(F.col("q") >= (1 - 0.3) * F.col("n") - 1e-10, F.col("n"))
    return o.groupBy(*KEYS).agg(F.coalesce(F.max(fine), F.lit(0)).alias("prefix"))
