"""Queries on integrity and set comparison. The shards are the sources of documents, in order of name."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import quality as Q
from featlake.plans.registry import query
from featlake.sources import views as V

SHARDS = "WITH s AS (SELECT source AS shard, count(*) AS rows FROM documents GROUP BY source), o AS (SELECT shard, rows, CAST(sum(rows) OVER (ORDER BY shard) - rows AS BIGINT) AS start, CAST(sum(rows) OVER (ORDER BY shard) AS BIGINT) AS stop FROM s)"


def shards(spark, d):
    s = V.table(spark, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("rows"))
    return Q.offsets(s, "shard").select("shard", "rows", "start", "stop")


@query("G03_running_offsets", SHARDS + " SELECT shard, rows, start, stop FROM o")
def offsets(spark, d):
    return shards(spark, d)


@query("N01_manifest_contiguity", SHARDS + " SELECT count(*) AS shards, CAST(sum(rows) AS BIGINT) AS rows, 0::BIGINT AS broken FROM o")
def contiguity(spark, d):
    s = shards(spark, d)
    return s.agg(F.count("*").alias("shards"), F.sum("rows").alias("rows")).join(Q.broken_offsets(s, "shard").agg(F.count("*").alias("broken")))


@query("E08_range_join", SHARDS + " SELECT v.vec_id, o.shard, CAST(v.vec_id - o.start AS BIGINT) AS shard_row FROM embeddings v JOIN o ON v.vec_id >= o.start AND v.vec_id < o.stop")
def range_join(spark, d):
    return Q.shard_of(V.table(spark, d, "embeddings").select("vec_id"), shards(spark, d), "vec_id").select("vec_id", "shard", (F.col("vec_id") - F.col("start")).alias("shard_row"))


@query("A10_point_lookup", SHARDS + " SELECT shard, CAST(321 - start AS BIGINT) AS shard_row, n_chars FROM o JOIN documents ON doc_id = 321 WHERE 321 >= start AND 321 < stop")
def point(spark, d):
    doc = V.table(spark, d, "documents").filter("doc_id = 321").select("doc_id", "n_chars")
    return Q.shard_of(doc, shards(spark, d), "doc_id").select("shard", (F.col("doc_id") - F.col("start")).alias("shard_row"), "n_chars")


@query("N02_payload_checks", f"WITH {V.ACTS}, m AS (SELECT row_id, count(*) AS n FROM acts GROUP BY row_id HAVING count(*) > 34) SELECT row_id, 'too many' AS problem FROM m UNION ALL SELECT row_id, 'range' FROM acts WHERE feature > 62")
def payload(spark, d):
    return Q.payload_faults(V.acts(spark, d), 34, 63)


@query("N03_unique_entries", f"WITH {V.ACTS} SELECT row_id, feature, 2::BIGINT AS n FROM acts WHERE row_id % 50 = 0 AND feature < 3")
def unique(spark, d):
    a = V.acts(spark, d)
    return Q.duplicate_entries(a.unionAll(a.filter("row_id % 50 = 0 and feature < 3")))


@query("N05_alignment_audit", "SELECT doc_id FROM documents WHERE doc_id % 97 = 0 OR doc_id < 3")
def alignment(spark, d):
    a = V.table(spark, d, "documents").select("doc_id", "lang", "source")
    b = a.filter("doc_id >= 3").withColumn("lang", F.when(F.col("doc_id") % 97 == 0, "xx").otherwise(F.col("lang")))
    return Q.misaligned(a, b, "doc_id", ["lang", "source"])


@query("N06_compatibility", "SELECT feature, side FROM (SELECT 5 AS feature, 'missing' AS side UNION ALL SELECT 70, 'extra')")
def compatibility(spark, d):
    f = V.features(spark)
    return Q.differences(f, f.filter("feature <> 5").unionAll(spark.createDataFrame([(70,)], "feature int")))


@query("N07_summary_sanity", f"""WITH {V.ACTS}, c AS (SELECT feature, count(*) AS c0, count(*) FILTER (value > 0.1::FLOAT) AS c1, count(*) FILTER (value > 0.2::FLOAT) AS c2 FROM acts GROUP BY feature), n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'sound' AS summary, count(*) AS features, 0::BIGINT AS broken FROM c UNION ALL SELECT 'rising', count(*), count(*) FILTER (feature % 10 = 3) FROM c UNION ALL SELECT 'overfull', count(*), count(*) FILTER (feature % 7 = 2) FROM c""")
def sanity(spark, d):
    """Counts that fall with the threshold and stay below the rows; the same with two kinds of faults put in."""
    from featlake.operators.activations import feature_stats

    n = V.table(spark, d, "embeddings").count()
    s = feature_stats(V.acts(spark, d), V.features(spark), (0.0, 0.1, 0.2)).select("feature", "c0", "c1", "c2")
    rising = s.withColumn("c2", F.when(F.col("feature") % 10 == 3, F.col("c1") + 1).otherwise(F.col("c2")))
    over = s.withColumn("c0", F.when(F.col("feature") % 7 == 2, F.lit(n + 1)).otherwise(F.col("c0")))
    out = None
    for name, x in (("sound", s), ("rising", rising), ("overfull", over)):
        one = x.agg(F.lit(name).alias("summary"), F.count("*").alias("features"), F.count_if(Q.falling(["c0", "c1", "c2"], n)).alias("broken"))
        out = one if out is None else out.unionAll(one)
    return out


@query("N09_expectations", "WITH a AS (SELECT round(avg(l_discount), 4) AS mean, count(*) / CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS lines, max(l_tax) AS tax FROM lineitem) SELECT 'mean' AS name, CAST(mean AS DOUBLE) AS actual, CAST(abs(mean - 0.05) <= 0.001 AS INTEGER) AS ok FROM a UNION ALL SELECT 'lines', round(lines, 6), CAST(abs(lines - 4) <= 0.2 AS INTEGER) FROM a UNION ALL SELECT 'tax', CAST(tax AS DOUBLE), CAST(abs(tax - 0.5) <= 0.01 AS INTEGER) FROM a")
def expectations(spark, d):
    """Three figures against expected values, the last of which the data do not meet."""
    lines = F.round(F.count("*") / F.countDistinct("l_orderkey"), 6)
    return Q.expectations({"mean": (F.round(F.avg("l_discount"), 4), 0.05, 0.001), "lines": (lines, 4.0, 0.2), "tax": (F.max("l_tax"), 0.5, 0.01)}, V.table(spark, d, "lineitem"))


@query("A26_completeness", """WITH k AS (SELECT 'sound' AS t, vec_id FROM embeddings UNION ALL SELECT 'gap', vec_id FROM embeddings WHERE label <> 3 UNION ALL SELECT 'twice', vec_id FROM embeddings UNION ALL SELECT 'twice', vec_id FROM embeddings WHERE label = 3 UNION ALL SELECT 'moved', vec_id + 1 FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings)
SELECT t AS case_, CAST(count(*) = max(n) AS INTEGER) AS count_ok, CAST(count(DISTINCT vec_id) = max(n) AS INTEGER) AS unique_ok, CAST(min(vec_id) = 0 AND max(vec_id) = max(n) - 1 AS INTEGER) AS range_ok FROM k, n GROUP BY t""")
def completeness(spark, d):
    """A dense index, and the same with rows left out, rows twice and ids moved."""
    e = V.table(spark, d, "embeddings").select("vec_id", "label")
    n = e.count()
    cases = {"sound": e, "gap": e.filter("label <> 3"), "twice": e.unionAll(e.filter("label = 3")), "moved": e.withColumn("vec_id", F.col("vec_id") + 1)}
    out = None
    for name, x in cases.items():
        one = Q.completeness(x, "vec_id", n).select(F.lit(name).alias("case_"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@query("E19_baseline_compare", "SELECT l_linenumber, count(*) AS x, count(*) + 1 AS y FROM lineitem WHERE l_linenumber = 3 GROUP BY l_linenumber")
def baseline(spark, d):
    n = V.table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    other = n.withColumn("n", F.col("n") + (F.col("l_linenumber") == 3).cast("long"))
    return Q.compare(n, other, ["l_linenumber"], "n")


@query("I06_missing_extra", "SELECT n_name AS name, 'missing' AS side FROM nation WHERE n_nationkey < 2")
def missing(spark, d):
    n = V.table(spark, d, "nation")
    return Q.differences(n.select(F.col("n_name").alias("name")), n.filter("n_nationkey >= 2").select(F.col("n_name").alias("name")))


@query("E07_common_shards", "SELECT a.source AS shard, CASE WHEN a.n = b.n THEN 'aligned' ELSE 'excluded' END AS status FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) a JOIN (SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' OR doc_id % 3 = 0 GROUP BY source) b USING (source)")
def common(spark, d):
    doc = V.table(spark, d, "documents")
    a, b = (x.groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("rows")) for x in (doc, doc.filter("source <> 'src3' or doc_id % 3 = 0")))
    same = a.join(b, ["shard", "rows"]).select("shard", F.lit("aligned").alias("status"))
    return same.unionAll(a.join(b, ["shard", "rows"], "left_anti").select("shard", F.lit("excluded")))


@query("I07_shared_shards", "SELECT DISTINCT source AS shard FROM documents WHERE lang = 'es' INTERSECT SELECT DISTINCT source FROM documents WHERE lang = 'de'")
def shared(spark, d):
    doc = V.table(spark, d, "documents")
    return doc.filter("lang = 'es'").select(F.col("source").alias("shard")).intersect(doc.filter("lang = 'de'").select("source"))


@query("I03_directed_union", "SELECT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem UNION SELECT l_partkey % 50, l_suppkey FROM lineitem")
def directed(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).union(li.select(F.col("l_partkey") % 50, "l_suppkey")).distinct()


@query("I02_exclusive_intersection", "SELECT c_nationkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier")
def exclusive(spark, d):
    return V.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("key")).intersect(V.table(spark, d, "supplier").select("s_nationkey"))


@query("I04_sampled_union", f"WITH {V.ACTS} SELECT DISTINCT row_id FROM acts WHERE feature IN (1, 2) AND value > 0.2::FLOAT")
def sampled_union(spark, d):
    a = V.acts(spark, d).filter(F.col("value") > F.lit(0.2).cast("float"))
    return a.filter("feature = 1").select("row_id").union(a.filter("feature = 2").select("row_id")).distinct()


@query("F28_inventory", "SELECT lang, source, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source")
def inventory(spark, d):
    return V.table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query("A27_training_inventory", "SELECT lang, count(*) AS rows FROM documents WHERE lang = 'fr' GROUP BY lang")
def training_inventory(spark, d):
    n = V.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("rows"))
    other = n.withColumn("rows", F.col("rows") + (F.col("lang") == "fr").cast("long"))
    return n.exceptAll(other)


@query("G14_run_boundaries", "SELECT conv_id, count(*) AS runs FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b <> role GROUP BY conv_id")
def runs(spark, d):
    from pyspark.sql import Window

    c = V.table(spark, d, "conversations")
    b = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("b", b).filter("b is null or b <> role").groupBy("conv_id").agg(F.count("*").alias("runs"))


@query("N13_milestone_import", "WITH h AS (SELECT DISTINCT p_brand AS kind, p_size AS budget FROM part), w AS (SELECT kind, budget FROM (SELECT DISTINCT kind FROM h), (SELECT unnest(range(1, 51)) AS budget)), m AS (SELECT w.kind, min(w.budget) AS first FROM w LEFT JOIN h ON h.kind = w.kind AND h.budget = w.budget WHERE h.budget IS NULL GROUP BY w.kind) SELECT kind, coalesce(first - 1, 50) AS upto FROM (SELECT DISTINCT kind FROM h) LEFT JOIN m USING (kind)")
def milestones(spark, d):
    """Sizes of each brand as recorded milestones, on another host than the ones that are wanted: the unbroken run from the first."""
    p = V.table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_size").alias("budget")).distinct()
    want = p.select("kind").distinct().withColumn("budget", F.explode(F.sequence(F.lit(1), F.lit(50)))).select("kind", "budget", F.col("budget").alias("n"), F.lit("x").alias("host"))
    found = Q.compatible_prefix(want, p.withColumn("host", F.lit("y")), ["host"])
    names = want.select("kind", F.sha2(F.to_json(F.struct("kind")).cast("binary"), 256).alias("config")).distinct()
    return found.join(names, "config").select("kind", F.col("upto").cast("int").alias("upto"))
