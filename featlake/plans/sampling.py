"""Queries on deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featlake.functions import hashing, text
from featlake.operators import sampling as S
from featlake.plans.registry import query
from featlake.plans.similarity import _splitmix_sql
from featlake.sources import views as V


@query("M01_fixed_sample", "SELECT doc_id FROM documents ORDER BY sha256('7' || chr(0) || doc_id), doc_id LIMIT 100")
def fixed(spark, d):
    return S.fixed_sample(V.table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


REMAINDER = "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT lang, n, n * 101 / (SELECT sum(n) FROM c)::DOUBLE AS share FROM c), r AS (SELECT *, floor(share) AS f, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang) AS k FROM s), t AS (SELECT lang, n, CAST(f + CASE WHEN k <= 101 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS take FROM r)"


@query("H10_largest_remainder", REMAINDER + " SELECT lang, n, take FROM t")
def remainder(spark, d):
    return S.largest_remainder(V.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", 101)


@query("M02_proportional_sample", REMAINDER + ", o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('9' || chr(0) || lang || chr(0) || doc_id), doc_id) AS rn FROM documents) SELECT o.doc_id, o.lang FROM o JOIN t USING (lang) WHERE rn <= take")
def proportional(spark, d):
    return S.proportional_sample(V.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 101, 9).select("doc_id", "lang")


KEY = "xor(xor(1729, 5)::UBIGINT, ((feature::UBIGINT * 134217728) | row_id::UBIGINT))"
RES = f"WITH {V.ACTS}, src AS (SELECT *, {KEY} AS key FROM acts), {_splitmix_sql('key')}, b AS (SELECT feature, CASE WHEN value > 0.3::FLOAT THEN 6 WHEN value > 0.2::FLOAT THEN 5 WHEN value > 0.1::FLOAT THEN 4 WHEN value > 0.05::FLOAT THEN 3 WHEN value > 0.02::FLOAT THEN 2 WHEN value > 0.01::FLOAT THEN 1 ELSE 0 END AS bin, row_id, z FROM h3), r AS (SELECT feature, bin, CAST(row_number() OVER (PARTITION BY feature, bin ORDER BY z, row_id) - 1 AS INTEGER) AS slot, row_id FROM b) SELECT * FROM r WHERE slot < 5"


def _reservoir(acts):
    return S.reservoir(acts, hashing.priority(1729, 5, F.col("feature"), F.col("row_id")), 5)


@query("M03_reservoir", RES)
def reservoir(spark, d):
    return _reservoir(V.acts(spark, d)).select("feature", "bin", "slot", "row_id")


@query("G07_bottom_by_priority", RES)
def merged_reservoir(spark, d):
    a = V.acts(spark, d)
    return S.merge_reservoirs(_reservoir(a.filter("row_id % 2 = 0")), _reservoir(a.filter("row_id % 2 = 1")), 5).select("feature", "bin", "slot", "row_id")


@query("J16_priority", f"WITH {V.ACTS}, src AS (SELECT *, {KEY} AS key FROM acts), {_splitmix_sql('key')} SELECT feature, row_id, CAST(z::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) AS priority FROM h3")
def priority(spark, d):
    return V.acts(spark, d).select("feature", "row_id", hashing.priority(1729, 5, F.col("feature"), F.col("row_id")).alias("priority"))


@query("G09_first_occurrence", "SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first(spark, d):
    return S.first_occurrence(V.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query("H03_top_per_feature", f"WITH {V.ACTS} SELECT feature, row_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, row_id) AS r FROM acts) WHERE r <= 10")
def top_per_feature(spark, d):
    w = Window.partitionBy("feature").orderBy(F.desc("value"), "row_id")
    return V.acts(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("feature", "row_id", "rank")


DISTINCT = "WITH n AS (SELECT doc_id, lang, n_chars, trim(regexp_replace(lower(text), '[\t-\r ]+', ' ', 'g')) AS t FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY lang, t ORDER BY n_chars DESC, doc_id) AS q FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM o WHERE q = 1)"


def _distinct(spark, d, n):
    return S.top_distinct(V.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), "lang", "n_chars", text.normalise_space(F.lower("text")), "doc_id", n)


@query("H04_top_distinct_text", DISTINCT + " SELECT lang, doc_id, CAST(r AS INTEGER) AS rank FROM k WHERE r <= 10")
def top_distinct(spark, d):
    return _distinct(spark, d, 10).select("lang", "doc_id", "rank")


@query("H08_unique_texts", DISTINCT + " SELECT lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) AS docs FROM k WHERE r <= 5 GROUP BY lang")
def unique_texts(spark, d):
    t = _distinct(spark, d, 5).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("a"))
    return t.select("lang", F.array_join(F.transform("a", lambda x: x["doc_id"].cast("string")), ",").alias("docs"))


@query("H09_argmax_winner", "WITH s AS (SELECT l_orderkey AS row_id, l_linenumber AS atom, l_discount - 0.05 AS score FROM lineitem) SELECT row_id, CASE WHEN score > 1e-9 THEN atom END AS winner FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, atom) AS r FROM s) WHERE r = 1")
def winner(spark, d):
    s = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("atom"), F.round(F.col("l_discount") - 0.05, 9).alias("score"))
    best = s.groupBy("row_id").agg(F.max(F.struct("score", (-F.col("atom")).alias("minus"))).alias("b"))
    return best.select("row_id", F.when(F.col("b.score") > 1e-9, -F.col("b.minus")).alias("winner"))


@query("M04_balanced_selection", f"WITH {V.ACTS}, g AS (SELECT feature, row_id, CASE WHEN value > 0.1::FLOAT THEN 'high' ELSE 'low' END AS band FROM acts), r AS (SELECT *, row_number() OVER (PARTITION BY feature, band ORDER BY sha256('3' || chr(0) || row_id), row_id) AS k FROM g) SELECT feature, band, row_id FROM r WHERE k <= 4")
def balanced(spark, d):
    g = V.acts(spark, d).withColumn("band", F.when(F.col("value") > F.lit(0.1).cast("float"), "high").otherwise("low"))
    w = Window.partitionBy("feature", "band").orderBy(S.hash_order(3, "row_id"), "row_id")
    return g.withColumn("k", F.row_number().over(w)).filter("k <= 4").select("feature", "band", "row_id")


@query("M05_calibration_sample", f"WITH {V.ACTS} SELECT count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 9) AS median FROM acts")
def calibration(spark, d):
    """A bounded sample brackets the median; the exact ranks inside the bracket alone decide, whatever the sample."""
    from featlake.operators.activations import pooled_median_bracketed

    return pooled_median_bracketed(V.acts(spark, d)).select("n", F.round("median", 9).alias("median"))


@query("M06_species_split", "SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY sha256('11' || chr(0) || p_partkey), p_partkey) <= (count(*) OVER () + 1) // 2 THEN 'train' ELSE 'test' END AS split FROM part")
def species_split(spark, d):
    return S.half(V.table(spark, d, "part").select("p_partkey"), "p_partkey", 11)


def _unit_sql(*keys):
    return "(('0x' || substring(sha256('21'" + "".join(f" || chr(0) || {k}" for k in keys) + "), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("M07_shard_sampling", f"""WITH r AS (SELECT source AS shard, doc_id AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents), n AS (SELECT shard, count(*) AS n FROM r GROUP BY shard), e AS (SELECT shard, n, sum(n) OVER (ORDER BY shard) - n AS start FROM n),
d AS (SELECT draw, floor({_unit_sql('draw', "'shard'")} * (SELECT count(*) FROM r)) AS spot FROM (SELECT unnest(range(12)) AS draw)), m AS (SELECT draw, shard, floor({_unit_sql('draw', "'row'")} * (greatest(0, n - 32) + 1)) AS first FROM d JOIN e ON spot >= start AND spot < start + n)
SELECT draw, shard, row, CAST(row_number() OVER (PARTITION BY draw ORDER BY sha256('21' || chr(0) || draw || chr(0) || row), row) - 1 AS INTEGER) AS place FROM m JOIN r USING (shard) WHERE p >= first AND p < first + 32""")
def shards(spark, d):
    return S.shard_batches(V.table(spark, d, "documents"), "source", "doc_id", 12, 32, 21)


@query("M09_parameter_grid", "SELECT a.kind, CAST(w.width AS INTEGER) AS width, CAST(s.seed AS INTEGER) AS seed FROM (SELECT unnest(['flat', 'tree']) AS kind) a CROSS JOIN (SELECT unnest([512, 4096, 32768]) AS width) w CROSS JOIN (SELECT unnest(range(78)) AS seed) s")
def grid(spark, d):
    return spark.range(78).select(F.explode(F.array(F.lit("flat"), F.lit("tree"))).alias("kind"), F.col("id").cast("int").alias("seed")).select("kind", "seed", F.explode(F.array(F.lit(512), F.lit(4096), F.lit(32768))).alias("width"))
