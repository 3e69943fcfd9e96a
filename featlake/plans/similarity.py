"""Queries on vector and activation similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from featlake.functions import hashing
from featlake.operators import activations as A
from featlake.operators import similarity as S
from featlake.plans.registry import query
from featlake.sources import views as V
from featlake.sources.files import fresh

COS = f"WITH {V.DICTS}"


def dictionary(spark, d, which: int):
    e = V.table(spark, d, "embeddings").filter(F.col("vec_id") % 2 == which)
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def edges(spark, d, t: float = 0.25, absolute: bool = False):
    return S.cosine_edges(dictionary(spark, d, 0), dictionary(spark, d, 1), t, absolute)


def _score():
    return F.round("score", 6).alias("score")


@query("J23_normalise", "SELECT vec_id AS id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def normalise(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return e.select("id", F.round(S.norm(F.col("vec")), 5).alias("norm"))


@query("A24_dictionary_load", "SELECT vec_id AS id, round(embedding[1] / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings")
def dictionary_load(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return S.normalised(e).select("id", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query("E03_threshold_join", COS + " SELECT src, dst, round(score, 6) AS score FROM cos WHERE CAST(score AS FLOAT) >= 0.25::FLOAT")
def threshold_join(spark, d):
    return edges(spark, d).select("src", "dst", _score())


@query("J24_absolute_cosine", COS + " SELECT src, dst, round(score, 6) AS score FROM cos WHERE CAST(abs(score) AS FLOAT) >= 0.3::FLOAT")
def absolute(spark, d):
    return edges(spark, d, 0.3, True).select("src", "dst", _score())


@query("K08_absolute_to_signed", COS + " SELECT src, dst, round(score, 6) AS score FROM cos WHERE CAST(abs(score) AS FLOAT) >= 0.3::FLOAT AND score > 0")
def signed(spark, d):
    return edges(spark, d, 0.3, True).filter("score > 0").select("src", "dst", _score())


@query("K07_threshold_sweep", COS + ", t AS (SELECT unnest([25, 30, 35, 40, 45]) AS percent) SELECT t.percent, count(c.src) AS n, count(DISTINCT c.src) AS sources, count(DISTINCT c.dst) AS targets FROM t LEFT JOIN cos c ON c.score >= t.percent / 100.0 GROUP BY t.percent")
def sweep(spark, d):
    e = edges(spark, d).select("src", "dst", "score", F.explode(F.array(*(F.lit(p) for p in (25, 30, 35, 40, 45)))).alias("percent")).filter(F.col("score") >= F.col("percent") / 100.0)
    counts = e.groupBy("percent").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
    return spark.createDataFrame([(p,) for p in (25, 30, 35, 40, 45)], "percent int").join(counts, "percent", "left").fillna(0)


@query("I10_nested_graphs", COS + " SELECT (SELECT count(*) FROM cos WHERE score >= 0.3) AS inner_edges, 0::BIGINT AS not_nested")
def nested(spark, d):
    e = edges(spark, d)
    return e.filter("score >= 0.3").select("src", "dst").agg(F.count("*").alias("inner_edges")).join(e.filter("score >= 0.3").select("src", "dst").exceptAll(e.filter("score >= 0.25").select("src", "dst")).agg(F.count("*").alias("not_nested")))


@query("E04_exclusive_pairs", COS + " SELECT src, dst, round(score, 6) AS score FROM cos c WHERE score > 0.33 AND NOT EXISTS (SELECT 1 FROM cos x WHERE x.score > 0.31 AND ((x.src = c.src AND x.dst <> c.dst) OR (x.dst = c.dst AND x.src <> c.src)))")
def exclusive(spark, d):
    return S.exclusive(edges(spark, d), 0.33, 0.31).select("src", "dst", _score())


@query("F34_existential_counts", COS + " SELECT count(DISTINCT src) AS plain_left, count(DISTINCT dst) AS plain_right FROM cos WHERE score >= 0.3")
def existential(spark, d):
    return edges(spark, d, 0.3).agg(F.countDistinct("src").alias("plain_left"), F.countDistinct("dst").alias("plain_right"))


@query("G06_top_neighbours", COS + " SELECT src, CAST(rank AS INTEGER) AS rank, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM cos WHERE score >= 0.2) WHERE rank <= 5")
def top_neighbours(spark, d):
    return S.top_neighbours(edges(spark, d, 0.2), 5).select("src", "rank", "dst")


@query("E17_best_match", COS + " SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM cos) WHERE r = 1")
def best_match(spark, d):
    return S.best_cosines(dictionary(spark, d, 0), dictionary(spark, d, 1)).select("src", "dst")


@query("F35_best_score_means", COS + ", b AS (SELECT src, max(score) AS best FROM cos GROUP BY src) SELECT round(avg(CASE WHEN best >= 0.3 THEN best ELSE 0 END), 6) AS zero_filled, round(avg(CASE WHEN best >= 0.3 THEN best END), 6) AS valid_only, round(avg(CASE WHEN best >= 0.35 THEN 1.0 ELSE 0.0 END), 6) AS above FROM b")
def best_means(spark, d):
    b = S.best_cosines(dictionary(spark, d, 0), dictionary(spark, d, 1))
    valid = F.when(F.col("score") >= 0.3, F.col("score"))
    return b.agg(F.round(F.avg(F.coalesce(valid, F.lit(0.0))), 6).alias("zero_filled"), F.round(F.avg(valid), 6).alias("valid_only"), F.round(F.avg((F.col("score") >= 0.35).cast("double")), 6).alias("above"))


@query("L17_cosine_median", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id) SELECT count(*) AS n, round(quantile_cont(s, 0.5), 6) AS median FROM c")
def cosine_median(spark, d):
    n, median = S.cosine_median(V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    return spark.createDataFrame([(n, round(median, 6))], "n long, median double")


CENTRES = "WITH x AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id AS centre, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 10), s AS (SELECT x.row_id, CAST(c.centre AS INTEGER) AS centre, 2 * list_inner_product(x.v, c.v) - list_inner_product(c.v, c.v) AS score FROM x, c), near AS (SELECT row_id, centre FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, centre) AS r FROM s) WHERE r = 1)"


def _centres(spark, d):
    rows = V.table(spark, d, "embeddings").filter("vec_id < 10").orderBy("vec_id").collect()  # ten rows
    return np.array([r["embedding"] for r in rows], np.float64)


@query("L13_centroid_assignment", CENTRES + " SELECT row_id, centre FROM near")
def assignment(spark, d):
    return S.nearest_centre(V.table(spark, d, "embeddings"), _centres(spark, d), "vec_id", "embedding")


@query("E18_nearest_centroid_counts", CENTRES + " SELECT centre, count(*) AS n FROM near GROUP BY centre")
def centroid_counts(spark, d):
    return S.nearest_centre(V.table(spark, d, "embeddings"), _centres(spark, d), "vec_id", "embedding").groupBy("centre").agg(F.count("*").alias("n"))


@query("L12_lloyd_step", CENTRES + " SELECT n.centre, CAST(i - 1 AS INTEGER) AS i, round(avg(CAST(e.embedding[i] AS DOUBLE)), 6) AS x FROM near n JOIN embeddings e ON e.vec_id = n.row_id CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t GROUP BY n.centre, i")
def lloyd(spark, d):
    new, _ = S.lloyd(V.table(spark, d, "embeddings"), _centres(spark, d), "embedding")
    rows = [(c, i, round(float(x), 6) + 0.0) for c, v in enumerate(new) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "centre int, i int, x double")


@query("L12_k_means")
def k_means(spark, d):
    """A fit of eight rounds, stopped after three and taken up again from its folder: the objective of each round."""
    e, folder = V.table(spark, d, "embeddings"), fresh(spark, "k_means")
    S.k_means(e, "vec_id", "embedding", 10, 3, 17, folder)
    _, history = S.k_means(e, "vec_id", "embedding", 10, 8, 17, folder)
    return spark.createDataFrame([(k + 1, round(x, 5)) for k, x in enumerate(history)], "round int, objective double")


#: Correlations of features 0-31 with 32-63 over rows, missing entries being zeros.
PEARSON = f"""WITH {V.ACTS}, z AS (SELECT row_id, feature, CASE WHEN value > 0 THEN CAST(value AS DOUBLE) ELSE 0 END AS x FROM comp),
p AS (SELECT a.feature AS src, b.feature AS dst, corr(a.x, b.x) AS score, sum(a.x * b.x) AS dots FROM z a JOIN z b ON a.row_id = b.row_id AND a.feature < 32 AND b.feature >= 32 GROUP BY a.feature, b.feature)"""


def _halves(spark, d):
    a = V.acts(spark, d)
    return a.filter("feature < 32"), a.filter("feature >= 32")


def _correlations(spark, d, pairs=None):
    x, y = _halves(spark, d)
    f = V.features(spark)
    n = V.table(spark, d, "embeddings").count()
    return S.correlations(S.cross_dots(x, y, pairs), A.moments(x, f.filter("feature < 32")), A.moments(y, f.filter("feature >= 32")), F.lit(n))


@query("F06_pearson", PEARSON + " SELECT src, dst, round(score, 6) AS score FROM p")
def pearson(spark, d):
    return _correlations(spark, d).select("src", "dst", _score())


@query("L08_candidate_dots", PEARSON + " SELECT src, dst, round(dots, 6) AS dots FROM p WHERE (src + dst) % 7 = 0")
def candidate_dots(spark, d):
    f = V.features(spark)
    pairs = f.filter("feature < 32").select(F.col("feature").alias("src")).join(f.filter("feature >= 32").select(F.col("feature").alias("dst"))).filter("(src + dst) % 7 = 0")
    x, y = _halves(spark, d)
    return S.cross_dots(x, y, pairs).select("src", "dst", F.round("dots", 6).alias("dots"))


@query("D13_top5_pearson", PEARSON + " SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(score, 6) AS pearson FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS rank FROM p) WHERE rank <= 5")
def top5(spark, d):
    c = _correlations(spark, d).withColumn("score", F.round("score", 9))
    return S.top_neighbours(c, 5).select("src", "rank", "dst", F.round("score", 6).alias("pearson"))


@query("E06_candidate_union", PEARSON + ", f AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS r FROM p) WHERE r <= 2), b AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(score, 9) DESC, src) AS r FROM p) WHERE r <= 2) SELECT src, dst FROM f WHERE score >= 0.05 UNION SELECT src, dst FROM b WHERE score >= 0.05")
def union(spark, d):
    c = _correlations(spark, d).withColumn("score", F.round("score", 9))
    forward = S.top_neighbours(c, 2)
    back = S.top_neighbours(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"), 2)
    return S.candidate_union(forward, back, 0.05, 64, 64)


SKETCH_BUCKETS = 32


def _splitmix_sql(x: str) -> str:
    """CTE chain h0 to h3 that mixes the integer expression x of table src."""
    return f"""h0 AS (SELECT *, ({x}::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z0 FROM src),
h1 AS (SELECT *, (xor(z0, z0 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z1 FROM h0),
h2 AS (SELECT *, (xor(z1, z1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z2 FROM h1),
h3 AS (SELECT *, xor(z2, z2 // 2147483648::UHUGEINT) AS z FROM h2)"""


@query("J15_splitmix", f"WITH src AS (SELECT vec_id FROM embeddings), {_splitmix_sql('vec_id')} SELECT vec_id, CAST(z::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) AS mixed FROM h3")
def splitmix(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", hashing.mixed(F.col("vec_id")).alias("mixed"))


SKETCH = f"""WITH {V.ACTS}, src AS (SELECT vec_id FROM embeddings), {_splitmix_sql('vec_id')}, hs AS (SELECT vec_id, CAST(z % 32 AS INTEGER) AS bucket, CAST((z // 32) % 2 AS INTEGER) * 2 - 1 AS sign FROM h3),
sk AS (SELECT feature, bucket, sum(sign * CAST(value AS DOUBLE)) AS value FROM acts JOIN hs ON hs.vec_id = acts.row_id GROUP BY feature, bucket)"""


def _sketch(spark, d):
    bucket, sign = hashing.bucket_and_sign(F.col("row_id"), SKETCH_BUCKETS)
    hashed = V.rows(spark, d).select("row_id", bucket.alias("bucket"), sign.alias("sign"))
    return S.count_sketch(V.acts(spark, d).join(hashed, "row_id"), F.col("bucket"), F.col("sign")), hashed


@query("L05_count_sketch", SKETCH + " SELECT feature, bucket, round(value, 6) AS value FROM sk")
def sketch(spark, d):
    return _sketch(spark, d)[0].select("feature", "bucket", F.round("value", 6).alias("value"))


CENTRED = SKETCH + """, ones AS (SELECT bucket, CAST(sum(sign) AS DOUBLE) AS one FROM hs GROUP BY bucket), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings),
mom AS (SELECT feature, sum(CAST(value AS DOUBLE)) AS s1, sum(CAST(value AS DOUBLE) * value) AS s2 FROM acts GROUP BY feature),
cs AS (SELECT m.feature, o.bucket, (coalesce(sk.value, 0) - m.s1 / n.n * o.one) / sqrt(m.s2 - m.s1 * m.s1 / n.n) AS value FROM mom m CROSS JOIN ones o CROSS JOIN n LEFT JOIN sk ON sk.feature = m.feature AND sk.bucket = o.bucket)"""


def _centred(spark, d):
    sk, hashed = _sketch(spark, d)
    ones = hashed.groupBy("bucket").agg(F.sum("sign").cast("double").alias("one"))
    n = V.table(spark, d, "embeddings").count()
    return S.centred_sketch(sk, ones, A.moments(V.acts(spark, d), V.features(spark)), F.lit(n))


@query("L06_centred_sketch", CENTRED + " SELECT feature, bucket, round(value, 6) AS value FROM cs")
def centred(spark, d):
    return _centred(spark, d).select("feature", "bucket", F.round("value", 6).alias("value"))


@query("L07_sketch_candidates", CENTRED + " SELECT src, CAST(rank AS INTEGER) AS rank, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS rank FROM (SELECT a.feature AS src, b.feature AS dst, sum(a.value * b.value) AS score FROM cs a JOIN cs b ON a.bucket = b.bucket WHERE a.feature < 32 AND b.feature >= 32 GROUP BY a.feature, b.feature)) WHERE rank <= 8")
def candidates(spark, d):
    c = _centred(spark, d)
    return S.sketch_candidates(c.filter("feature < 32"), c.filter("feature >= 32"), 8).select("src", "rank", "dst")


RESCORED = CENTRED + """, z AS (SELECT row_id, feature, CASE WHEN value > 0 THEN CAST(value AS DOUBLE) ELSE 0 END AS x FROM comp),
p AS (SELECT a.feature AS src, b.feature AS dst, corr(a.x, b.x) AS score FROM z a JOIN z b ON a.row_id = b.row_id AND a.feature < 32 AND b.feature >= 32 GROUP BY a.feature, b.feature),
q AS (SELECT a.feature AS src, b.feature AS dst, sum(a.value * b.value) AS score FROM cs a JOIN cs b ON a.bucket = b.bucket WHERE a.feature < 32 AND b.feature >= 32 GROUP BY a.feature, b.feature),
cand AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS rank FROM q) WHERE rank <= 8)"""


@query("E05_candidate_rescore", RESCORED + " SELECT src, dst, round(p.score, 6) AS score FROM p JOIN cand USING (src, dst)")
def rescore(spark, d):
    c = _centred(spark, d)
    pairs = S.sketch_candidates(c.filter("feature < 32"), c.filter("feature >= 32"), 8).select("src", "dst")
    return _correlations(spark, d, pairs).select("src", "dst", _score())


@query("L09_shared_scan", f"WITH {V.ACTS}, mix AS (SELECT label, 'all' AS mixture FROM (SELECT DISTINCT label FROM embeddings) UNION ALL SELECT DISTINCT label, 'even' FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT DISTINCT label, 'low' FROM embeddings WHERE label < 5) SELECT mixture, feature, count(*) AS support, round(sum(CAST(value AS DOUBLE)), 6) AS s1 FROM acts a JOIN embeddings e ON e.vec_id = a.row_id JOIN mix m ON m.label = e.label GROUP BY mixture, feature")
def shared_scan(spark, d):
    rows = V.rows(spark, d)
    mixtures = F.filter(F.array(F.lit("all"), F.when(F.col("label") % 2 == 0, "even"), F.when(F.col("label") < 5, "low")), lambda m: m.isNotNull())
    per_label = V.acts(spark, d).join(rows, "row_id").groupBy("label", "feature").agg(F.count("*").alias("c"), F.sum(F.col("value").cast("double")).alias("s"))
    return per_label.select(F.explode(mixtures).alias("mixture"), "feature", "c", "s").groupBy("mixture", "feature").agg(F.sum("c").alias("support"), F.round(F.sum("s"), 6).alias("s1"))
