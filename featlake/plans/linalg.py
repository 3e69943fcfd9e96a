"""Queries on linear algebra and synthetic data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from featlake.operators import autoencoder as AE
from featlake.operators import linalg as L
from featlake.operators import recovery as R
from featlake.plans.registry import query
from featlake.plans.similarity import COS, dictionary
from featlake.sources import views as V

GRAM = "WITH x AS (SELECT vec_id, CAST(label AS VARCHAR) AS grp, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t)"


@query("F27_gram_sums", GRAM + " SELECT a.i, b.i AS j, count(*) AS n, round(sum(a.v * b.v), 6) AS s FROM x a JOIN x b USING (vec_id) WHERE a.i < 8 GROUP BY a.i, b.i")
def gram(spark, d):
    g = L.gram(V.table(spark, d, "embeddings"), "embedding").filter("j >= 0 and i < 8")
    return g.select("i", "j", "n", F.round(F.col("s"), 6).alias("s"))


@query("F27_gram_by_dataset", GRAM + " SELECT grp, i, count(*) AS n, round(sum(v), 6) AS s FROM x GROUP BY grp, i")
def gram_by(spark, d):
    g = L.gram(V.table(spark, d, "embeddings"), "embedding", "label").filter("j = -1")
    return g.select("grp", "i", "n", F.round(F.col("s"), 6).alias("s"))


@query("L10_pca")
def pca(spark, d):
    _, values, parts = L.pca(L.gram(V.table(spark, d, "embeddings"), "embedding"), 8)
    rows = [(k, round(float(v), 6), round(float(np.abs(p).max()), 4)) for k, (v, p) in enumerate(zip(values, parts, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, loading double")


@query("L11_small_pca")
def small_pca(spark, d):
    e = V.table(spark, d, "embeddings").filter("label = 3")
    mean, _, parts = L.pca(L.gram(e, "embedding"), 2)
    axes = [F.array(*(F.lit(float(x)) for x in p)) for p in parts]
    centre = F.array(*(F.lit(float(x)) for x in mean))
    shifted = F.zip_with("embedding", centre, lambda x, m: x.cast("double") - m)
    along = lambda a: F.aggregate(F.zip_with(shifted, a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(along(axes[0]), 4).alias("x"), F.round(along(axes[1]), 4).alias("y"))


def _found(spark, d):
    e = V.table(spark, d, "embeddings")
    atoms = np.array([r["embedding"] for r in e.filter("vec_id < 96").orderBy("vec_id").collect()], np.float64)  # 96 rows
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    return L.sparse_reconstruction(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), atoms, 0.5, 24)


@query("L14_matching_pursuit")
def pursuit(spark, d):
    return _found(spark, d).select("id", "atoms_required", F.round("residual", 4).alias("residual"), F.round("cosine", 4).alias("cosine"))


@query("L15_required_histogram")
def histogram(spark, d):
    return L.required_histogram(_found(spark, d), 24, 0.5)


@query("L16_projection")
def projection(spark, d):
    """Families of twenty vectors: the first on the span of the others."""
    e = V.table(spark, d, "embeddings")
    g = e.select(F.expr("vec_id div 20").alias("grp"), (F.col("vec_id") % 20 == 0).alias("is_target"), F.col("embedding").alias("vec"))
    return L.projections(g).select("grp", "members", F.round("explained", 5).alias("explained"), F.round("cosine", 5).alias("cosine"))


@query("L20_geometric_recovery", COS + " SELECT atom, round(similarity, 6) AS similarity, nearest, CAST(similarity >= 0.3 AS INTEGER) AS recovered FROM (SELECT src AS atom, abs(score) AS similarity, dst AS nearest, row_number() OVER (PARTITION BY src ORDER BY abs(score) DESC, dst) AS r FROM cos) WHERE r = 1")
def geometric(spark, d):
    """Flat recovery: the learned atom nearest to each known one."""
    found = R.nearest_atoms(dictionary(spark, d, 0), dictionary(spark, d, 1))
    return found.select(F.col("id").alias("atom"), F.round("similarity", 6).alias("similarity"), "nearest", (F.col("similarity") >= 0.3).cast("int").alias("recovered"))


@query("L20_family_recovery")
def family_recovery(spark, d):
    """Recovery of families: known atoms by threes, a parent and two children, who are compared without the parent's share."""
    a = dictionary(spark, d, 0).select(F.expr("id div 2 div 3").alias("family"), F.expr("id div 2 % 3").alias("part"), "vec")
    bars = (0.2, 0.25, 0.3)
    f = R.families(a, dictionary(spark, d, 1), bars)
    return f.select("family", *(F.round(c, 5).alias(c) for c in ("parent", "child_a", "child_b")), *(F.col("recovered")[i].cast("int").alias(f"family_{round(100 * t)}") for i, t in enumerate(bars)))


@query("M08_synthetic_latents")
def latents(spark, d):
    return L.latents(spark, 5000, 64, 4, 1.0, 3).groupBy("feature").agg(F.count("*").alias("n"))


@query("L22_autoencoders")
def autoencoders(spark, d):
    """The loss of each step of a short fit of every kind of sparse autoencoder."""
    e = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = []
    for kind in AE.KINDS:
        fit = AE.train(e, "vec_id", "embedding", AE.Settings(kind, 32, sparsity=0.0 if "topk" in kind else 0.001, batches=2), 4)
        rows += [(kind, k + 1, round(x, 8)) for k, x in enumerate(fit.history)]
    return spark.createDataFrame(rows, "kind string, step int, loss double")


@query("L24_parity_audit", "SELECT count(*) AS checked, 0::BIGINT AS outside, count(*) FILTER (label = 7) AS caught FROM embeddings")
def parity(spark, d):
    """Squared lengths computed row by row and summed in another order agree; of others, put wrong in one label, all are caught."""
    from featlake.operators.similarity import dot

    e = V.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    own = e.select("vec_id", "label", dot(F.col("embedding"), F.col("embedding")).alias("a"))
    long = e.select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("b"))
    off = lambda a: F.count_if(F.abs(a - F.col("b")) > 1e-5)
    return own.join(long, "vec_id").agg(F.count("*").alias("checked"), off(F.col("a")).alias("outside"), off(F.col("a") + F.when(F.col("label") == 7, 0.001).otherwise(0.0)).alias("caught"))
