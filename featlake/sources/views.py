"""Canonical views over the tables: activations, splits, baskets, dictionaries; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.operators import activations, sampling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, feature, value): positive components of the embeddings."""
    return activations.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")


def features(spark: SparkSession, n: int = 64) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("feature"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, split): half of each label's rows for training, the odd one included."""
    return sampling.stratified_half(rows(spark, sf_dir), "row_id", "label", seed=1729)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, feature): distinct words of three letters or more of every document, and its language."""
    d = table(spark, sf_dir, "documents")
    w = d.select(F.col("doc_id").alias("row_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("feature"))
    return w.unionAll(d.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("lang:"), "lang").alias("feature")))


#: SQL of the views, as CTEs.
COMPONENTS = "comp AS (SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS feature, embedding[i] AS value FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t)"
ACTS = f"{COMPONENTS}, acts AS (SELECT * FROM comp WHERE value > 0)"
SPLIT = """split AS (SELECT row_id, label, CASE WHEN rn <= (n + 1) // 2 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT vec_id AS row_id, label, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY sha256('1729' || chr(0) || label || chr(0) || vec_id), vec_id) AS rn FROM embeddings))"""
WORDS = """baskets AS (SELECT DISTINCT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS feature FROM documents
  UNION ALL SELECT doc_id, 'lang:' || lang FROM documents)"""
DICTS = """vecs AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t),
cos AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
  / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""
