"""A corpus pipeline of five stages, each the operator of featlake.llm of that name.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Every stage but the last returns
the columns of `documents`; the last returns packed pieces. run() writes each stage's rows as Parquet in the shared
folder and rereads them, which also cuts the lineage.

Defined cases, beyond those of each operator: rows with null text count as empty and get the empty text's score; a
table without rows goes through as such; further columns keep their names and values through all stages but the last,
whatever they are called; rows that repeat an id, or id and text, go through each stage as rows of their own, except
that near_dedup keeps of equal or alike texts those rows whose id is the least; rows without an id are no one's
duplicates and stay there; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.llm import near_dup, packing, pii, quality, substring
from featlake.llm.common import stage, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 0.8 of their five-word shingles the document of the least doc_id stays.

    Candidates come by Golay-code keys of SimHashes, as in op2, and by MinHashes for those further apart; each is
    verified on whole sets of shingles.
    Rows that repeat a doc_id that stays stay too; documents without an id stay, as nothing tells which they are.
    """
    groups = near_dup.similar_groups(docs).filter("doc_id = group_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(groups, docs["doc_id"] == groups["_id"], "left_semi")
    return kept.unionAll(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("substring", substring_dedup), ("pii", redact), ("packing", pack)]

#: No stage can be written in SQL: trained models, Hamming components and tokenizers take part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
