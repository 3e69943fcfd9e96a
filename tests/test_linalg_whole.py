"""Sparse reconstruction covers every vector of the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featlake.plans import registry

registry.load()
DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["L14_matching_pursuit", "L15_required_histogram"])
def test_all_vectors_are_reconstructed(spark, name):
    found, n = registry.QUERIES[name](spark, DATA), spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert n > 200 and (found.count() if name.startswith("L14") else found.agg(F.sum("n")).first()[0]) == n
