from pyspark.sql import functions as F

from featlake.sources.files import fresh
from featlake.streaming import streams as S


def test_stream_equals_batch_for_any_trigger(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("string").alias("k"), F.col("id").alias("v"))
    want = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    folder = fresh(spark, "stream")
    df.repartition(9).write.parquet(folder)
    for per in (1, 5):
        out = S.drain(S.moments(S.read_files(spark, folder, df.schema, per), "k", F.col("v")), "complete")
        assert {r["k"]: (r["n"], r["s1"]) for r in out.collect()} == want


def test_batch_that_is_run_again_replaces_its_version(spark):
    df = spark.range(40)
    folder = fresh(spark, "again")
    df.repartition(4).write.parquet(folder)
    merge = lambda b, old: b if old is None else b.unionByName(old)
    path = S.merge_batches(S.read_files(spark, folder, df.schema, 1), fresh(spark, "out"), merge)
    assert spark.read.parquet(path).distinct().count() == spark.read.parquet(path).count() == 40
