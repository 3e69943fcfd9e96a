"""Incremental operators in Structured Streaming. Each equals its batch form once all input has arrived."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from featlake.sources.files import children, fresh, remove


def read_files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder, new ones as they appear, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def moments(stream: DataFrame, key: str, value: Column) -> DataFrame:
    """Mergeable counts and moments by key."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("s1"), F.sum(value * value).alias("s2"), F.max(value).alias("largest"))


def windowed(stream: DataFrame, ts: str, width: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows, behind a watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *by: str) -> DataFrame:
    """Counts in sessions that a gap ends."""
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), "n")


def last_seen(stream: DataFrame, key: str, at: str) -> DataFrame:
    """(key, last, n): the largest `at` of each key so far, by a stateful operator."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (-1, 0)
        for f in frames:
            last, n = max(last, int(f[at].max())), n + len(f)
        state.update((last, n))
        yield pd.DataFrame({"key": [k[0]], "last": [last], "n": [n]})

    return stream.select(F.col(key).cast("string").alias(key), F.col(at).cast("long").alias(at)).groupBy(key).applyInPandasWithState(step, "key string, last long, n long", "last long, n long", "update", GroupStateTimeout.NoTimeout)


def _version(path: str, number: int) -> str:
    return f"{path}/v{number:09d}"


def _run(stream: DataFrame, path: str, step: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None) -> None:
    at = checkpoint or f"{path}/_checkpoint"
    stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All that a stream gives for the input there is, as a table in the shared folder.

    With a path the checkpoint stands beside the results, so that a later call goes on where this one ended. In mode
    `complete` the last batch is the result, else all batches are, rows that later ones bring up to date included.
    """
    spark = stream.sparkSession
    path = path or fresh(spark, "drained")
    _run(stream, path, lambda batch, number: batch.write.mode("overwrite").parquet(_version(path, number)), mode, checkpoint)
    done = children(spark, path)
    some = done[-1:] if mode == "complete" else done
    return spark.read.schema(stream.schema).parquet(*(f"{path}/{n}" for n in some)) if some else spark.createDataFrame([], stream.schema)


def merge_batches(stream: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str | None = None) -> str:
    """Fold micro-batches into a table: merge(batch, table so far). Gives the last version's folder.

    Each version is a folder named by its batch, made from the version of the batch before; a batch that is run again
    replaces only its own. The checkpoint stands in the table's folder, so that after a restart the same call goes on
    from the last version. Versions older than the one before the last are removed.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = [n for n in children(spark, path) if f"{path}/{n}" < _version(path, number)]
        so_far = spark.read.parquet(f"{path}/{before[-1]}") if before else None
        merge(batch, so_far).write.mode("overwrite").parquet(_version(path, number))
        for n in before[:-1]:
            remove(spark, f"{path}/{n}")

    _run(stream, path, step, "append", checkpoint)
    done = children(spark, path)
    if not done:
        raise ValueError(f"{path} has had no batch yet")
    return f"{path}/{done[-1]}"
