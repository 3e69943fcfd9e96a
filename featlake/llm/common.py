"""What the operators of this subpackage share: tables, staging, folds, ragged byte buffers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from featlake.sources.files import freeing, parts_for, shared_dir, stage

__all__ = ["bounded_sample", "columns", "crops", "fold", "freeing", "held_out", "map_batches", "parts_for", "replaced", "shared_dir", "slabs", "stage", "string_buffers", "table", "text_files", "unused"]

#: One row of each stratum is broadcast up to this many strata, and joined by a shuffle beyond.
MOST_STRATA = 10_000
#: ASCII white space of the word contracts: x20 and x09 to x0D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch: what a Python worker holds of whole texts at a time, one row at least.
ARROW_ROWS, ARROW_BYTES = 2000, 1 << 24


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of at most ARROW_ROWS rows and about ARROW_BYTES bytes.

    Batches have the columns by position, named c0 and so on, as Spark's own takes no name with a dot or backtick. The bounds are settings of the session, which Spark reads when the rows are computed; lower ones stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < _bytes(conf.get(name)) <= most:
            conf.set(name, str(most))
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def _bytes(setting: str) -> int:
    """A setting's number, whatever unit it is given in: 0 where that is not a plain number."""
    return int(setting) if setting.lstrip("-").isdigit() else 0


def columns(df: DataFrame) -> list[Column]:
    """All columns by their exact names, dots and backticks included."""
    return [F.col(quoted(c)) for c in df.columns]


#: Documents for each task and file of a stage that reads texts; fewer, larger partitions of the input stay as they are.
TEXTS_EACH = 2000


def text_files(documents: DataFrame) -> int:
    """The most files of a stage over documents."""
    return parts_for(documents.count(), TEXTS_EACH)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as make it unlike all columns of df, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replaced(df: DataFrame, documents: DataFrame, text: Column) -> DataFrame:
    """The columns of documents out of df, with text in place of theirs and n_chars, if there, set to its length."""
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length(F.coalesce(text, F.lit(""))).cast(documents.schema["n_chars"].dataType)
    return df.select(*(new[c].alias(c) if c in new else F.col(quoted(c)) for c in documents.columns))


def crops(text: Column, key: Column, most: int) -> Column:
    """At most `most` code points of text, cut at a place that a hash of key gives: what may be sent to the driver."""
    room = F.greatest(F.lit(0), F.length(text) - most)
    return F.substr(text, (F.pmod(F.xxhash64(key), room + 1) + 1).cast("int"), F.lit(most))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4


def held_out() -> Column:
    return (fold() == 2).alias("held_out")


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slabs(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of documents of at most about `most` bytes each; a longer document stands alone."""
    out, first = [], 0
    n = len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def bounded_sample(df: DataFrame, key: str, strata: str, per_stratum: int) -> DataFrame:
    """At most per_stratum rows of each value of strata, those with the least hash of key: the same rows on every run.

    Counts by the hash's first 12 bits show below which of these a stratum has enough rows, so that only about those
    rows are moved and ranked.
    """
    from pyspark.sql import Window

    hashed = df.withColumn("_h", F.xxhash64(F.col(key))).withColumn("_b", F.expr("shiftrightunsigned(_h, 52)"))
    counts = hashed.groupBy(strata, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    enough = counts.withColumn("_c", F.coalesce(before, F.lit(0))).filter(F.col("_c") < per_stratum).groupBy(strata).agg(F.max("_b").alias("_last"))
    few = enough.limit(MOST_STRATA + 1).count() <= MOST_STRATA
    some = hashed.join(F.broadcast(enough) if few else enough, strata).filter("_b <= _last")
    w = Window.partitionBy(strata).orderBy("_b", "_h", key)
    return some.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_stratum).drop("_r", "_h", "_b", "_last")
