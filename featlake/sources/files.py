"""Files: staging in the shared folder, delimited text, JSON lines, archives, manifests and bundles."""

from __future__ import annotations

import contextlib
import io
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = getattr(spark, "_featlake_files", None)
    if here is None:
        here = spark._featlake_files = tempfile.mkdtemp(prefix="featlake-")
        weakref.finalize(spark, shutil.rmtree, here, True)
    return f"file://{here}"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/featlake/{uuid.uuid4().hex}/{name}"


#: Shuffle files of a query go as it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside free their shuffles as they end; the session's setting is put back."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)


def stage(df: DataFrame, name: str, files: int | None = None, path: str | None = None, order: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again; cuts the lineage and frees the shuffles before it.

    files: the most files (and tasks) of small results, from parts_for(); order: a column by which each file is sorted.
    """
    spark, path = df.sparkSession, path or fresh(df.sparkSession, name)
    rows = df if files is None else df.coalesce(files)
    rows = rows if order is None else rows.sortWithinPartitions(order)
    with freeing(spark):
        rows.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(rows: int, each: int = 250_000, least: int = 24) -> int:
    """Files for a known number of rows: `each` rows a file, but not under `least` files, so that small results have tasks too."""
    return max(least, -(-rows // each))


def children(spark: SparkSession, folder: str, pattern: str = "[!_.]*") -> list[str]:
    """Names in a folder that hold whole results of Spark's (with their mark of success), sorted; none if it is not there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}/_SUCCESS"))
    return sorted(f.getPath().getParent().getName() for f in found or [])


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", comment: str | None = None) -> DataFrame:
    """Delimited text with a header, all columns strings; quoted line breaks and doubled quotes are data.

    columns: those that must be there; a missing one is an error.
    """
    options = {"header": True, "sep": sep, "multiLine": True, "escape": '"', "inferSchema": False} | ({"comment": comment} if comment else {})
    df = spark.read.options(**options).csv(path)
    missing = set(columns or ()) - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return df


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(header=True, sep=sep, escape='"', quoteAll=True).csv(path)


def union_of_schemas(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts with the union of their columns; a missing one is blank. Rows carry their path, in whose order parts come."""
    frames = [df.withColumn("path", F.lit(p)) for p, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).fillna("")


def discover(spark: SparkSession, root: str, **only: str) -> DataFrame:
    """A hive-partitioned tree under root; filters on partition columns prune folders."""
    df = spark.read.option("basePath", root).parquet(root)
    for k, v in only.items():
        df = df.filter(F.col(k) == v)
    return df


def write_sorted(df: DataFrame, path: str, key: str, parts: int) -> None:
    """Parts in disjoint ascending ranges of key, sorted inside: footers then prune point and range reads."""
    df.repartitionByRange(parts, key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)


def read_zipped(spark: SparkSession, path: str, member: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A delimited member of each ZIP file under path, as strings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as m:
                    for part in pd.read_csv(m, sep=sep, dtype=str, keep_default_na=False, chunksize=50_000, quoting=3):
                        yield part[columns]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, strings(columns))


def incomplete(expected: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Expected units of work without a completion marker."""
    return expected.join(markers.select(key), key, "left_anti")


#: A safe relative path: no empty, `.` or `..` step, no leading slash, no backslash.
UNSAFE = r"(^$)|(^/)|(\\)|(//)|((^|/)\.\.?(/|$))|(/$)"


def safe_path(path: Column) -> Column:
    return ~F.rlike(path, F.lit(UNSAFE))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, sha256) of every file under root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_bundle(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem): missing, unlisted, changed, listed twice or unsafe members of a bundle."""
    m = manifest.select("name", F.col("bytes").alias("mb"), F.col("sha256").alias("ms"))
    both = m.join(found, "name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("ms").isNull(), "unlisted").when((F.col("mb") != F.col("bytes")) | (F.col("ms") != F.col("sha256")), "changed")
    twice = m.groupBy("name").count().filter("count > 1").select("name", F.lit("listed twice").alias("problem"))
    unsafe = m.filter(~safe_path(F.col("name"))).select("name", F.lit("unsafe").alias("problem"))
    return both.select("name", problem.alias("problem")).filter("problem is not null").distinct().unionAll(twice).unionAll(unsafe)
