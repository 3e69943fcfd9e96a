"""Data-quality checks: each gives the rows that break its rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(shards: DataFrame, order: str, rows: str = "rows") -> DataFrame:
    """Shards (one row a file, a list that one task can order) with contiguous offsets: start and stop by a running sum."""
    w = Window.orderBy(order)
    stop = F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return shards.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col(rows))


def broken_offsets(shards: DataFrame, order: str) -> DataFrame:
    """Shards that do not start where the one before stops, or whose rows are not their span."""
    before = F.coalesce(F.lag("stop").over(Window.orderBy(order)), F.lit(0))
    return shards.withColumn("before", before).filter((F.col("start") != F.col("before")) | (F.col("stop") - F.col("start") != F.col("rows")))


def shard_of(rows: DataFrame, shards: DataFrame, row: str) -> DataFrame:
    """rows with the shard whose [start, stop) holds them; the shard map is a list of files and is broadcast when small."""
    small = shards.limit(100_001).count() <= 100_000
    s = F.broadcast(shards) if small else shards
    return rows.join(s, (F.col(row) >= F.col("start")) & (F.col(row) < F.col("stop")))


def duplicate_entries(acts: DataFrame) -> DataFrame:
    return acts.filter("value > 0").groupBy("row_id", "feature").agg(F.count("*").alias("n")).filter("n > 1")


def payload_faults(acts: DataFrame, k: int, width: int) -> DataFrame:
    """(row_id, problem): rows of more than k entries, features out of range, values not finite or negative."""
    many = acts.groupBy("row_id").agg(F.count("*").alias("n")).filter(F.col("n") > k).select("row_id", F.lit("too many").alias("problem"))
    v = F.col("value")
    bad = F.when(~F.col("feature").between(0, width - 1), "range").when(F.isnan(v) | v.isNull() | (v < 0) | (v == float("inf")), "value")
    return many.unionAll(acts.withColumn("problem", bad).filter("problem is not null").select("row_id", "problem"))


def misaligned(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that one side lacks or whose columns differ."""
    x, y = (t.select(key, F.struct(*columns).alias(n)) for t, n in ((a, "x"), (b, "y")))
    return x.join(y, key, "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select(key)


def compare(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose values differ by more than tolerance, or that one side lacks."""
    x, y = a.select(*key, F.col(value).alias("x")), b.select(*key, F.col(value).alias("y"))
    d = F.abs(F.col("x") - F.col("y")) > tolerance
    return x.join(y, key, "full_outer").filter(F.col("x").isNull() | F.col("y").isNull() | d)


def expectations(values: dict[str, tuple[Column, float, float]], df: DataFrame) -> DataFrame:
    """(name, actual, ok): aggregates against expected values with tolerances, in one pass."""
    one = df.agg(*(c.cast("double").alias(n) for n, (c, _, _) in values.items()))
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).alias("actual"), (F.abs(F.col(n) - e) <= t).cast("int").alias("ok")) for n, (_, e, t) in values.items()]
    return one.select(F.inline(F.array(*rows)))


def falling(counts: list[str], n: int) -> Column:
    """Whether counts at rising thresholds are out of order or above the number of rows."""
    bad = F.col(counts[0]) > n
    for a, b in zip(counts, counts[1:], strict=False):
        bad = bad | (F.col(b) > F.col(a))
    return bad


def completeness(df: DataFrame, key: str, n: int) -> DataFrame:
    """Whether keys are exactly 0 to n - 1, each once."""
    return df.agg((F.count("*") == n).cast("int").alias("count_ok"), (F.countDistinct(key) == n).cast("int").alias("unique_ok"), ((F.min(key) == 0) & (F.max(key) == n - 1)).cast("int").alias("range_ok"))


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one side only, by side."""
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionAll(found.exceptAll(expected).withColumn("side", F.lit("extra")))


def compatible_prefix(budgets: DataFrame, recorded: DataFrame, volatile: list[str]) -> DataFrame:
    """(config, upto): of recorded milestones with the same configuration but for volatile keys, the longest unbroken run."""
    keys = [c for c in budgets.columns if c not in (*volatile, "budget", "n")]
    digest = F.sha2(F.to_json(F.struct(*sorted(keys))).cast("binary"), 256)
    want = budgets.withColumn("config", digest).select("config", "budget", "n")
    have = recorded.withColumn("config", digest).select("config", "budget").distinct().withColumn("there", F.lit(1))
    w = Window.partitionBy("config").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = want.join(have, ["config", "budget"], "left").withColumn("upto", F.sum(F.coalesce("there", F.lit(0))).over(w))
    return run.groupBy("config").agg(F.max(F.when(F.col("upto") == F.col("n"), F.col("n")).otherwise(0)).alias("upto"))
