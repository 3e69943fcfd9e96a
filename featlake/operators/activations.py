"""Sparse activations in long form (row_id, feature, value): encoding and statistics.

A missing entry is a zero: rates, moments and medians count the rows and features that hold no entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.order import at_ranks, quantiles


def long_form(vectors: DataFrame, row: str, vector: str) -> DataFrame:
    """(row_id, feature, value) of the positive components of a vector column."""
    exploded = vectors.select(F.col(row).alias("row_id"), F.posexplode(vector).alias("feature", "value"))
    return exploded.filter(F.col("value") > 0)


def from_fixed(fixed: DataFrame) -> DataFrame:
    """Long form of fixed-size rows (row_id, acts of feature and value); zeros are padding."""
    return fixed.select("row_id", F.inline("acts")).filter(F.col("value") > 0)


def to_fixed(acts: DataFrame, k: int) -> DataFrame:
    """(row_id, acts): the k largest of each row by value, smaller feature first among equals."""
    top = top_per_row(acts, k).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "value"))).alias("a"))
    return top.select("row_id", F.transform("a", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))).alias("acts"))


def top_per_row(acts: DataFrame, k: int) -> DataFrame:
    """The k largest entries of each row with their rank; the smaller feature wins a tie."""
    w = Window.partitionBy("row_id").orderBy(F.desc("value"), "feature")
    return acts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_per_batch(acts: DataFrame, batch: Column, k: int, size: int) -> DataFrame:
    """The k * size largest entries of each batch of rows."""
    w = Window.partitionBy("batch").orderBy(F.desc("value"), "row_id", "feature")
    return acts.withColumn("batch", batch).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k * size)


def rank_in_row(acts: DataFrame) -> DataFrame:
    """Each entry's rank within its row by value; equals share a rank."""
    return acts.withColumn("rank", F.rank().over(Window.partitionBy("row_id").orderBy(F.desc("value"))))


def encode(vectors: DataFrame, row: str, vector: str, enc: np.ndarray, bias: np.ndarray, k: int) -> DataFrame:
    """Top-k of relu((x - bias) @ enc) in long form, zeros dropped, smaller feature first among equals.

    enc (dim x width) and bias travel with the task: a model of fixed size. Rows are projected in Arrow batches.
    """
    enc32, bias32 = enc.astype(np.float32), bias.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float32)
            a = np.maximum((x - bias32) @ enc32, 0)
            top = np.argsort(-a, axis=1, kind="stable")[:, :k]
            v = np.take_along_axis(a, top, 1)
            keep = v > 0
            at = np.repeat(np.arange(n), keep.sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(top[keep].astype(np.int32)), pa.array(v[keep])], ["row_id", "feature", "value"])

    return vectors.select(F.col(row).cast("long").alias("row_id"), F.col(vector).cast("array<float>").alias("x")).mapInArrow(run, "row_id long, feature int, value float")


def project(vectors: DataFrame, row: str, vector: str, dictionary: DataFrame, k: int) -> DataFrame:
    """The relational form of encode for small dictionaries (feature, enc): products as sums over a join on position."""
    x = vectors.select(F.col(row).alias("row_id"), F.posexplode(vector).alias("i", "x"))
    e = dictionary.select("feature", F.posexplode("enc").alias("i", "w"))
    dots = x.join(e, "i").groupBy("row_id", "feature").agg(F.sum(F.col("x").cast("double") * F.col("w").cast("double")).alias("value"))
    return top_per_row(dots.filter(F.col("value") > 0), k)


def reconstruct(acts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(row_id, i, x): sums of value times decoder vectors (feature, dec)."""
    d = dictionary.select("feature", F.posexplode("dec").alias("i", "w"))
    return acts.join(d, "feature").groupBy("row_id", "i").agg(F.sum(F.col("value").cast("double") * F.col("w").cast("double")).alias("x"))


def feature_stats(acts: DataFrame, features: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.01, 0.05)) -> DataFrame:
    """Counts above the thresholds, sum, sum of squares and largest value of every feature, with zeros for none."""
    v = F.col("value").cast("double")
    counts = [F.count_if(F.col("value") > F.lit(t).cast("float")).alias(f"c{i}") for i, t in enumerate(thresholds)]
    found = acts.groupBy("feature").agg(*counts, F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.max("value").cast("double").alias("largest"))
    out = features.join(found, "feature", "left")
    return out.fillna(0).select("feature", *(f"c{i}" for i in range(len(thresholds))), "s1", "s2", "largest")


def feature_summary(stats: DataFrame, n_rows: Column) -> DataFrame:
    """Rate, mean and population deviation with zeros, mean and deviation of positive values (null for dead features)."""
    n, c = n_rows.cast("double"), F.col("c0").cast("double")
    spread = lambda m: F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / m - (F.col("s1") / m) * (F.col("s1") / m)))
    live = F.col("c0") > 0
    return stats.select(
        "feature", (c / n).alias("rate"), (F.col("s1") / n).alias("mean"), spread(n).alias("std"), F.when(live, F.col("s1") / c).alias("positive_mean"), F.when(live, spread(c)).alias("positive_std"), (~live).cast("int").alias("dead")
    )


def row_stats(acts: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries and their sum for every row, zeros included."""
    found = acts.groupBy("row_id").agg(F.count("*").alias("l0"), F.sum(F.col("value").cast("double")).alias("l1"))
    return rows.select("row_id").join(found, "row_id", "left").fillna(0)


def describe(df: DataFrame, column: str, points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Mean, deviation (population), least, percentiles (linear) and largest of a column."""
    c = F.col(column).cast("double")
    found = quantiles(df, column, {f"p{round(100 * p)}": p for p in points})
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("largest")).join(found).select("mean", "std", "least", *found.columns, "largest")  # one row each


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, n) for left-closed bins, the last one closed; empty bins have 0."""
    c = F.col(column)
    bin_ = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        bin_ = F.when((c >= a) & ((c < b) if i < len(edges) - 2 else (c <= b)), i).otherwise(bin_)
    counts = df.select(bin_.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").fillna(0)


def moments(acts: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, s1, s2, support)."""
    s = feature_stats(acts, features, (0.0,))
    return s.select("feature", "s1", "s2", F.col("c0").alias("support"))


def subtract_moments(full: DataFrame, part: DataFrame) -> DataFrame:
    """Moments of what is in full and not in part; a feature without support left is all zero."""
    p = part.select("feature", *(F.col(c).alias(f"p_{c}") for c in ("s1", "s2", "support")))
    left = full.join(p, "feature", "left").fillna(0)
    rest = F.col("support") - F.col("p_support")
    return left.select("feature", *(F.when(rest > 0, F.col(c) - F.col(f"p_{c}")).otherwise(F.lit(0.0)).alias(c) for c in ("s1", "s2")), rest.alias("support"))


def pooled_median(acts: DataFrame) -> DataFrame:
    """The exact median of all positive values; an even count gives the midpoint."""
    return acts.agg(F.count("*").alias("n")).join(quantiles(acts, "value", {"median": 0.5}))  # one row each


#: Rows that bracket a median, those of least hash.
CALIBRATION = 10_000


def pooled_median_bracketed(acts: DataFrame, sample: int = CALIBRATION) -> DataFrame:
    """The same median in two passes: a bracket from a bounded sample, then exact ranks inside it alone.

    Only the values inside are counted and ordered. Should the sample mislead, so that the ranks lie outside, the
    bracket is widened to all values.
    """
    v = F.col("value").cast("double")
    n = acts.count()
    if not n:
        return acts.agg(F.count("*").alias("n"), F.max(v).alias("median"))
    ranks = [(n - 1) // 2, n // 2]
    some = [r[0] for r in acts.select(v.alias("v"), F.xxhash64("row_id", "feature").alias("h")).orderBy("h", "v").limit(sample).select("v").collect()]
    some.sort()
    reach = 3 * math.isqrt(len(some)) + 1
    low, high = some[max(0, len(some) // 2 - reach)], some[min(len(some) - 1, len(some) // 2 + reach)]
    below, upto = acts.agg(F.count_if(v < low), F.count_if(v <= high)).first()
    if not below <= ranks[0] <= ranks[1] < upto:
        low, high, below = -math.inf, math.inf, 0
    a, b = at_ranks(acts.select(v.alias("v")).filter((v >= low) & (v <= high)), "v", [r - below for r in ranks])
    return acts.sparkSession.createDataFrame([(n, (a + b) / 2)], "n long, median double")


def counts_above(acts: DataFrame, level: Column, *by: str) -> DataFrame:
    return acts.filter(F.col("value").cast("double") > level).groupBy(*by).agg(F.count("*").alias("n"))


def last_active(acts: DataFrame, batch: Column, features: DataFrame, last: int) -> DataFrame:
    """Batches since each feature was last active, at batch `last`; one never seen has all of them."""
    seen = acts.groupBy("feature").agg(F.max(batch).alias("b"))
    return features.join(seen, "feature", "left").select("feature", (F.lit(last) - F.coalesce("b", F.lit(-1))).cast("long").alias("inactive"))


def cross_lookup(rows: DataFrame, acts: DataFrame) -> DataFrame:
    """The value of (row_id, feature) pairs, zero where there is no entry."""
    return rows.join(acts, ["row_id", "feature"], "left").fillna(0, ["value"])


def selective(acts: DataFrame, feature: int, own: float, other: float) -> DataFrame:
    """Rows in which a feature has at least `own` and every other one at most `other`."""
    mine = F.max(F.when(F.col("feature") == feature, F.col("value").cast("double")))
    rest = F.coalesce(F.max(F.when(F.col("feature") != feature, F.col("value").cast("double"))), F.lit(0.0))
    return acts.groupBy("row_id").agg(mine.alias("own"), rest.alias("rest")).filter((F.col("own") >= own) & (F.col("rest") <= other))
