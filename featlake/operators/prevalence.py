"""Rank statistics: AUC, effects, deciles, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.order import quantiles


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rank from 1 with ties averaged, in each group of `by`.

    Values are counted first and their counts summed in order, so a window holds distinct values and not rows.
    """
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = n.withColumn("rank", before + (F.col("_n") + 1) / 2.0).drop("_n")
    return df.join(ranks, [*by, value])


def auc(df: DataFrame, value: str, positive: str, by: list[str]) -> DataFrame:
    """Mann-Whitney AUC of a value for a 0/1 column in each group, null without both kinds."""
    r = average_ranks(df, value, by)
    g = r.groupBy(*by).agg(F.sum(F.col(positive).cast("long")).alias("n1"), F.sum(1 - F.col(positive).cast("long")).alias("n0"), F.sum(F.when(F.col(positive) == 1, F.col("rank")).otherwise(0.0)).alias("rs"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return g.withColumn("auc", F.when((n1 > 0) & (n0 > 0), (F.col("rs") - n1 * (n1 + 1) / 2) / (n1 * n0))).drop("rs")


def effect(df: DataFrame, value: str, positive: str) -> DataFrame:
    """Medians of the selected and of the others, and their ratio."""
    med = lambda k, n: quantiles(df.filter(F.col(positive) == k), value, {n: 0.5})
    return med(1, "selected").join(med(0, "others")).withColumn("ratio", F.when(F.col("others") != 0, F.col("selected") / F.col("others")))


def quantile_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """A bin column, 0 to n - 1, by the linear quantiles of the value; a value on a cut goes to the upper bin."""
    v = F.col(value).cast("double")
    cuts = quantiles(df, value, {f"_c{i}": i / n for i in range(1, n)})
    out = df.join(F.broadcast(cuts))  # one row
    return out.withColumn("bin", sum(((v >= F.col(f"_c{i}")).cast("int") for i in range(1, n)), F.lit(0))).drop(*(f"_c{i}" for i in range(1, n)))


def curve(binned: DataFrame, value: str, positive: str) -> DataFrame:
    g = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("selected"))
    return g.join(quantiles(binned, value, {"median": 0.5}, ["bin"]), "bin").withColumn("rate", F.col("selected") / F.col("n"))


def conditional_auc(binned: DataFrame, value: str, positive: str) -> DataFrame:
    """AUC inside bins, weighted by positives times negatives."""
    a = auc(binned, value, positive, ["bin"]).filter("auc is not null")
    w = F.col("n1") * F.col("n0")
    return a.agg((F.sum(F.col("auc") * w) / F.sum(w)).alias("auc"))


def log_density(values: DataFrame, value: str, bandwidth: float = 0.12, points: int = 600, low: float = -6.0, high: float = 0.0) -> DataFrame:
    """(x, density): a Gaussian kernel over log10 of positive values on a grid, scaled by their count.

    Equal values are counted first; the grid is of fixed size and joined to each distinct value.
    """
    v = values.filter(F.col(value) > 0).groupBy(F.log10(F.col(value).cast("double")).alias("v")).agg(F.count("*").alias("m"))
    step = (high - low) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.lit(low) + i * F.lit(step)).alias("x")))
    z = (F.col("x") - F.col("v")) / F.lit(bandwidth)
    return v.select("v", "m", F.inline(grid)).groupBy("i", "x").agg((F.sum(F.exp(-0.5 * z * z) * F.col("m")) / (bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def histogram_percentile(value: Column, edges: list[float], counts: list[int]) -> Column:
    """Share of a histogram's mass below a value, linear inside a bin."""
    total, done, out = float(sum(counts)), 0, F.lit(0.0)
    for a, b, n in zip(edges, edges[1:], counts, strict=False):
        out = F.when(value >= a, F.lit(done / total) + F.least(F.lit(1.0), (value - a) / (b - a)) * (n / total)).otherwise(out)
        done += n
    return out
