"""Threshold probes: for each category the feature and threshold of best F1 on training rows, judged on held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(2.0 * tp, 2.0 * tp + fp + fn)


def check_split(rows: DataFrame) -> None:
    """An error unless both train and test rows are there."""
    n = rows.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "test")).first()
    if not all(n):
        raise ValueError("train and test rows are both needed")


def curves(acts: DataFrame, member: DataFrame, train: DataFrame) -> DataFrame:
    """(category, feature, threshold, tp, predicted, positives) at each distinct value of a feature among training rows.

    acts (row_id, feature, value), member (row_id, category), train (row_id). Equal values count as one run. Values
    and hits are aggregated before they are ordered, so a window holds distinct values and not rows.
    """
    a = acts.join(train, "row_id", "left_semi")
    m = member.join(train, "row_id", "left_semi")
    positives = m.groupBy("category").agg(F.count("*").alias("positives"))
    hits = a.join(m, "row_id").groupBy("category", "feature", "value").agg(F.count("*").alias("hit"))
    every = a.groupBy("feature", "value").agg(F.count("*").alias("n"))
    total = every.withColumn("predicted", F.sum("n").over(Window.partitionBy("feature").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)))
    # between two hits of a category F1 only falls as the threshold does, so thresholds at its own hits suffice
    tp = F.sum("hit").over(Window.partitionBy("category", "feature").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    out = hits.withColumn("tp", tp).join(total.select("feature", "value", "predicted"), ["feature", "value"])
    return out.join(positives, "category").select("category", "feature", F.col("value").alias("threshold"), "tp", "predicted", "positives")


def select(acts: DataFrame, member: DataFrame, train: DataFrame, min_tp: int = 1) -> DataFrame:
    """The best probe of each category: F1, then more TP, fewer FP, smaller feature, larger threshold.

    F1 is compared as an exact fraction of integers by way of a double of 2 tp / (predicted + positives), which equal
    fractions share.
    """
    c = curves(acts, member, train).filter(F.col("tp") >= min_tp)
    c = c.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("positives") - F.col("tp"), "f1": 2.0 * F.col("tp") / (F.col("predicted") + F.col("positives"))})
    w = Window.partitionBy("category").orderBy(F.desc("f1"), F.desc("tp"), "fp", "feature", F.desc("threshold"))
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "predicted")


def evaluate(probes: DataFrame, acts: DataFrame, member: DataFrame, rows: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1 of each probe (category, feature, threshold) on rows (row_id)."""
    a = acts.join(rows, "row_id", "left_semi")
    m = member.join(rows, "row_id", "left_semi")
    p = probes.select("category", "feature", "threshold")
    fired = a.join(p, "feature").filter(F.col("value") >= F.col("threshold")).select("category", "row_id")
    positives = m.groupBy("category").agg(F.count("*").alias("positives"))
    predicted = fired.groupBy("category").agg(F.count("*").alias("predicted"))
    tp = fired.join(m, ["category", "row_id"], "left_semi").groupBy("category").agg(F.count("*").alias("tp"))
    n = rows.agg(F.count("*").alias("rows"))
    out = p.join(positives, "category", "left").join(predicted, "category", "left").join(tp, "category", "left").fillna(0).join(F.broadcast(n))  # n is one row
    out = out.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("positives") - F.col("tp")})
    out = out.withColumn("tn", F.col("rows") - F.col("tp") - F.col("fp") - F.col("fn"))
    t, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("category", "feature", "threshold", "tp", "fp", "fn", "tn", safe_ratio(t * 1.0, t + fp).alias("precision"), safe_ratio(t * 1.0, t + fn).alias("recall"), f1(t, fp, fn).alias("f1"))


def fixed_threshold_best(acts: DataFrame, member: DataFrame, thresholds: list[float]) -> DataFrame:
    """(category, feature, threshold, f1): for every pair the best of given thresholds, compared strictly."""
    t = F.explode(F.array(*(F.lit(x) for x in thresholds)))
    fired = acts.withColumn("threshold", t).filter(F.col("value") > F.col("threshold").cast("float"))
    predicted = fired.groupBy("feature", "threshold").agg(F.count("*").alias("predicted"))
    tp = fired.join(member, "row_id").groupBy("category", "feature", "threshold").agg(F.count("*").alias("tp"))
    positives = member.groupBy("category").agg(F.count("*").alias("positives"))
    c = tp.join(predicted, ["feature", "threshold"]).join(positives, "category").withColumn("f1", 2.0 * F.col("tp") / (F.col("predicted") + F.col("positives")))
    w = Window.partitionBy("category", "feature").orderBy(F.desc("f1"), "threshold")
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("category", "feature", "threshold", "f1")


def passes(tp: Column, fp: Column, fn: Column, num: int, den: int, strict: bool = False) -> Column:
    """Whether F1 reaches num / den, in integers."""
    left, right = 2 * tp * den, num * (2 * tp + fp + fn)
    return left > right if strict else left >= right
