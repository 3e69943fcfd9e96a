"""As-of and interval joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """left with the latest `value` of right (same `by`) at or before its time, null if there is none.

    Both sides are laid on one time line and the value is carried forward in a window: one shuffle by key and no
    pairs. Equal times count as before; of equal times of right the greatest value stands.
    """
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.groupBy(*by, ts).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    line = b.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = line.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, value)


#: Widths of buckets grow by this from level to level, and a bucket's rows are split in so many.
GROWTH, SALTS = 8.0, 8


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, width: float) -> DataFrame:
    """Pairs of a point and a span [start, stop) that holds it, as an equi-join on buckets.

    Buckets of `width` are for spans up to that long, those of each further level GROWTH times as wide, so that a span
    of any length is laid in GROWTH + 1 buckets at most; a point is laid in one bucket of each level that there is.
    Points are dealt over SALTS parts of a bucket and spans to all of them, as many points may share one.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log((F.col(stop) - F.col(start)) / width) / math.log(GROWTH))).cast("int")
    held = spans.filter(F.col(stop) > F.col(start)).withColumn("__level", F.coalesce(level, F.lit(0)))
    wide = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(GROWTH), F.col("__level"))))
    laid = held.withColumn("__b", F.explode(F.sequence(wide(start), wide(stop)))).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    levels = [r[0] for r in held.select("__level").distinct().collect()]  # some hundred at most, by the range of a double
    p = points.withColumn("__level", F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>"))).withColumn("__b", wide(at))
    p = p.withColumn("__salt", F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int"))
    met = p.join(laid, ["__level", "__b", "__salt"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop)))
    return met.drop("__level", "__b", "__salt")
