"""Places, running sums and quantiles over whole tables: by range partitions, never in one sorted task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.sources.files import stage

_ROW, _PART, _BEFORE, _START = "__row", "__part", "__before", "__start"


def _sorted_parts(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows in disjoint ascending ranges, written once so that places stay, each with its part and its row there."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_ROW, F.monotonically_increasing_id())
    laid = stage(laid, "ranges")
    return laid.withColumn(_PART, F.shiftright(_ROW, 33)).withColumn(_ROW, F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1)))


def _before(parts: DataFrame, amount: Column) -> DataFrame:
    """(part, what stands in parts before it): one row for each range partition, a number that the session fixes."""
    sums = parts.groupBy(_PART).agg(F.sum(amount).alias(_BEFORE))
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select(_PART, F.coalesce(F.sum(_BEFORE).over(w), F.lit(0)).alias(_BEFORE)))


def _columns(by: list[str], order: list[Column]) -> list[Column]:
    return [*(F.col(c).asc() for c in by), *order]


def placed(rows: DataFrame, order: list[Column], name: str = "place", by: list[str] | None = None) -> DataFrame:
    """rows with their place from 0 by `order`, in each group of `by` (no nulls) where that is given; order must tell rows apart."""
    by = by or []
    parts = _sorted_parts(rows, _columns(by, order))
    out = parts.join(_before(parts, F.lit(1)), _PART).withColumn(name, F.col(_BEFORE) + F.col(_ROW)).drop(_PART, _ROW, _BEFORE)
    if by:
        starts = out.groupBy(*by).agg(F.min(name).alias(_START))
        out = out.join(starts, by).withColumn(name, F.col(name) - F.col(_START)).drop(_START)
    return out.select(*rows.columns, name)


def running(rows: DataFrame, order: list[Column], amount: str, name: str = "before", by: list[str] | None = None) -> DataFrame:
    """rows with the sum of `amount` over all rows before them by `order`, in each group of `by`."""
    by = by or []
    parts = _sorted_parts(rows, _columns(by, order))
    w = Window.partitionBy(_PART).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0))).join(_before(parts, F.col(amount)), _PART)
    out = out.withColumn(name, F.col(name) + F.col(_BEFORE)).drop(_PART, _ROW, _BEFORE)
    if by:
        starts = out.groupBy(*by).agg(F.min(name).alias(_START))
        out = out.join(starts, by).withColumn(name, F.col(name) - F.col(_START)).drop(_START)
    return out.select(*rows.columns, name)


def quantiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles (linear between the two values beside a point) by name, in each group of `by`; nulls do not count.

    Values are counted, the counts summed in order over range partitions, and the values at the wanted ranks picked.
    Without values there is no row of a group, and one row of nulls without `by`.
    """
    by = by or []
    v = F.col(value).cast("double")
    counts = df.select(*by, v.alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count("*").alias("m"))
    laid = running(counts, [F.col("v").asc()], "m", by=by)
    totals = counts.groupBy(*by).agg(F.sum("m").alias("n"))
    both = laid.join(totals, by) if by else laid.join(F.broadcast(totals))  # one row

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("m")), F.col("v")))

    def pick(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        share = F.max(place - low)
        return at(low) * (1 - share) + F.when(share > 0, at(high) * share).otherwise(0.0)

    found = both.groupBy(*by).agg(*(pick(p).alias(n) for n, p in points.items()))
    return found


def at_ranks(values: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at given ranks (from 0) in ascending order; only these reach the driver."""
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m"))
    laid = running(counts, [F.col("v").asc()], "m")
    row = laid.agg(*(F.max(F.when((F.col("before") <= r) & (F.lit(r) < F.col("before") + F.col("m")), F.col("v"))).alias(f"r{k}") for k, r in enumerate(ranks))).first()
    return [math.nan if x is None else x for x in row]
