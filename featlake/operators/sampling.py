"""Deterministic sampling: an order by hash stands in for random draws, so every run and layout agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.order import placed, running


def hash_order(seed: int, *keys: str | Column) -> Column:
    """Digest of seed and keys, joined by a zero character; hex order is digest order."""
    zero = F.lit("\0")
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts += [zero, (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def stratified_half(rows: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """A split column: half of each stratum is `train`, the odd row included, the rest `test`; null strata are one too."""
    first = rows.withColumns({"__s": F.coalesce(F.col(stratum).cast("string"), F.lit("\0")), "__h": hash_order(seed, stratum, key)})
    laid = placed(first, [F.col("__h").asc(), F.col(key).asc()], "__p", ["__s"])
    sizes = rows.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("__s")).agg(F.count("*").alias("__n"))
    out = laid.join(sizes, "__s").withColumn("split", F.when(F.col("__p") < F.floor((F.col("__n") + 1) / 2), "train").otherwise("test"))
    return out.select(*rows.columns, "split")


def half(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A split column: half of all rows, the odd one included, is `train`."""
    laid = placed(rows.withColumn("__h", hash_order(seed, key)), [F.col("__h").asc(), F.col(key).asc()], "__p")
    n = rows.count()
    return laid.withColumn("split", F.when(F.col("__p") < -(-n // 2), "train").otherwise("test")).select(*rows.columns, "split")


def fixed_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all, if fewer) without replacement."""
    return rows.orderBy(hash_order(seed, key), key).limit(n)


def largest_remainder(counts: DataFrame, stratum: str, total: int) -> DataFrame:
    """Sample sizes in proportion to counts (column n, one row a stratum) that sum to total; equal fractions go by stratum."""
    share = F.col("n") * F.lit(total) / F.sum("n").over(Window.partitionBy(F.lit(1)))
    base = counts.withColumn("share", share).withColumn("floor", F.floor("share").cast("long"))
    left = F.lit(total) - F.sum("floor").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("share") - F.col("floor"), 9)), stratum))
    return base.withColumn("left", left).withColumn("r", rank).select(stratum, "n", (F.col("floor") + (F.col("r") <= F.col("left")).cast("long")).alias("take"))


def proportional_sample(rows: DataFrame, key: str, stratum: str, total: int, seed: int) -> DataFrame:
    """A sample of total rows, each stratum (no nulls) in proportion to its size."""
    take = largest_remainder(rows.groupBy(stratum).agg(F.count("*").alias("n")), stratum, total).select(stratum, "take")
    laid = placed(rows.withColumn("__h", hash_order(seed, stratum, key)), [F.col("__h").asc(), F.col(key).asc()], "__p", [stratum])
    return laid.join(take, stratum).filter(F.col("__p") < F.col("take")).select(*rows.columns)


def shard_batches(rows: DataFrame, shard: str, row: str, draws: int, batch: int, seed: int) -> DataFrame:
    """(draw, shard, row, place): `draws` batches, each of `batch` neighbouring rows (all, if fewer) of a shard.

    Shards are drawn with a chance in proportion to their rows, with replacement, a batch's first row evenly among those
    that leave it whole, and its rows are shuffled; every draw follows from a hash, so that all runs agree. Shards'
    sizes and `draws` are lists of fixed size; rows are met by shard and range.
    """
    sizes = rows.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("n"))
    ends = running(sizes, [F.col("shard").asc()], "n", "start")
    total = rows.count()
    unit = lambda *k: F.conv(F.substr(hash_order(seed, *k), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)
    drawn = rows.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("at", F.floor(unit("draw", F.lit("shard")) * total))
    met = F.broadcast(drawn).join(ends, (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n")))  # `draws` rows
    met = met.select("draw", "shard", F.floor(unit("draw", F.lit("row")) * (F.greatest(F.lit(0), F.col("n") - batch) + 1)).alias("first"))
    inside = placed(rows.select(F.col(shard).alias("shard"), F.col(row).alias("row")), [F.col("row").asc()], "p", ["shard"])
    out = inside.join(F.broadcast(met), "shard").filter((F.col("p") >= F.col("first")) & (F.col("p") < F.col("first") + batch))
    w = Window.partitionBy("draw").orderBy(hash_order(seed, "draw", "row"), "row")
    return out.select("draw", "shard", "row", (F.row_number().over(w) - 1).alias("place"))


#: Right-closed activation bins, the last open-ended.
BIN_EDGES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3)


def activation_bin(value: Column) -> Column:
    """Bin of a positive value: the last edge that it exceeds."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(BIN_EDGES):
        out = F.when(value > F.lit(e).cast("float"), i).otherwise(out)
    return out


def reservoir(acts: DataFrame, priority: Column, n: int) -> DataFrame:
    """The n entries of least priority in each (feature, bin), by slot; and mergeable: it is its own input again."""
    binned = acts.withColumn("bin", activation_bin(F.col("value"))).withColumn("priority", priority)
    w = Window.partitionBy("feature", "bin").orderBy("priority", "row_id")
    return binned.withColumn("slot", F.row_number().over(w) - 1).filter(F.col("slot") < n)


def merge_reservoirs(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Reservoir of the union, from the reservoirs of the parts."""
    w = Window.partitionBy("feature", "bin").orderBy("priority", "row_id")
    return a.drop("slot").unionByName(b.drop("slot")).withColumn("slot", F.row_number().over(w) - 1).filter(F.col("slot") < n)


def first_occurrence(rows: DataFrame, key: str | Column, position: str) -> DataFrame:
    """The row of least position for each key."""
    k = F.col(key) if isinstance(key, str) else key
    return rows.withColumn("_k", k).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(position))).filter("_r = 1").drop("_k", "_r")


def top_distinct(rows: DataFrame, by: str, score: str, text: Column, tie: str, n: int) -> DataFrame:
    """The n best rows of each `by` with distinct texts: of equal texts the best counts."""
    best = Window.partitionBy(by, "_t").orderBy(F.desc(score), tie)
    one = rows.withColumn("_t", text).withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_t")
