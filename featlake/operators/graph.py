"""Connected components over edge lists, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.sources.files import parts_for, stage


def _large_star(e: DataFrame, by: list[str]) -> DataFrame:
    both = e.select(*by, F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(*by, F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, [*by, "u"]).select(*by, F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame, by: list[str]) -> DataFrame:
    down = e.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy(*by, "u").agg(F.min("v").alias("m"))
    moved = down.join(least, [*by, "u"]).select(*by, F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionAll(least.select(*by, F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, by: list[str] | None = None, files: int | None = None) -> DataFrame:
    """(by.., node, root) for every node of an edge: root is the least node of its component, in the graph named by `by`.

    edges: columns a and b of one integer type, and the columns `by` (no nulls). Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. Only a count and a checksum of the edges
    reach the driver. An empty edge list gives an empty result; loops and repeated edges do no harm. files: the most
    files that the edges are first written to, where their number is known roughly.
    """
    by = by or []
    e = stage(edges.select(*by, "a", "b").filter("a <> b").distinct(), "edges", files)
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({', '.join([*by, 'a', 'b'])}))")).first())
        if now == seen or now[0] == 0:
            break
        seen = now
        e = stage(_small_star(_large_star(e, by), by), "stars", parts_for(now[0]))
    return e.select(*by, F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(*by, F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
