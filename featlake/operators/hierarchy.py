"""Category targets, taxonomies, trajectories over an ordered axis, and recovery summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.order import placed


def category_targets(rows: DataFrame, row: str, levels: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(targets, membership): categories `level:value` held by at least `least` rows; blanks are none.

    Levels are unpivoted in one pass over the rows.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("category")) for c in levels))
    long = rows.select(F.col(row).alias("row_id"), F.inline(pairs)).filter((F.col("category").isNotNull()) & (F.col("category") != "")).distinct()
    long = long.withColumn("category_id", F.concat_ws(":", "level", "category"))
    targets = long.groupBy("level", "category", "category_id").agg(F.count("*").alias("positive_count")).filter(F.col("positive_count") >= least)
    return targets, long.join(targets.select("category_id"), "category_id", "left_semi").select("category_id", "row_id")


def prefix_targets(rows: DataFrame, row: str, text: str, sizes: tuple[int, ...], least: int) -> tuple[DataFrame, DataFrame]:
    """Targets of texts that begin with a prefix; texts shorter than the prefix belong to none."""
    p = F.array(*(F.struct(F.lit(n).alias("size"), F.when(F.length(text) >= n, F.substr(F.col(text), F.lit(1), F.lit(n))).alias("prefix")) for n in sizes))
    long = rows.select(F.col(row).alias("row_id"), F.inline(p)).filter("prefix is not null")
    targets = long.groupBy("size", "prefix").agg(F.count("*").alias("positive_count")).filter(F.col("positive_count") >= least)
    return targets, long.join(targets, ["size", "prefix"], "left_semi")


def wide_to_long(species: DataFrame, key: str, ranks: list[str]) -> DataFrame:
    """(key, level, category) of the rank columns that are not blank."""
    pairs = F.array(*(F.struct(F.lit(r).alias("level"), F.col(r).cast("string").alias("category")) for r in ranks))
    return species.select(key, F.inline(pairs)).filter("category is not null and category <> ''")


def eligible_categories(species: DataFrame, key: str, ranks: list[str], least: int) -> DataFrame:
    """(category_index, level, category, category_id, n_species) of categories of at least `least` distinct keys."""
    n = wide_to_long(species, key, ranks).groupBy("level", "category").agg(F.countDistinct(key).alias("n_species")).filter(F.col("n_species") >= least)
    laid = placed(n, [F.col("level").asc(), F.col("category").asc()], "category_index")
    return laid.withColumn("category_id", F.concat_ws(":", "level", "category"))


def taxon_membership(names: DataFrame, pairs: DataFrame, categories: DataFrame, ranks: list[str]) -> DataFrame:
    """(category_id, row_id): common names by their row, scientific names by their text, of eligible categories.

    names: row_id, kind, text; pairs: taxon, scientific, common_row and the rank columns.
    """
    long = pairs.select("scientific", "common_row", F.inline(F.array(*(F.struct(F.lit(r).alias("level"), F.col(r).alias("category")) for r in ranks))))
    long = long.withColumn("category_id", F.concat_ws(":", "level", "category")).join(categories.select("category_id"), "category_id", "left_semi")
    common = long.select("category_id", F.col("common_row").alias("row_id")).join(names.filter("kind = 'common'").select("row_id"), "row_id", "left_semi").select("category_id", "row_id")
    science = long.join(names.filter("kind = 'scientific'").select("row_id", F.col("text").alias("scientific")), "scientific").select("category_id", "row_id")
    return common.unionByName(science).distinct()


def unambiguous_parents(pairs: DataFrame, eligible: DataFrame) -> DataFrame:
    """(child, parent): children with exactly one parent, which is eligible; (child, parent) rows may repeat, blanks exclude."""
    g = pairs.groupBy("child").agg(F.collect_set("parent").alias("p"), F.max((F.coalesce("parent", F.lit("")) == "").cast("int")).alias("blank"))
    one = g.filter((F.size("p") == 1) & (F.col("blank") == 0)).select("child", F.get("p", F.lit(0)).alias("parent"))
    return one.join(eligible.select(F.col("category").alias("parent")), "parent", "left_semi").join(eligible.select(F.col("category").alias("child")), "child", "left_semi").select("child", "parent")


def check_trajectories(points: DataFrame, keys: list[str], axis: str, size: int) -> DataFrame:
    """Trajectories that do not hold each of `size` places of the axis exactly once."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(axis).alias("places")).filter((F.col("n") != size) | (F.col("places") != size))


def regrets(points: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Distance of each point from the best of its trajectory."""
    return points.withColumn("regret", F.max(score).over(Window.partitionBy(*keys)) - F.col(score))


def cells(points: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Count, mean and median regret, share within tolerance (+1e-12) and mean score of each cell, pooled."""
    r = F.col("regret")
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(r).alias("mean_regret"), F.median(r).alias("median_regret"), F.count_if(r <= tolerance + 1e-12).alias("within"), F.avg("score").alias("mean_score"))


def marks(table: DataFrame, row: list[str], value: str) -> DataFrame:
    """Place of each value among its row's distinct values, largest first; values equal to twelve digits are one."""
    return table.withColumn("place", F.dense_rank().over(Window.partitionBy(*row).orderBy(F.desc(F.round(value, 12)))))


def rolled_up(points: DataFrame, by: list[str], level: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by `by` and level, and over all levels under the level `all`."""
    view = points.select(*by, level, *(c.alias(f"_{n}") for n, c in measures.items()))
    sums = [F.sum(f"_{n}").alias(n) for n in measures]
    grouped = view.groupingSets([[*by, level], by], *by, level).agg(F.grouping(level).alias("_all"), F.count("*").alias("n"), *sums)
    return grouped.withColumn(level, F.when(F.col("_all") == 1, "all").otherwise(F.col(level).cast("string"))).drop("_all")


def detector_recall(fired: DataFrame, member: DataFrame) -> DataFrame:
    """(detector, category, hit, total, recall) of each detector's rows (detector, row_id) on every category."""
    total = member.groupBy("category").agg(F.count("*").alias("total"))
    hit = fired.join(member, "row_id").groupBy("detector", "category").agg(F.count("*").alias("hit"))
    grid = fired.select("detector").distinct().join(total)  # detectors times categories, both models of fixed size
    return grid.join(hit, ["detector", "category"], "left").fillna(0, ["hit"]).withColumn("recall", F.col("hit") / F.col("total"))


def best_recall_per_feature(chosen: DataFrame, least: float) -> DataFrame:
    """Features with their categories and the best recall over them, where that is at least `least`."""
    g = chosen.groupBy("width", "feature").agg(F.array_join(F.array_sort(F.collect_list("category")), "|").alias("categories"), F.max("recall").alias("best"))
    return g.filter(F.col("best") >= least)
