"""How well a learned dictionary and its activations recover known atoms and labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.operators import matching
from featlake.operators.similarity import TILE, tiled
from featlake.sources.files import stage

#: Thresholds on activations, compared in float32.
ACTIVATION_THRESHOLDS = (0.0001, 0.01, 0.03, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0, 1.5, 2.0)
#: A direction shorter than this once its parent's share is taken off points nowhere.
SHORTEST, LEAST = 1e-6, 1e-12


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), LEAST)


def nearest_atoms(atoms: DataFrame, learned: DataFrame, tile: int = TILE) -> DataFrame:
    """(id, similarity, nearest): the largest absolute cosine of each atom (id, vec) with the learned ones, the lower id among equals."""

    def best(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        order = np.argsort(y)
        s = np.abs(_unit(vx) @ _unit(vy[order]).T)
        k = s.argmax(1)
        return pa.table({"id": pa.array(x), "score": pa.array(s[np.arange(len(x)), k]), "dst": pa.array(y[order][k])})

    found = tiled(atoms, learned, best, "id long, score double, dst long", tile)
    top = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("dst")).alias("minus"))).alias("b"))
    return top.select("id", F.col("b.score").alias("similarity"), (-F.col("b.minus")).alias("nearest"))


def families(atoms: DataFrame, learned: DataFrame, thresholds: tuple[float, ...], tile: int = TILE) -> DataFrame:
    """(family, parent, child_a, child_b, recovered): how well each family is found among learned atoms (id, vec).

    atoms: family, part (0 the parent, 1 and 2 its children) and vec. A child and the learned atoms are compared once
    the parent's direction is taken off both. recovered has, for each threshold, whether three different learned atoms
    reach it for the three parts; of each part's candidates the three least ids are kept, which is enough to tell.
    """
    whole = atoms.groupBy(F.col("family").alias("id")).agg(F.sort_array(F.collect_list(F.struct("part", "vec"))).alias("p"))  # three rows each
    laid = whole.filter(F.size("p") == 3).select("id", F.flatten(F.transform("p", lambda x: x["vec"])).alias("vec"))
    k = len(thresholds)

    def of_tile(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        order = np.argsort(y)
        y, b = y[order], _unit(vy[order])
        scores, lists = np.zeros((len(x), 3)), [[] for _ in range(3 * k)]
        for i, three in enumerate(_unit(vx.reshape(len(x), 3, -1))):
            parent = three[0]
            rest = b - np.outer(b @ parent, parent)
            children = three[1:] - np.outer(three[1:] @ parent, parent)
            near = np.vstack([np.abs(b @ parent), np.abs(_unit(children) @ _unit(rest).T)])
            near[1:, np.linalg.norm(rest, axis=1) <= SHORTEST] = 0
            scores[i] = near.max(1)
            for t, bar in enumerate(thresholds):
                for part in range(3):
                    lists[3 * t + part].append(y[np.flatnonzero(near[part] >= bar)[:3]].tolist())
        cols = {"id": pa.array(x)} | {f"s{c}": pa.array(scores[:, c]) for c in range(3)}
        return pa.table(cols | {f"l{c}": pa.array(v, pa.list_(pa.int64())) for c, v in enumerate(lists)})

    schema = "id long, s0 double, s1 double, s2 double, " + ", ".join(f"l{c} array<long>" for c in range(3 * k))
    some = tiled(laid, learned, of_tile, schema, tile)
    three = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, 3)
    g = some.groupBy("id").agg(*(F.max(f"s{c}").alias(f"s{c}") for c in range(3)), *(three(f"l{c}").alias(f"l{c}") for c in range(3 * k)))
    flags = F.array(*(matching.has_triple(F.col(f"l{3 * t}"), F.col(f"l{3 * t + 1}"), F.col(f"l{3 * t + 2}")) for t in range(k)))
    return g.select(F.col("id").alias("family"), F.col("s0").alias("parent"), F.col("s1").alias("child_a"), F.col("s2").alias("child_b"), flags.alias("recovered"))


def _passed(acts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Entries with the number of thresholds (ascending) that they exceed, if any."""
    n = sum(((F.col("value") > F.lit(t).cast("float")).cast("int") for t in thresholds), F.lit(0))
    return acts.withColumn("passed", n).filter("passed > 0")


def _at_least(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by.., h, n): entries that exceed threshold h, from counts of entries by how many they exceed."""
    each = counts.select(*by, "n", F.explode(F.sequence(F.lit(0), F.col("passed") - 1)).alias("h"))
    return each.groupBy(*by, "h").agg(F.sum("n").alias("n"))


def select_activations(acts: DataFrame, member: DataFrame, thresholds: tuple[float, ...] = ACTIVATION_THRESHOLDS) -> DataFrame:
    """(target, feature, h, f1): the best threshold of each feature for each target (row_id, target), the lowest among equals.

    Pairs that no row has in common have F1 zero and are left out.
    """
    passed = _passed(acts, thresholds)
    predicted = _at_least(passed.groupBy("feature", "passed").agg(F.count("*").alias("n")), ["feature"]).withColumnRenamed("n", "pp")
    hits = _at_least(passed.join(member, "row_id").groupBy("target", "feature", "passed").agg(F.count("*").alias("n")), ["target", "feature"])
    positives = member.groupBy("target").agg(F.count("*").alias("pos"))
    f1 = 2.0 * F.col("n") / F.greatest(F.lit(1), F.col("pos") + F.col("pp"))
    scored = hits.join(predicted, ["feature", "h"]).join(positives, "target").withColumn("f1", f1)
    best = scored.groupBy("target", "feature").agg(F.max(F.struct("f1", (-F.col("h")).alias("minus"))).alias("b"))
    return best.select("target", "feature", (-F.col("b.minus")).alias("h"), F.col("b.f1").alias("f1"))


def evaluate_pairs(pairs: DataFrame, acts: DataFrame, member: DataFrame, thresholds: tuple[float, ...] = ACTIVATION_THRESHOLDS) -> DataFrame:
    """pairs (target, feature, h, ..) with test_f1, on rows that had no part in choosing them."""
    bar = F.element_at(F.array(*(F.lit(t).cast("float") for t in thresholds)), F.col("h") + 1)
    wanted = pairs.select("target", "feature", "h")
    fired = acts.join(wanted, "feature").filter(F.col("value") > bar)
    hits = fired.join(member, ["row_id", "target"]).groupBy("target", "feature").agg(F.count("*").alias("tp"))
    predicted = fired.groupBy("target", "feature").agg(F.count("*").alias("pp"))
    positives = member.groupBy("target").agg(F.count("*").alias("pos"))
    out = pairs.join(predicted, ["target", "feature"], "left").join(hits, ["target", "feature"], "left").join(positives, "target", "left").fillna(0, ["tp", "pp", "pos"])
    return out.withColumn("test_f1", 2.0 * F.col("tp") / F.greatest(F.lit(1), F.col("pos") + F.col("pp"))).drop("tp", "pp", "pos")


def threshold_of(h: Column, thresholds: tuple[float, ...] = ACTIVATION_THRESHOLDS) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in thresholds)), h + 1)


def best_neurons(selected: DataFrame, targets: DataFrame, first: int = 0) -> DataFrame:
    """(target, feature, h, f1): for each target the feature of best F1, the lowest among equals; `first` where none has any."""
    b = selected.groupBy("target").agg(F.max(F.struct("f1", (-F.col("feature")).alias("minus"), "h")).alias("b"))
    out = targets.select("target").distinct().join(b, "target", "left")
    return out.select("target", F.coalesce(-F.col("b.minus"), F.lit(first)).alias("feature"), F.coalesce("b.h", F.lit(0)).alias("h"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def distinct_neurons(selected: DataFrame, goal: float) -> DataFrame:
    """(target, feature, h, f1) of a maximum matching of targets with features that reach the goal on the rows of selection."""
    kept = stage(selected.filter(F.col("f1") >= goal), "selected")
    pairs = matching.assignments(kept.select(F.lit("goal").alias("graph"), F.col("target").cast("long").alias("src"), F.col("feature").cast("long").alias("dst")))
    return kept.join(pairs.select(F.col("src").alias("target"), F.col("dst").alias("feature")), ["target", "feature"]).select("target", "feature", "h", "f1")
