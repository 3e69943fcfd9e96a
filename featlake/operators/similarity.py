"""Vector similarity: normalising, threshold joins in tiles, exclusive matches, neighbours, sketches, correlations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.order import at_ranks
from featlake.operators.sampling import hash_order
from featlake.sources.files import children, stage


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(dictionary: DataFrame, vector: str = "vec") -> DataFrame:
    """Vectors of length one (double); a zero or non-finite vector is an error."""
    n = norm(F.col(vector))
    bad = (n == 0) | F.isnan(n) | n.isNull() | (n == float("inf"))
    unit = F.transform(F.col(vector), lambda x: x.cast("double") / n)
    return dictionary.withColumn(vector, F.when(bad, F.raise_error(F.lit("a vector has no finite length above zero"))).otherwise(unit))


#: Rows of a tile: a task multiplies two tiles.
TILE = 4096


def tiled(a: DataFrame, b: DataFrame, run: Callable, schema: str, tile: int = TILE) -> DataFrame:
    """run(ids of a, matrix of a, ids of b, matrix of b), a table, for each pair of tiles of a and b (id, vec).

    Both sides are cut in tiles by a hash of the id; each pair of tiles is one task, which holds those two alone, each in
    ascending order of its ids.
    """
    na, nb = (max(1, -(-x.count() // tile)) for x in (a, b))
    cut = lambda df, n, side: df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(side))
    left = cut(a, na, "i").select("i", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("j"), F.lit(0).alias("side"), "id", "vec")
    right = cut(b, nb, "j").select(F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("i"), "j", F.lit(1).alias("side"), "id", "vec")

    def matrix(t: pa.Table, mine: np.ndarray) -> np.ndarray:
        v = t.column("vec").filter(pa.array(mine)).combine_chunks()
        return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 0))

    def of_pair(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        if (side == 0).all() or (side == 1).all():
            return empty
        t = t.take(pa.array(np.lexsort((ids, side))))
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        return run(ids[side == 0], matrix(t, side == 0), ids[side == 1], matrix(t, side == 1))

    empty = pa.schema([pa.field(n, k) for n, k in _arrow_types(schema)]).empty_table()
    return left.unionByName(right).groupBy("i", "j").applyInArrow(of_pair, schema)


def _arrow_types(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]


def cosine_edges(a: DataFrame, b: DataFrame, threshold: float, absolute: bool = False, tile: int = TILE) -> DataFrame:
    """(src, dst, score): pairs of a (id, vec) and b (id, vec) with cosine >= threshold, compared in float32.

    One matrix product for each pair of tiles, which emits only edges.
    """
    t32 = np.float32(threshold)

    def edges(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        s = vx @ vy.T
        i, j = np.nonzero((np.abs(s) if absolute else s).astype(np.float32) >= t32)
        return pa.table({"src": pa.array(x[i]), "dst": pa.array(y[j]), "score": pa.array(s[i, j])})

    return tiled(normalised(a.select("id", "vec")), normalised(b.select("id", "vec")), edges, "src long, dst long, score double", tile)


#: Rows of a tile that are multiplied at once where only the best of each is kept.
STRIP = 256


def _hits(s: np.ndarray, fine: np.ndarray, threshold: float, double: bool) -> np.ndarray:
    """Whether scores s (fine: in float32) are edges, as in cosine_edges; double: in double precision too."""
    hit = fine >= np.float32(threshold)
    if double:
        hit &= s >= threshold
    return hit


def _edges_of(vx: np.ndarray, vy: np.ndarray, thresholds: dict[str, float], absolute: bool, double: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(graph, i, j) of the edges of a pair of tiles; scores are looked through once, those of the least threshold again for each."""
    s = vx @ vy.T
    if absolute:
        np.abs(s, out=s)
    least = min(thresholds.values())
    at = np.flatnonzero(_hits(s, s.astype(np.float32), least, double))
    s = s.ravel()[at]
    fine = s.astype(np.float32)
    for name, t in thresholds.items():
        yield name, *np.divmod(at if t == least else at[_hits(s, fine, t, double)], len(vy))


def thinned_edges(a: DataFrame, b: DataFrame, thresholds: dict[str, float], absolute: bool = False, double: bool = False, each: int = 1, tile: int = TILE) -> DataFrame:
    """(graph, src, dst): some of the cosine edges for each threshold (by name of its graph), without writing all.

    Of a pair of tiles an edge is given, by its hash, with `each` over the number of edges that an end has there (the
    lesser of both): about so many of each end. Where there is an edge between two tiles at all, one is given.
    """

    def some(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        parts = []
        for name, i, j in _edges_of(vx, vy, thresholds, absolute, double):
            mixed = (x[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y[j].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            chance = (mixed ^ (mixed >> np.uint64(32))) / 2.0**64
            least = np.minimum(np.bincount(i, minlength=len(x))[i], np.bincount(j, minlength=len(y))[j])
            keep = chance * least <= each
            if len(i):
                keep[chance.argmin()] = True
            i, j = i[keep], j[keep]
            parts.append(pa.table({"graph": pa.array([name] * len(i), pa.string()), "src": pa.array(x[i], pa.int64()), "dst": pa.array(y[j], pa.int64())}))
        return pa.concat_tables(parts)

    return tiled(normalised(a.select("id", "vec")), normalised(b.select("id", "vec")), some, "graph string, src long, dst long", tile)


def edge_counts(a: DataFrame, b: DataFrame, thresholds: dict[str, float], absolute: bool = False, double: bool = False, tile: int = TILE) -> DataFrame:
    """(graph, n): number of cosine edges for each threshold that has any, counted in the tiles."""

    def count(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        n = [len(i) for _, i, _ in _edges_of(vx, vy, thresholds, absolute, double)]
        return pa.table({"graph": pa.array(list(thresholds), pa.string()), "n": pa.array(n, pa.int64())})

    counted = tiled(normalised(a.select("id", "vec")), normalised(b.select("id", "vec")), count, "graph string, n long", tile)
    return counted.groupBy("graph").agg(F.sum("n").alias("n")).filter("n > 0")


def edge_degrees(a: DataFrame, b: DataFrame, thresholds: dict[str, float], absolute: bool = False, double: bool = False, tile: int = TILE) -> DataFrame:
    """(graph, side, id, n): number of cosine edges of each end that has any, counted in the tiles; side 0 is a, 1 is b."""

    def count(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        parts = []
        for name, i, j in _edges_of(vx, vy, thresholds, absolute, double):
            for side, ids, ends in ((0, x, i), (1, y, j)):
                n = np.bincount(ends, minlength=len(ids))
                k = np.flatnonzero(n)
                parts.append(pa.table({"graph": pa.array([name] * len(k), pa.string()), "side": pa.array([side] * len(k), pa.int32()), "id": pa.array(ids[k], pa.int64()), "n": pa.array(n[k], pa.int64())}))
        return pa.concat_tables(parts)

    counted = tiled(normalised(a.select("id", "vec")), normalised(b.select("id", "vec")), count, "graph string, side int, id long, n long", tile)
    return counted.groupBy("graph", "side", "id").agg(F.sum("n").alias("n"))


def best_cosines(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """(src, dst, score): for each row of a (id, vec) its largest cosine with b (id, vec), the smaller id among equals.

    A tile emits one row of each of its rows of a, never its pairs.
    """

    def best(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        at, score = np.zeros(len(x), np.int64), np.zeros(len(x))
        for k in range(0, len(x), STRIP):
            s = vx[k : k + STRIP] @ vy.T
            at[k : k + STRIP] = m = s.argmax(1)
            score[k : k + STRIP] = s[np.arange(len(s)), m]
        return pa.table({"src": pa.array(x), "dst": pa.array(y[at]), "score": pa.array(score)})

    return best_match(tiled(normalised(a.select("id", "vec")), normalised(b.select("id", "vec")), best, "src long, dst long, score double", tile))


#: Bins of the first pass of a median of cosines.
BINS = 1 << 14


def cosine_median(a: DataFrame, tile: int = TILE) -> tuple[int, float]:
    """Number of pairs of different rows of a (id, vec) and the exact median of their cosines.

    The first pass counts the pairs' scores in bins, tile by tile; the second emits only those of the bins that hold
    the middle ranks.
    """
    unit = normalised(a.select("id", "vec"))
    unit = stage(unit, "unit")

    def scores(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> np.ndarray:
        return (vx @ vy.T)[x[:, None] < y]

    def bins(s: np.ndarray) -> np.ndarray:
        return np.clip(((s + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)

    def count(*t: np.ndarray) -> pa.Table:
        n = np.bincount(bins(scores(*t)), minlength=BINS)
        k = np.flatnonzero(n)
        return pa.table({"bin": pa.array(k), "n": pa.array(n[k])})

    total = np.zeros(BINS, np.int64)
    for r in tiled(unit, unit, count, "bin long, n long", tile).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        total[r["bin"]] = r["n"]
    n, upto = int(total.sum()), np.cumsum(total)
    if not n:
        return 0, float("nan")
    low, high = (int(np.searchsorted(upto, r, "right")) for r in ((n - 1) // 2, n // 2))

    def inside(*t: np.ndarray) -> pa.Table:
        s = scores(*t)
        k = bins(s)
        return pa.table({"score": pa.array(s[(k >= low) & (k <= high)])})

    before = int(upto[low] - total[low])
    x, y = at_ranks(tiled(unit, unit, inside, "score double", tile), "score", [(n - 1) // 2 - before, n // 2 - before])
    return n, (x + y) / 2


def exclusive(edges: DataFrame, strict: float, competitor: float) -> DataFrame:
    """Edges above `strict` without another edge above `competitor` at either end."""
    near = edges.filter(F.col("score") > F.least(F.lit(strict), F.lit(competitor)))
    rivals = lambda c: F.count_if(F.col("score") > competitor).over(Window.partitionBy(c)) - (F.col("score") > competitor).cast("int")
    return near.withColumns({"rs": rivals("src"), "rd": rivals("dst")}).filter((F.col("score") > strict) & (F.col("rs") == 0) & (F.col("rd") == 0)).select("src", "dst", "score")


def top_neighbours(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best of each src by score, then smaller dst; null and NaN last."""
    s = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    w = Window.partitionBy("src").orderBy(s.desc_nulls_last(), "dst")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def candidate_union(forward: DataFrame, reverse: DataFrame, threshold: float, n_src: int, n_dst: int) -> DataFrame:
    """Edges (src, dst) that either directed neighbour list (src, dst, score) holds: in range, finite, score >= threshold."""
    both = forward.select("src", "dst", "score").unionAll(reverse.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    s = F.col("score").cast("float")
    fine = F.col("src").between(0, n_src - 1) & F.col("dst").between(0, n_dst - 1) & ~F.isnan(s) & (F.abs(s) != float("inf")) & (s >= F.lit(threshold).cast("float"))
    return both.filter(fine).select("src", "dst").distinct()


def best_match(scores: DataFrame) -> DataFrame:
    """(src, dst, score) of the best dst of each src, the smaller id among equals."""
    best = F.max(F.struct(F.col("score"), (-F.col("dst")).alias("minus")))
    return scores.groupBy("src").agg(best.alias("b")).select("src", (-F.col("b.minus")).alias("dst"), "b.score")


def nearest_centre(vectors: DataFrame, centres: np.ndarray, row: str, vector: str) -> DataFrame:
    """(row_id, centre): the least distance, the lowest centre among equals. Centres are a model of fixed size."""
    c = centres.astype(np.float64)
    half = (c * c).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((2 * x @ c.T - half).argmax(1).astype(np.int32))], ["row_id", "centre"])

    return vectors.select(F.col(row).cast("long").alias("row_id"), F.col(vector)).mapInArrow(run, "row_id long, centre int")


def _sums(vectors: DataFrame, centres: np.ndarray, vector: str) -> DataFrame:
    """(centre, n, q, i, s): rows of each centre, their squared distances, and the sums of their components, added up in each partition first."""
    c = centres.astype(np.float64)
    half, k = (c * c).sum(1), len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, q = np.zeros_like(c), np.zeros(k, np.int64), np.zeros(k)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            near = (2 * x @ c.T - half).argmax(1)
            order = np.argsort(near, kind="stable")
            at, first = np.unique(near[order], return_index=True)
            total[at] += np.add.reduceat(x[order], first, axis=0)
            n += np.bincount(near, minlength=k)
            q += np.bincount(near, ((x - c[near]) ** 2).sum(1), k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(q[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["centre", "n", "q", "s"])

    parts = vectors.select(vector).mapInArrow(run, "centre long, n long, q double, s array<double>")
    return parts.select("centre", "n", "q", F.posexplode("s").alias("i", "s")).groupBy("centre", "i").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("s").alias("s"))


def lloyd(vectors: DataFrame, centres: np.ndarray, vector: str) -> tuple[np.ndarray, float]:
    """New centres after one round and the sum of squared distances to the given ones; a centre without rows stays.

    Partitions add up first; centres times dimensions numbers reach the driver, the size of the model.
    """
    new, objective = centres.astype(np.float64).copy(), 0.0
    for r in _sums(vectors, centres, vector).collect():
        new[r["centre"], r["i"]] = r["s"] / r["n"]
        objective += r["q"] if r["i"] == 0 else 0.0
    return new, objective


def k_means(vectors: DataFrame, row: str, vector: str, k: int, steps: int, seed: int, folder: str | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Centres after `steps` rounds over all rows and the objective of each round.

    Centres begin as the k rows of least hash under the seed, or at `start` (a warm start). With a folder each round is
    written there, with a digest of what the fit depends on; a fit that finds rounds of its own goes on from the last
    of them, and refuses a folder of another.
    """
    spark = vectors.sparkSession
    of = f"{k} {seed} {vectors.count()} {'' if start is None else hashlib.sha256(np.ascontiguousarray(start, np.float64).tobytes()).hexdigest()}"
    plan = hashlib.sha256(of.encode()).hexdigest()
    history: list[float] = []
    centres = None
    for name in children(spark, folder) if folder else []:
        done = sorted(spark.read.parquet(f"{folder}/{name}").collect(), key=lambda r: r["centre"])  # k rows
        if done[0]["plan"] != plan:
            raise ValueError(f"{folder} holds the rounds of another fit")
        centres = np.array([r["vec"] for r in done])
        history.append(done[0]["objective"])
    if centres is None and start is not None:
        centres = np.asarray(start, np.float64)
    if centres is None:
        first = vectors.select(row, vector).orderBy(hash_order(seed, row), row).limit(k).collect()  # k rows, the size of the model
        centres = np.array([r[1] for r in first], np.float64)
    while len(history) < steps:
        centres, objective = lloyd(vectors, centres, vector)
        history.append(objective)
        if folder:
            rows = [(c, v.tolist(), objective, plan) for c, v in enumerate(centres)]
            spark.createDataFrame(rows, "centre int, vec array<double>, objective double, plan string").write.mode("overwrite").parquet(f"{folder}/round-{len(history):05d}")
    return centres, history


def pearson(dots: Column, n: Column, s1a: Column, s2a: Column, s1b: Column, s2b: Column) -> Column:
    """Correlation from moments and a dot product, clipped to [-1, 1]; null where a side has no variance."""
    n = n.cast("double")
    va, vb = s2a - s1a * s1a / n, s2b - s1b * s1b / n
    dead = (va <= 32 * 2.0**-52 * F.greatest(F.abs(s2a), F.lit(1e-300))) | (vb <= 32 * 2.0**-52 * F.greatest(F.abs(s2b), F.lit(1e-300)))
    r = (dots - s1a * s1b / n) / F.sqrt(va * vb)
    return F.when(~dead, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def cross_dots(a: DataFrame, b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, dots): sums over shared rows of products of activations; of given pairs alone where there are such."""
    x = a.select("row_id", F.col("feature").alias("src"), F.col("value").cast("double").alias("x"))
    y = b.select("row_id", F.col("feature").alias("dst"), F.col("value").cast("double").alias("y"))
    if pairs is not None:
        x = x.join(pairs.select("src").distinct(), "src", "left_semi")
        y = y.join(pairs.select("dst").distinct(), "dst", "left_semi")
    out = x.join(y, "row_id").groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("dots"))
    return out if pairs is None else pairs.join(out, ["src", "dst"], "left").fillna(0, ["dots"])


def correlations(dots: DataFrame, moments_a: DataFrame, moments_b: DataFrame, n: Column) -> DataFrame:
    a = moments_a.select(F.col("feature").alias("src"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    b = moments_b.select(F.col("feature").alias("dst"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    out = dots.join(a, "src").join(b, "dst")
    return out.withColumn("score", pearson(F.col("dots"), n, F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"))).select("src", "dst", "score")


def count_sketch(acts: DataFrame, bucket: Column, sign: Column) -> DataFrame:
    """(feature, bucket, value): signed sums of activations by a hash of the row."""
    return acts.groupBy("feature", bucket.alias("bucket")).agg(F.sum(sign * F.col("value").cast("double")).alias("value"))


def centred_sketch(sketch: DataFrame, ones: DataFrame, moments: DataFrame, n: Column) -> DataFrame:
    """Sketches of centred, normalised columns; ones (bucket, one) sketches the all-one column. Dead features are left out."""
    m = moments.withColumn("var", F.col("s2") - F.col("s1") * F.col("s1") / n.cast("double")).filter(F.col("var") > 32 * 2.0**-52 * F.greatest(F.abs("s2"), F.lit(1e-300)))
    grid = m.join(F.broadcast(ones))  # one row a bucket, a number fixed by the sketch
    return grid.join(sketch, ["feature", "bucket"], "left").select("feature", "bucket", ((F.coalesce("value", F.lit(0.0)) - F.col("s1") / n * F.col("one")) / F.sqrt("var")).alias("value"))


def sketch_candidates(a: DataFrame, b: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """The k dst features of largest sketch product for each src, smaller id first among equals.

    Sketches are laid out as vectors and multiplied tile by tile; a tile emits about k of each src.
    """
    width = a.unionByName(b).agg(F.max("bucket")).first()[0]

    def vectors(x: DataFrame) -> DataFrame:
        m = x.groupBy(F.col("feature").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
        return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(width or 0)), lambda i: F.coalesce(F.try_element_at("m", i.cast(x.schema["bucket"].dataType)), F.lit(0.0))).alias("vec"))

    def best(x: np.ndarray, vx: np.ndarray, y: np.ndarray, vy: np.ndarray) -> pa.Table:
        s = vx @ vy.T
        if s.shape[1] > k:  # all that may be among the k best once scores are rounded
            bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            i, j = np.nonzero(s >= bar[:, None] - 2e-9)
        else:
            i, j = np.indices(s.shape).reshape(2, -1)
        return pa.table({"src": pa.array(x[i]), "dst": pa.array(y[j]), "score": pa.array(s[i, j])})

    dots = tiled(vectors(a), vectors(b), best, "src long, dst long, score double", tile)
    kind = a.schema["feature"].dataType
    return top_neighbours(dots.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.round("score", 9).alias("score")), k)
