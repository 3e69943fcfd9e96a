"""Linear algebra over features: Gram sums, PCA, sparse reconstruction, projections, geometry of synthetic recovery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(vectors: DataFrame, vector: str, group: str | None = None) -> DataFrame:
    """(group, i, j, n, sij): counts and sums of products x_i x_j; j = -1 holds the sums of x_i.

    Each partition multiplies its batches and emits one matrix per group it has seen; sums merge by addition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            g = b.column(1).to_pylist()
            for k in set(g):
                part = x[[v == k for v in g]]
                held[k] = held.get(k, 0) + part.T @ part
        for k, m in held.items():
            d = len(m) - 1
            i, j = np.divmod(np.arange(d * (d + 1)), d + 1)
            j = np.where(j == d, -1, j)
            n = len(i)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(n, round(m[d, d]))), pa.array(m[:d].ravel())], ["grp", "i", "j", "n", "s"])

    g = F.col(group).cast("string") if group else F.lit("all")
    parts = vectors.select(vector, g.alias("grp")).mapInArrow(run, "grp string, i int, j int, n long, s double")
    return parts.groupBy("grp", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def pca(gram_: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variances and components (rows) from Gram sums of one group; covariance over n - 1.

    The sums are dim x (dim + 1) numbers, whatever the rows. A component's largest loading is positive.
    """
    g = gram_.toPandas()
    d = int(g["i"].max()) + 1
    n = int(g["n"].iloc[0])
    m = np.zeros((d, d + 1))
    m[g["i"], np.where(g["j"] < 0, d, g["j"])] = g["s"]
    mean = m[:, d] / n
    values, vectors = np.linalg.eigh((m[:, :d] - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    return mean, values[order], parts


def pursue(atoms: np.ndarray, target: np.ndarray, tolerance: float, most: int) -> tuple[list[int], np.ndarray, float]:
    """Orthogonal matching pursuit: atoms in the order taken, their weights, and the residual's length."""
    chosen: list[int] = []
    weights, rest = np.zeros(0), target.astype(np.float64)
    while np.linalg.norm(rest) > tolerance and len(chosen) < min(most, len(atoms)):
        fit = np.abs(atoms @ rest)
        fit[chosen] = -1
        chosen.append(int(fit.argmax()))
        weights, *_ = np.linalg.lstsq(atoms[chosen].T, target, rcond=None)
        rest = target - atoms[chosen].T @ weights
    return chosen, weights, float(np.linalg.norm(rest))


def sparse_reconstruction(targets: DataFrame, atoms: np.ndarray, tolerance: float, most: int) -> DataFrame:
    """(id, atoms_required, residual, cosine) of each target (id, vec); atoms are a model of fixed size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, v in zip(f["id"], f["vec"], strict=True):
                v = np.asarray(v, np.float64)
                chosen, w, rest = pursue(atoms, v, tolerance, most)
                r = atoms[chosen].T @ w if chosen else np.zeros_like(v)
                size = np.linalg.norm(r) * np.linalg.norm(v)
                rows.append((i, len(chosen), rest, float(r @ v / size) if size else 0.0))
            yield pd.DataFrame(rows, columns=["id", "atoms_required", "residual", "cosine"])

    return targets.select("id", "vec").mapInPandas(run, "id long, atoms_required int, residual double, cosine double")


def required_histogram(found: DataFrame, most: int, tolerance: float) -> DataFrame:
    """Targets by atoms required; those not within tolerance count as more than most."""
    label = F.when(F.col("residual") <= tolerance, F.col("atoms_required").cast("string")).otherwise(f">{most}")
    return found.groupBy(label.alias("atoms")).agg(F.count("*").alias("n"))


def projection(target: np.ndarray, basis: np.ndarray) -> dict[str, float]:
    """Least-squares projection on the rows of basis: rank, residual, explained share, cosine."""
    w, *_ = np.linalg.lstsq(basis.T, target, rcond=None)
    p = basis.T @ w
    total = float(target @ target)
    rest = float(((target - p) ** 2).sum())
    size = float(np.linalg.norm(p) * np.linalg.norm(target))
    return {"rank": float(np.linalg.matrix_rank(basis)), "residual": rest, "explained": 1 - rest / total if total else 0.0, "cosine": float(p @ target) / size if size else 0.0}


def projections(groups: DataFrame) -> DataFrame:
    """(grp, members, explained, cosine): each group's target (is_target) on the span of its other vectors (grp, is_target, vec)."""

    def run(t: pa.Table) -> pa.Table:
        d = t.to_pydict()
        basis = np.array([v for v, y in zip(d["vec"], d["is_target"], strict=True) if not y], np.float64)
        target = np.array([v for v, y in zip(d["vec"], d["is_target"], strict=True) if y], np.float64)
        if not len(basis) or not len(target):
            return pa.table({"grp": pa.array([], pa.int64()), "members": pa.array([], pa.int64()), "explained": pa.array([], pa.float64()), "cosine": pa.array([], pa.float64())})
        m = projection(target[0], basis)
        return pa.table({"grp": pa.array([d["grp"][0]], pa.int64()), "members": pa.array([len(basis)], pa.int64()), "explained": pa.array([m["explained"]]), "cosine": pa.array([m["cosine"]])})

    return groups.groupBy("grp").applyInArrow(run, "grp long, members long, explained double, cosine double")


def subsets(n: int, k: int, weights: np.ndarray, rng: np.random.Generator, rows: int) -> np.ndarray:
    """Draws of k distinct of n with probability in proportion to the product of their weights, exactly.

    Elementary symmetric sums over suffixes give the chance that each element is in, given those before it.
    """
    sums = np.zeros((n + 1, k + 1))
    sums[:, 0] = 1
    for i in range(n - 1, -1, -1):
        sums[i, 1:] = sums[i + 1, 1:] + weights[i] * sums[i + 1, :-1]
    out = np.zeros((rows, k), np.int64)
    for r in range(rows):
        left = k
        for i in range(n):
            if left and rng.random() * sums[i, left] < weights[i] * sums[i + 1, left - 1]:
                out[r, k - left] = i
                left -= 1
            if not left:
                break
    return out


def latents(spark, rows: int, n: int, k: int, alpha: float, seed: int, block: int = 1000) -> DataFrame:
    """(row_id, feature): k active latents a row with Zipf weights, the same for any partitioning."""
    weights = np.arange(1, n + 1, dtype=float) ** -alpha

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b in f["id"]:
                size = min(block, rows - b * block)
                s = subsets(n, k, weights, np.random.default_rng((seed, int(b))), size)
                yield pd.DataFrame({"row_id": np.repeat(np.arange(size) + b * block, k), "feature": s.ravel()})

    return spark.range(-(-rows // block)).mapInPandas(run, "row_id long, feature long")
