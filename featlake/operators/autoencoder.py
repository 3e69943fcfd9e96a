"""Training of sparse autoencoders: TopK, BatchTopK, vanilla (L1) and JumpReLU, in numpy, data-parallel over partitions.

A step reads the rows of one batch; each partition adds up the gradients of its rows, the sums are added over
partitions, and the driver, which holds the model and its Adam state, makes the step. Batches are dealt by a hash, so a
fit does not depend on how rows are partitioned. A feature that was not active for `dead_after` batches is dead and gets
the auxiliary loss (TopK and BatchTopK). Directions of the decoder have length one before every step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.operators.order import at_ranks
from featlake.sources.files import children

KINDS = ("topk", "batch_topk", "vanilla", "jumprelu")
Model = dict[str, np.ndarray]


@dataclass(frozen=True)
class Settings:
    kind: str
    width: int
    k: int = 4
    sparsity: float = 0.0
    aux: float = 1 / 32
    k_aux: int = 16
    dead_after: int = 5
    bandwidth: float = 0.05
    rate: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.99
    longest: float = 1.0
    batches: int = 4
    seed: int = 49

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is none of {KINDS}")


def initial(s: Settings, dim: int) -> Model:
    """Encoder evenly drawn within sqrt(6 / width), the decoder its transpose with rows of length one, no biases."""
    reach = np.sqrt(6 / s.width)
    enc = np.random.default_rng(s.seed).uniform(-reach, reach, (dim, s.width))
    m = {"enc": enc, "dec": enc.T / np.linalg.norm(enc.T, axis=1, keepdims=True), "b_enc": np.zeros(s.width), "b_dec": np.zeros(dim)}
    return m | ({"log_bar": np.zeros(s.width)} if s.kind == "jumprelu" else {})


def _largest(a: np.ndarray, k: int) -> np.ndarray:
    """a with all but the k largest of each row at zero, the first of equals kept."""
    if a.shape[1] <= k:
        return a
    keep = np.argsort(-a, axis=1, kind="stable")[:, :k]
    out = np.zeros_like(a)
    np.put_along_axis(out, keep, np.take_along_axis(a, keep, 1), 1)
    return out


def before_selection(x: np.ndarray, m: Model, s: Settings) -> np.ndarray:
    """Activations after the ramp and before any are selected."""
    if s.kind == "jumprelu":
        return np.maximum(0, x @ m["enc"] + m["b_enc"])
    return np.maximum(0, (x - m["b_dec"]) @ m["enc"] + (m["b_enc"] if s.kind == "vanilla" else 0))


def selected(pre: np.ndarray, m: Model, s: Settings, bar: float = 0.0) -> np.ndarray:
    """Activations that reconstruct; bar: the least one that BatchTopK keeps in this batch."""
    if s.kind == "topk":
        return _largest(pre, s.k)
    if s.kind == "batch_topk":
        return np.where(pre >= bar, pre, 0)
    return pre if s.kind == "vanilla" else pre * (pre > np.exp(m["log_bar"]))


def gradients(x: np.ndarray, m: Model, s: Settings, n: int, dead: np.ndarray, bar: float = 0.0) -> tuple[Model, Model]:
    """(gradients, sums) of some rows of a batch of n: what they add to the loss's gradient and to its terms."""
    size = n * x.shape[1]
    pre = before_selection(x, m, s)
    a = selected(pre, m, s, bar)
    out = a @ m["dec"] + m["b_dec"]
    off = out - x
    sums = {"l2": (off**2).sum() / size, "l1": np.abs(a).sum() / n, "l0": (a > 0).sum() / n, "aux": 0.0, "active": (a > 0).sum(0).astype(float)}
    d_out = 2 * off / size
    g = {"dec": a.T @ d_out}
    extra = np.zeros_like(pre)
    if s.kind in ("topk", "batch_topk") and dead.any():
        b = _largest(pre[:, dead], min(s.k_aux, int(dead.sum())))
        miss = b @ m["dec"][dead] + off  # the dead features' reconstruction of what is left, less what is left
        sums["aux"] = s.aux * (miss**2).sum() / size
        d_miss = 2 * s.aux * miss / size
        g["dec"][dead] += b.T @ d_miss
        extra[:, dead] = (d_miss @ m["dec"][dead].T) * (b > 0)
        d_out = d_out + d_miss
        g["dec"] += a.T @ d_miss
    d_a = d_out @ m["dec"].T
    if s.kind == "jumprelu":
        theta = np.exp(m["log_bar"])
        near = lambda v: np.abs((v - theta) / s.bandwidth) < 0.5
        g["log_bar"] = -(theta / s.bandwidth * near(pre) * d_a).sum(0) - (s.sparsity / n / s.bandwidth * near(a)).sum(0)
        d_pre = d_a * (pre > theta) * (pre > 0)
        g["b_dec"] = d_out.sum(0)
        g["enc"] = x.T @ d_pre
    else:
        d_pre = (d_a + s.sparsity / n) * (a > 0) + extra
        g["b_dec"] = d_out.sum(0) - (d_pre @ m["enc"].T).sum(0)
        g["enc"] = (x - m["b_dec"]).T @ d_pre
    g["b_enc"] = d_pre.sum(0) if s.kind in ("vanilla", "jumprelu") else np.zeros(s.width)
    return g, sums


def loss(sums: Model, s: Settings) -> float:
    return float(sums["l2"] + s.sparsity * sums["l0" if s.kind == "jumprelu" else "l1"] + sums["aux"])


class Fit:
    """A model with its Adam state, counters and history."""

    def __init__(self, s: Settings, dim: int):
        self.s, self.model, self.step = s, initial(s, dim), 0
        self.first = {k: np.zeros_like(v) for k, v in self.model.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.model.items()}
        self.inactive = np.zeros(s.width)
        self.history: list[float] = []

    def dead(self) -> np.ndarray:
        return self.inactive >= self.s.dead_after

    def take(self, g: Model, sums: Model) -> None:
        """One step: clipped gradients, the decoder's without what would change its rows' lengths, Adam."""
        s, m = self.s, self.model
        self.history.append(loss(sums, s))
        if s.kind != "jumprelu":
            self.inactive = np.where(sums["active"] > 0, 0, self.inactive + 1)
        size = np.sqrt(sum((v**2).sum() for v in g.values()))
        g = {k: v * min(1.0, s.longest / (size + 1e-6)) for k, v in g.items()}
        unit = m["dec"] / np.linalg.norm(m["dec"], axis=1, keepdims=True)
        g["dec"] = g["dec"] - (g["dec"] * unit).sum(1, keepdims=True) * unit
        m["dec"] = unit
        self.step += 1
        for k, v in g.items():
            self.first[k] = s.beta1 * self.first[k] + (1 - s.beta1) * v
            self.second[k] = s.beta2 * self.second[k] + (1 - s.beta2) * v * v
            m[k] = m[k] - s.rate * (self.first[k] / (1 - s.beta1**self.step)) / (np.sqrt(self.second[k] / (1 - s.beta2**self.step)) + 1e-8)

    def state(self) -> dict[str, np.ndarray]:
        groups = {"model": self.model, "first": self.first, "second": self.second}
        return {f"{g}/{k}": v for g, x in groups.items() for k, v in x.items()} | {"inactive": self.inactive, "history": np.array(self.history)}

    def restore(self, state: dict[str, np.ndarray]) -> None:
        for name, v in state.items():
            group, _, key = name.partition("/")
            if key:
                getattr(self, group)[key] = v
        self.inactive, self.history = state["inactive"], state["history"].tolist()
        self.step = len(self.history)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _batch_sums(rows: DataFrame, vector: str, fit: Fit, n: int, bar: float) -> tuple[Model, Model]:
    """Gradients and sums of a batch: each partition adds up its rows, then names are added up apart."""
    s, m, dead = fit.s, fit.model, fit.dead()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                g, sums = gradients(_matrix(b.column(0)), m, s, n, dead, bar)
                for k, v in ({f"g/{k}": v for k, v in g.items()} | {f"s/{k}": v for k, v in sums.items()}).items():
                    total[k] = total.get(k, 0) + np.asarray(v, float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([np.ravel(v).tolist() for v in total.values()], pa.list_(pa.float64()))], ["name", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.array(t.column("v").to_pylist()).sum(0)
        return pa.table({"name": [t.column("name")[0].as_py()], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    parts = rows.select(vector).mapInArrow(run, "name string, v array<double>").groupBy("name").applyInArrow(add, "name string, v array<double>")
    found = {r["name"]: np.array(r["v"]) for r in parts.collect()}  # the size of the model
    g = {k[2:]: v.reshape(m[k[2:]].shape) for k, v in found.items() if k.startswith("g/")}
    return g, {k[2:]: v if k == "s/active" else v[0] for k, v in found.items() if k.startswith("s/")}


def _bar(rows: DataFrame, vector: str, fit: Fit, n: int) -> float:
    """The least of the k * n largest activations of a batch; equal ones are all kept."""
    s, m = fit.s, fit.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pre = before_selection(_matrix(b.column(0)), m, s)
                yield pa.RecordBatch.from_arrays([pa.array(-pre[pre > 0])], ["v"])

    values = rows.select(vector).mapInArrow(run, "v double")
    return -at_ranks(values, "v", [s.k * n - 1])[0] if values.count() >= s.k * n else 0.0


def train(vectors: DataFrame, row: str, vector: str, s: Settings, steps: int, folder: str | None = None) -> Fit:
    """A fit of `steps` steps. With a folder the state is written after each pass over the batches and taken up from there."""
    spark = vectors.sparkSession
    batch = F.pmod(F.xxhash64(F.lit(s.seed), row), F.lit(s.batches))
    sizes = {r[0]: r[1] for r in vectors.groupBy(batch).agg(F.count("*")).collect()}  # a row a batch
    first = vectors.select(F.size(vector)).first()
    if first is None:
        raise ValueError("there is nothing to fit on")
    fit = Fit(s, first[0])
    plan = json.dumps(asdict(s) | {"rows": sum(sizes.values())}, sort_keys=True)
    done = children(spark, folder) if folder else []
    if done:
        saved = spark.read.parquet(f"{folder}/{done[-1]}").collect()  # the size of the model
        if saved[0]["plan"] != plan:
            raise ValueError(f"{folder} holds the state of another fit")
        fit.restore({r["name"]: np.array(r["v"]).reshape(r["shape"]) for r in saved})
    while fit.step < steps:
        k = sorted(sizes)[fit.step % len(sizes)]
        rows = vectors.filter(batch == k)
        bar = _bar(rows, vector, fit, sizes[k]) if s.kind == "batch_topk" else 0.0
        fit.take(*_batch_sums(rows, vector, fit, sizes[k], bar))
        if folder and (fit.step % len(sizes) == 0 or fit.step == steps):
            state = [(n, list(v.shape), np.ravel(v).tolist(), plan) for n, v in fit.state().items()]
            spark.createDataFrame(state, "name string, shape array<int>, v array<double>, plan string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/step-{fit.step:08d}")
    return fit
