"""Sparse autoencoders: gradients against differences, fits against one process, resuming, dead features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.operators import autoencoder as AE
from featlake.sources.files import fresh

RNG = np.random.default_rng(21)
X = RNG.normal(size=(30, 6)) @ RNG.normal(size=(6, 6))


def made(kind, **more):
    s = AE.Settings(kind, 9, k=3, sparsity=0.02, batches=2, **more)
    m = AE.initial(s, 6)
    m["b_dec"] = RNG.normal(size=6) * 0.1
    m["b_enc"] = RNG.normal(size=9) * 0.1 if kind in ("vanilla", "jumprelu") else m["b_enc"]
    if kind == "jumprelu":
        m["log_bar"] = np.full(9, np.log(0.4))
    return s, m


@pytest.mark.parametrize("kind", AE.KINDS)
@pytest.mark.parametrize("dead", [False, True])
def test_gradients_equal_differences(kind, dead):
    s, m = made(kind)
    gone = np.arange(9) < 4 if dead else np.zeros(9, bool)
    bar = np.sort(AE.before_selection(X, m, s).ravel())[-s.k * len(X)] if kind == "batch_topk" else 0.0
    of = lambda p: AE.loss(AE.gradients(X, p, s, len(X), gone, bar)[1], s)
    g, _ = AE.gradients(X, m, s, len(X), gone, bar)
    for name in m:
        if name == "log_bar" or (name == "b_enc" and "topk" in kind):
            continue  # a threshold's gradient is an estimate by its bandwidth
        for _ in range(12):
            at = tuple(RNG.integers(n) for n in m[name].shape)
            step = np.zeros_like(m[name])
            step[at] = 1e-6
            up, down = of(m | {name: m[name] + step}), of(m | {name: m[name] - step})
            if kind == "batch_topk" and name in ("enc", "b_dec"):
                # the bar stands while a value at it may move over it
                continue
            assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=2e-6), name


def test_threshold_gradients_of_jumprelu():
    s, m = made("jumprelu")
    pre, theta, n = AE.before_selection(X, m, s), np.exp(m["log_bar"]), len(X)
    a = pre * (pre > theta)
    d_a = 2 * (a @ m["dec"] + m["b_dec"] - X) / X.size @ m["dec"].T
    want = np.zeros(9)
    for i in range(n):
        for k in range(9):
            if abs(pre[i, k] - theta[k]) < s.bandwidth / 2:
                want[k] -= theta[k] / s.bandwidth * d_a[i, k]
            if abs(a[i, k] - theta[k]) < s.bandwidth / 2:
                want[k] -= s.sparsity / n / s.bandwidth
    assert np.allclose(AE.gradients(X, m, s, n, np.zeros(9, bool))[0]["log_bar"], want)


def alone(x, batch, s, steps):
    """The same fit on arrays, a batch at a time."""
    fit = AE.Fit(s, x.shape[1])
    ks = sorted(set(batch.tolist()))
    for k in range(steps):
        part = x[batch == ks[k % len(ks)]]
        bar = 0.0
        if s.kind == "batch_topk":
            v = np.sort(AE.before_selection(part, fit.model, s).ravel())[::-1]
            bar = max(0.0, v[s.k * len(part) - 1])
        fit.take(*AE.gradients(part, fit.model, s, len(part), fit.dead(), bar))
    return fit


@pytest.mark.parametrize("kind", AE.KINDS)
def test_fits_do_not_depend_on_partitions_and_resume(spark, kind):
    s, _ = made(kind, dead_after=2)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "id long, vec array<double>")
    b = {r["id"]: r["b"] for r in d.select("id", F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(s.batches)).alias("b")).collect()}
    want = alone(X, np.array([b[i] for i in range(len(X))]), s, 5)
    folder = fresh(spark, "fit")
    AE.train(d.repartition(3), "id", "vec", s, 3, folder)
    got = AE.train(d.repartition(5), "id", "vec", s, 5, folder)
    assert np.allclose(got.history, want.history) and all(np.allclose(got.model[k], v) for k, v in want.model.items())
    assert (got.inactive == want.inactive).all()
    with pytest.raises(ValueError, match="another fit"):
        AE.train(d.limit(4), "id", "vec", s, 9, folder)


@pytest.mark.parametrize("kind", AE.KINDS)
def test_fits_learn(kind):
    atoms = RNG.normal(size=(12, 8))
    x = (RNG.random((400, 12)) < 0.15) * RNG.uniform(1, 2, (400, 12)) @ atoms
    s = AE.Settings(kind, 24, k=3, sparsity=0.0 if "topk" in kind else 1e-4, batches=4)
    fit = alone(x, np.arange(400) % 4, s, 200)
    assert np.mean(fit.history[-8:]) < 0.35 * np.mean(fit.history[:4])
    unit = np.linalg.norm(fit.model["dec"], axis=1)
    assert np.allclose(unit, 1, atol=0.02)


def test_dead_features_are_counted_and_revived():
    s = AE.Settings("topk", 5, k=1, dead_after=2, batches=1, rate=0.0)
    fit = AE.Fit(s, 6)
    fit.model["enc"][:, 3] = 0
    for k in range(3):
        g, sums = AE.gradients(X, fit.model, s, len(X), fit.dead())
        assert (sums["aux"] > 0) == (k >= 2) and fit.inactive[3] == k
        fit.take(g, sums)
