"""Every query without SQL against plain Python on the smallest tables, and the entry module on its own."""

import os
import subprocess
import sys
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.operators import autoencoder as AE
from featlake.operators import matching as M
from featlake.operators import recovery as R
from featlake.plans import probes, registry

registry.load()
DATA = "/root/testdata/sf0.001"
CHECKED = set()


def run(spark, name):
    CHECKED.add(name)
    return registry.QUERIES[name](spark, DATA)


@pytest.fixture(scope="module")
def vectors(spark):
    p = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    v = np.stack(p.embedding).astype(np.float64)
    return p.vec_id.to_numpy(), p.label.to_numpy(), v, v / np.linalg.norm(v, axis=1, keepdims=True)


def pairable(edges):
    """Size of a maximum matching, by augmenting paths one source at a time."""
    near, owner = {}, {}
    for s, t in edges:
        near.setdefault(s, []).append(t)

    def grow(s, seen):
        for t in near[s]:
            if t not in seen:
                seen.add(t)
                if t not in owner or grow(owner[t], seen):
                    owner[t] = s
                    return True
        return False

    sys.setrecursionlimit(10_000)
    return sum(grow(s, set()) for s in near)


def graph(vectors, a, b, bar, absolute=False):
    ids, _, _, u = vectors
    s = u[a] @ u[b].T
    s = (np.abs(s) if absolute else s).astype(np.float32)
    i, j = np.nonzero(s >= np.float32(bar))
    return list(zip(ids[a][i].tolist(), ids[b][j].tolist(), strict=True))


def test_sweep_of_matchings(spark, vectors):
    ids = vectors[0]
    even, odd = ids % 2 == 0, ids % 2 == 1
    want = {str(t): pairable([e for e in graph(vectors, even, odd, 0.25) if e in set(graph(vectors, even, odd, t / 100))]) for t in (25, 30, 35)}
    assert {r["graph"]: r["matched"] for r in run(spark, "K01_matching_cardinality").collect()} == want
    assert {r["graph"]: r["proportion"] for r in run(spark, "K10_threshold_matchings").collect()} == {k: n / even.sum() for k, n in want.items()}
    bound = {r["graph"]: r["bound"] for r in run(spark, "K11_component_bound").collect()}
    for t, n in want.items():
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        edges = [("s", s, "t", d) for s, d in graph(vectors, even, odd, int(t) / 100)]
        for a, s, b, d in edges:
            root[find((a, s))] = find((b, d))
        parts = {}
        for x in root:
            parts.setdefault(find(x), []).append(x[0])
        assert bound[t] == sum(min(p.count("s"), p.count("t")) for p in parts.values()) >= n


def test_persistence(spark, vectors):
    label = vectors[1]
    sizes = {str(k): pairable(graph(vectors, label == 0, label == k, 0.15)) for k in (1, 2, 3)}
    assert {r["graph"]: (r["matched"], r["proportion"]) for r in run(spark, "F32_persistence_proportion").collect()} == {k: (n, n / (label == 0).sum()) for k, n in sizes.items()}
    kept = {r["src"] for r in run(spark, "K04_persistence").collect()}
    able = set.intersection(*({s for s, _ in graph(vectors, label == 0, label == k, 0.15)} for k in (1, 2, 3)))
    # three matchings leave out at most what each leaves out
    assert kept <= able and sum(sizes.values()) - 2 * (label == 0).sum() <= len(kept) <= min(sizes.values())
    assert run(spark, "I01_source_intersection").first()["persistent"] == len(kept)


@pytest.mark.parametrize(("name", "absolute"), [("K09_split_matching", False), ("K16_absolute_split_matching", True)])
def test_split_matchings(spark, vectors, name, absolute):
    label = vectors[1]
    want = {(str(i), str(j)): pairable(graph(vectors, label == i, label == j, 0.25, absolute)) for i in range(4) for j in range(4) if i != j}
    got = {(r["source"], r["target"]): r["matched"] for r in run(spark, name).collect()}
    assert got == {k: n for k, n in want.items() if n}
    if not absolute:
        matrix = {r["source"]: r.asDict() for r in run(spark, "F33_split_matrix").collect()}
        assert all(matrix[i][j] == n for (i, j), n in want.items() if i in matrix)


def test_budgets_controls_and_weights(spark, vectors):
    label, u = vectors[1], vectors[3]
    assert run(spark, "K05_candidate_budget").first()["matched"] == pairable(graph(vectors, label == 0, label == 1, 0.1))
    want = {f"seed-{k}": pairable(graph(vectors, label == 0, label == k, 0.2)) for k in (4, 5)} | {"swap": pairable(graph(vectors, label == 6, label == 4, 0.2))}
    assert {r["graph"]: r["matched"] for r in run(spark, "K14_control_graphs").collect()} == {k: n for k, n in want.items() if n}
    s = u[label == 0] @ u[label == 1].T
    best = [s[i, j] for i, j in M.maximum_weight(s)]
    assert {r["threshold"]: r["matched"] for r in run(spark, "K06_maximum_weight").collect()} == {t: sum(x >= t for x in best) for t in (0.0, 0.1, 0.2, 0.3)}


def test_encoders(spark):
    h = F.xxhash64("w")
    w = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    want = {(r[0], r[1]): r[2] for r in w.groupBy("doc_id", F.pmod(h, F.lit(16)).cast("int")).agg(F.sum(F.when(h > 0, 1).otherwise(-1))).collect()}
    for name in ("A21_embedding_source", "A23_local_encoder"):
        got = run(spark, name).collect()
        assert len(got) == 16 * len({k for k, _ in want}) and all(r["x"] == want.get((r["doc_id"], r["i"]), 0) for r in got)


def test_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    import hashlib

    want = {r["doc_id"]: hashlib.sha256(" ".join(unicodedata.normalize("NFKC", r["text"]).split()).casefold().encode()).hexdigest() for r in docs}
    assert {r["doc_id"]: r["y"] for r in run(spark, "J02_folded").collect()} == want
    assert {r["doc_id"]: r["y"] for r in run(spark, "J06_repaired").collect()} == {r["doc_id"]: len(T.cleaned(r["text"])) for r in docs}
    seeds = {}
    for r in docs:
        k = zlib.crc32(r["lang"].encode())
        seeds[k] = seeds.get(k, 0) + 1
    assert {r["seed"]: r["n"] for r in run(spark, "J14_crc32").collect()} == seeds


def test_approximate_counts(spark):
    exact = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/events.parquet").groupBy("event_type").agg(F.countDistinct("user_id")).collect()}
    got = {r["event_type"]: r["users"] for r in run(spark, "F31_approx_distinct").collect()}
    assert set(got) == set(exact) and all(abs(got[k] - n) <= 0.08 * n + 1 for k, n in exact.items())


def test_tasks_are_balanced(spark):
    cost = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").groupBy("source").agg(F.sum("n_chars")).collect()}
    load, want = [0, 0, 0], {}
    for name in sorted(cost, key=lambda n: (-cost[n], n)):
        k = load.index(min(load))
        load[k] += cost[name]
        want[name] = k
    assert {r["source"]: r["worker"] for r in run(spark, "H11_balanced_tasks").collect()} == want


def test_linear_algebra(spark, vectors):
    ids, label, v, _ = vectors
    values, axes = np.linalg.eigh(np.cov(v.T))
    got = sorted(map(tuple, run(spark, "L10_pca").collect()))
    assert [r[1] for r in got] == pytest.approx(values[::-1][:8].tolist(), abs=1e-5)
    assert [r[2] for r in got] == pytest.approx([np.abs(axes[:, -k]).max() for k in range(1, 9)], abs=1e-3)
    x = v[label == 3] - v[label == 3].mean(0)
    _, axes = np.linalg.eigh(np.cov(x.T))
    got = {r["vec_id"]: (r["x"], r["y"]) for r in run(spark, "L11_small_pca").collect()}
    for k, c in ((1, 0), (2, 1)):
        mine, theirs = x @ axes[:, -k], np.array([got[i][c] for i in ids[label == 3]])
        assert np.allclose(np.abs(mine), np.abs(theirs), atol=1e-3)
    found = {r["grp"]: r for r in run(spark, "L16_projection").collect()}
    for g, r in found.items():
        t, b = v[ids == 20 * g][0], v[(ids // 20 == g) & (ids % 20 != 0)]
        p = b.T @ np.linalg.lstsq(b.T, t, rcond=None)[0]
        assert (r["members"], r["explained"], r["cosine"]) == (len(b), pytest.approx(1 - ((t - p) ** 2).sum() / (t @ t), abs=1e-4), pytest.approx(p @ t / np.linalg.norm(p) / np.linalg.norm(t), abs=1e-4))
    history = [r["objective"] for r in run(spark, "L12_k_means").orderBy("round").collect()]
    assert len(history) == 8 and history == sorted(history, reverse=True)


def test_sparse_reconstruction(spark, vectors):
    ids, _, v, u = vectors
    atoms = u[ids < 96]
    got = {r["id"]: r for r in run(spark, "L14_matching_pursuit").collect()}
    assert set(got) == set(ids.tolist())
    for i in ids[::25]:
        target, chosen, rest = v[ids == i][0], [], v[ids == i][0]
        while np.linalg.norm(rest) > 0.5 and len(chosen) < 24:
            chosen.append(max((k for k in range(len(atoms)) if k not in chosen), key=lambda k: abs(atoms[k] @ rest)))
            rest = target - atoms[chosen].T @ np.linalg.lstsq(atoms[chosen].T, target, rcond=None)[0]
        assert (got[i]["atoms_required"], got[i]["residual"]) == (len(chosen), pytest.approx(np.linalg.norm(rest), abs=1e-3))
    counts = {}
    for r in got.values():
        k = str(r["atoms_required"]) if r["residual"] <= 0.5 else ">24"
        counts[k] = counts.get(k, 0) + 1
    assert {r["atoms"]: r["n"] for r in run(spark, "L15_required_histogram").collect()} == counts


def test_family_recovery(spark, vectors):
    ids, _, _, u = vectors
    b = u[ids % 2 == 1]
    got = {r["family"]: r for r in run(spark, "L20_family_recovery").collect()}
    even = u[ids % 2 == 0]
    assert len(got) == len(even) // 3
    for f, r in got.items():
        p, *children = even[3 * f : 3 * f + 3]
        rest = b - np.outer(b @ p, p)
        rest /= np.linalg.norm(rest, axis=1, keepdims=True)
        near = [np.abs(b @ p)]
        for c in children:
            c = c - (c @ p) * p
            near.append(np.abs(rest @ (c / np.linalg.norm(c))))
        assert [r["parent"], r["child_a"], r["child_b"]] == pytest.approx([n.max() for n in near], abs=1e-4)
        for t in (20, 25, 30):
            assert r[f"family_{t}"] == M.hall_triple(*(set(np.flatnonzero(n >= t / 100).tolist()) for n in near))


def test_distinct_recovery(spark):
    train, _ = probes._selected(spark, DATA)
    rows = R.select_activations(*train).collect()
    want = {g: pairable([(r["target"], r["feature"]) for r in rows if r["f1"] >= g]) for g in (0.18, 0.2)}
    got = {r["goal"]: r for r in run(spark, "L21_distinct_recovery").collect()}
    assert {g: r["matched"] for g, r in got.items()} == {g: n for g, n in want.items() if n} and all(r["least_f1"] >= g - 1e-6 for g, r in got.items())


def test_autoencoders(spark, vectors):
    ids, _, v, _ = vectors
    got = {}
    for r in run(spark, "L22_autoencoders").orderBy("kind", "step").collect():
        got.setdefault(r["kind"], []).append(r["loss"])
    for kind in AE.KINDS:
        s = AE.Settings(kind, 32, sparsity=0.0 if "topk" in kind else 0.001, batches=2)
        deal = {r["vec_id"]: r["b"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.pmod(F.xxhash64(F.lit(s.seed), "vec_id"), F.lit(2)).alias("b")).collect()}
        batch = np.array([deal[i] for i in ids.tolist()])
        fit = AE.Fit(s, v.shape[1])
        for k in range(4):
            x = v[batch == k % 2]
            top = np.sort(AE.before_selection(x, fit.model, s).ravel())[::-1]
            fit.take(*AE.gradients(x, fit.model, s, len(x), fit.dead(), max(0.0, top[s.k * len(x) - 1])))
        assert got[kind] == pytest.approx(fit.history, abs=1e-7)


def test_latents(spark):
    n = {r["feature"]: r["n"] for r in run(spark, "M08_synthetic_latents").collect()}
    assert sum(n.values()) == 5000 * 4 and n[0] > n[4] > n[16] > n[63] > 0


def test_each_query_without_sql_is_checked_here():
    assert CHECKED == set(registry.QUERIES) - set(registry.ORACLE)


def test_entry_is_imported_without_a_session():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)
