from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featlake.operators import matching as M
from featlake.sources.files import stage


def rows(graph, matrix):
    return [(graph, i, j) for i, r in enumerate(matrix) for j, x in enumerate(r) if x]


def frame(spark, *graphs):
    return spark.createDataFrame([x for g, m in graphs for x in rows(g, m)] or [], "graph string, src long, dst long")


def brute(matrix):
    best = 0
    n, m = len(matrix), len(matrix[0])
    for choice in product(range(-1, m), repeat=n):
        used = [c for c in choice if c >= 0]
        if len(used) == len(set(used)) and all(c < 0 or matrix[i][c] for i, c in enumerate(choice)):
            best = max(best, len(used))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=4, max_size=4), min_size=5, max_size=5))
def test_maximum_and_certificate(matrix):
    adjacency = {i: [j for j, x in enumerate(r) if x] for i, r in enumerate(matrix) if any(r)}
    match = M.maximum_matching(adjacency)
    assert len(match) == brute(matrix)
    assert len(set(match.values())) == len(match) and all(matrix[s][t] for s, t in match.items())
    a, b = M.vertex_cover(adjacency, match)
    assert len(a) + len(b) == len(match) and all(s in a or t in b for s in adjacency for t in adjacency[s])


def test_pairwise_optima_are_not_persistence(spark):
    graphs = [("a", [[1, 0], [1, 0], [0, 1]]), ("b", [[0, 1], [1, 0], [1, 0]]), ("c", [[1, 0], [0, 1], [1, 0]])]
    e = frame(spark, *graphs)
    a = M.assignments(e)
    assert {r[0]: r[1] for r in a.groupBy("graph").count().collect()} == {"a": 2, "b": 2, "c": 2}
    assert M.uncovered(e, a).count() == 0 and M.invalid_witness(e, a).count() == 0
    assert 0 <= M.persistent(a, 3).count() <= 2


def test_disjoint_supports_and_empty(spark):
    a = M.assignments(frame(spark, ("a", [[1], [0]]), ("b", [[0], [1]])))
    assert M.persistent(a, 2).count() == 0
    assert M.assignments(frame(spark)).count() == 0


def test_bad_witnesses(spark):
    e = frame(spark, ("g", [[1, 0], [0, 1]]))
    bad = lambda *x: M.invalid_witness(e, spark.createDataFrame([("g", *y) for y in x], "graph string, src long, dst long")).count()
    assert bad((0, 1)) and bad((0, 2)) and bad((-1, 0)) and bad((0, 0), (0, 0)) and not bad((0, 0), (1, 1))


def test_non_maximum_is_caught(spark):
    e = frame(spark, ("g", [[1, 0], [0, 1]]))
    half = spark.createDataFrame([("g", 0, 0, 1)], "graph string, src long, dst long, in_cover int")
    assert M.uncovered(e, half).count() == 1


def test_paper_persistence(spark):
    a = M.assignments(frame(spark, ("2", [[1, 0, 0], [1, 0, 0]])))
    assert [r["src"] for r in M.persistent(a, 1).collect()] == [0]
    assert M.matched_fraction(a, 2).first()["proportion"] == 0.5


def test_hall():
    assert M.hall_triple({1}, {2}, {3}) and not M.hall_triple({1}, {1}, {2}) and not M.hall_triple({1, 2}, {1, 2}, {2, 1})


@pytest.mark.parametrize("seed", range(12))
def test_maximum_weight(seed):
    w = np.random.default_rng(seed).random((4, 5))
    got = sum(w[i, j] for i, j in M.maximum_weight(w))
    best = max(sum(w[i, c] for i, c in enumerate(p)) for p in product(range(5), repeat=4) if len(set(p)) == 4)
    assert got == pytest.approx(best)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_over_edges_equal_tasks(spark, seed):
    """Dense, sparse and long components, as if each were too large for a task."""
    rng = np.random.default_rng(seed)
    graphs = [("dense", rng.random((12, 9)) < 0.5), ("sparse", rng.random((25, 25)) < 0.08)]
    path = np.zeros((9, 9), int)
    for i in range(9):
        path[i, i] = path[i, max(0, i - 1)] = 1
    e = frame(spark, *graphs, ("path", path[:, :8] if seed else path))
    near = {}
    for g, s, d in e.collect():
        near.setdefault(g, {}).setdefault(s, []).append(d)
    want = {g: len(M.maximum_matching(a)) for g, a in near.items()}
    for most in (0, 6):
        got = M.assignments(e, most)
        assert {r[0]: r[1] for r in got.groupBy("graph").count().collect()} == want
        assert M.invalid_witness(e, got).count() == 0 and M.uncovered(e, got).count() == 0


@pytest.mark.parametrize(("seed", "share"), [(0, 0.9)])
def test_few_edges_are_proven_on_all(spark, monkeypatch, seed, share):
    """A dense graph: as large a matching as over all edges, with fewer searched."""
    rng = np.random.default_rng(seed)
    m = rng.random((60, 50)) < share
    e = frame(spark, ("g", m.tolist()))
    searched, whole = [], M._by_component
    monkeypatch.setattr(M, "_by_component", lambda few, most: searched.append(few.distinct().count()) or whole(few, most))
    got = M.assignments(e, most=100, budget=1)
    want = len(M.maximum_matching({i: [j for j, x in enumerate(r) if x] for i, r in enumerate(m) if any(r)}))
    assert got.count() == want and M.uncovered(e, got).count() == 0 and M.invalid_witness(e, got).count() == 0
    assert searched[0] < e.count() and searched == sorted(searched)


def test_cosine_graphs_are_matched_without_their_edges(spark, monkeypatch):
    """Ends of many, few and no edges: as many pairs as over all edges, which are never listed, and all are true edges."""
    rng = np.random.default_rng(5)
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 6)))], "id long, vec array<double>") for n in (70, 90))
    g = M.CosineGraphs(a, b, {"low": 0.1, "high": 0.9}, absolute=True)
    e = g.edges().localCheckpoint()
    want = {r[0]: r[1] for r in M.assignments(e).groupBy("graph").count().collect()}
    assert {r[0]: r[1] for r in M.S.edge_counts(*g, tile=16).collect()} == {r[0]: r[1] for r in e.groupBy("graph").count().collect()}
    monkeypatch.setattr(M.S, "cosine_edges", lambda *_: pytest.fail("all edges were listed"))
    got = M.cosine_assignments([g], pairs=0, budget=2)
    assert {r[0]: r[1] for r in got.groupBy("graph").count().collect()} == want and want["high"] < want["low"]
    assert M.invalid_witness(e, got).count() == 0 and M.uncovered(e, got).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=4, max_size=4), min_size=5, max_size=5), st.lists(st.integers(1, 4), min_size=9, max_size=9))
def test_a_flow_is_the_matching_of_all_copies(matrix, copies):
    near = {i: [j for j, x in enumerate(r) if x] for i, r in enumerate(matrix) if any(r)}
    supply, demand = dict(enumerate(copies[:5])), dict(enumerate(copies[5:]))
    flow = M.maximum_flow(near, supply, demand)
    spread = {(s, k): [(t, m) for t in near[s] for m in range(demand[t])] for s in near for k in range(supply[s])}
    assert sum(sum(x.values()) for x in flow.values()) == len(M.maximum_matching(spread))
    assert all(sum(x.values()) <= demand[t] for t, x in flow.items()) and all(matrix[s][t] and n > 0 for t, x in flow.items() for s, n in x.items())
    assert all(sum(x.get(s, 0) for x in flow.values()) <= supply[s] for s in near)
    a, b = M.flow_cover(near, supply, flow)
    assert all(s in a or t in b for s in near for t in near[s])
    assert sum(supply[s] for s in a) + sum(demand[t] for t in b) == sum(sum(x.values()) for x in flow.values())


@pytest.mark.parametrize("pairs", [40, 2000])
def test_copies_are_matched_once(spark, monkeypatch, pairs):
    """Vectors of many copies: the matching of all, proven, while tiles and tasks see one of each; with their edges listed, or few of them."""
    rng = np.random.default_rng(3)
    a, b = ([(3 * i + 1, v) for i, v in enumerate(np.repeat(rng.normal(size=(n, 5)), rng.integers(1, 12, n), axis=0).tolist())] for n in (30, 34))
    fa, fb = (spark.createDataFrame(x, "id long, vec array<double>") for x in (a, b))
    g = M.CosineGraphs(fa, fb, {"low": 0.6, "high": 0.85})
    e = g.edges().localCheckpoint()
    want = {r[0]: r[1] for r in M.assignments(e).groupBy("graph").count().collect()}
    seen, tiled = [], M.S.tiled
    monkeypatch.setattr(M.S, "tiled", lambda x, y, *rest: seen.append((x.count(), y.count())) or tiled(x, y, *rest))
    got = stage(M.cosine_assignments([g], pairs=pairs, budget=16), "got")
    assert {r[0]: r[1] for r in got.groupBy("graph").count().collect()} == want
    assert M.invalid_witness(e, got).count() == 0 and M.uncovered(e, got).count() == 0
    assert seen and max(x for x, _ in seen) <= 30 and max(y for _, y in seen) <= 34
    assert sorted(g.among(got).collect()) == sorted(got.select("graph", "src", "dst").collect())
    assert g.among(got.selectExpr("graph", "src + 1 as src", "dst")).count() == 0


def test_degrees_are_counted_without_edges(spark):
    rng = np.random.default_rng(7)
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 4)))], "id long, vec array<double>") for n in (40, 50))
    g = M.CosineGraphs(a, b, {"x": 0.3, "y": 0.8}, double=True)
    e = g.edges().localCheckpoint()
    want = [(r["graph"], k, r[end], r["count"]) for k, end in enumerate(("src", "dst")) for r in e.groupBy("graph", end).count().collect()]
    assert sorted(tuple(r) for r in M.S.edge_degrees(*g, tile=16).collect()) == sorted(want)
