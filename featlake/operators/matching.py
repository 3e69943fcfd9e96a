"""Maximum bipartite matchings with certificates, and persistence across targets.

Edges are (graph, src, dst). Matching goes by connected component of the bipartite graph, each in one task, but for
components of more than MOST_EDGES edges, which are solved by rounds over all of their edges. Of more than MOST_EDGES
edges in all, few of each end are matched so and the result is proven on the rest; graphs of cosines of many vectors are
never written, and what a cover leaves out is looked for among the vectors that it leaves. Ties are settled by
sources and neighbours in ascending order in a task, and by least roots in rounds, among the edges tried: cardinality
is unique, membership follows these rules.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators import similarity as S
from featlake.operators.graph import connected_components
from featlake.operators.order import placed
from featlake.sources.files import stage


def maximum_matching(adjacency: dict[int, list[int]]) -> dict[int, int]:
    """Hopcroft-Karp: src to dst of a maximum matching; sources and neighbours go in ascending order."""
    sources = sorted(adjacency)
    near = {s: sorted(set(adjacency[s])) for s in sources}
    of_src: dict[int, int] = {}
    of_dst: dict[int, int] = {}
    while True:
        level = {s: 0 for s in sources if s not in of_src}
        todo, found = deque(level), False
        while todo:
            s = todo.popleft()
            for t in near[s]:
                u = of_dst.get(t)
                if u is None:
                    found = True
                elif u not in level:
                    level[u] = level[s] + 1
                    todo.append(u)
        if not found:
            return of_src
        at = dict.fromkeys(sources, 0)
        for root in sources:
            if root in of_src:
                continue
            path = [root]
            while path:  # depth first along levels, without recursion
                s = path[-1]
                if at[s] == len(near[s]):
                    path.pop()
                    level.pop(s, None)
                    continue
                t = near[s][at[s]]
                at[s] += 1
                u = of_dst.get(t)
                if u is None:
                    while path:
                        s = path.pop()
                        before = of_src.get(s)
                        of_src[s], of_dst[t] = t, s
                        t = before
                elif u in level and level[u] == level[s] + 1:
                    path.append(u)


def vertex_cover(adjacency: dict[int, list[int]], match: dict[int, int]) -> tuple[set[int], set[int]]:
    """Koenig: a cover of every edge (sources, targets), as large as the matching if and only if that is maximum."""
    back = {t: s for s, t in match.items()}
    reached = {s for s in adjacency if s not in match}
    todo, targets = list(reached), set()
    while todo:
        for t in adjacency[todo.pop()]:
            if t not in targets:
                targets.add(t)
                u = back.get(t)
                if u is not None and u not in reached:
                    reached.add(u)
                    todo.append(u)
    return set(adjacency) - reached, targets


def maximum_flow(adjacency: dict[int, list[int]], supply: dict[int, int], demand: dict[int, int]) -> dict[int, dict[int, int]]:
    """maximum_matching() where an end stands for several: units by target and source, of a maximum flow (Dinic)."""
    near = {s: sorted(set(adjacency[s])) for s in sorted(adjacency)}
    left, room = {s: supply[s] for s in near}, dict(demand)
    flow: dict[int, dict[int, int]] = {t: {} for t in room}
    while True:
        level = {s: 0 for s in near if left[s]}
        todo, found, met = deque(level), False, {}
        while todo:
            s = todo.popleft()
            for t in near[s]:
                if room[t]:
                    found = True
                elif t not in met:
                    met[t] = level[s]
                    for u in flow[t]:
                        if u not in level:
                            level[u] = level[s] + 1
                            todo.append(u)
        if not found:
            return flow
        at, takers, tried = dict.fromkeys(near, 0), {}, {}
        for root in near:
            path, via = [root], []  # via[k] stands between path[k] and path[k + 1]
            while path and left[root]:  # depth first along levels, without recursion
                s = path[-1]
                if at[s] == len(near[s]):
                    level.pop(path.pop(), None)
                    if via:
                        via.pop()
                    continue
                t = near[s][at[s]]
                if room[t]:
                    n = min(left[root], room[t], *(flow[v][u] for v, u in zip(via, path[1:], strict=True)))
                    left[root] -= n
                    room[t] -= n
                    flow[t][s] = flow[t].get(s, 0) + n
                    for v, u, w in zip(via, path[1:], path, strict=False):  # v goes from u to w
                        flow[v][w] = flow[v].get(w, 0) + n
                        flow[v][u] -= n
                        if not flow[v][u]:
                            del flow[v][u]
                    path, via = [root], []
                    continue
                if met.get(t) != level[s]:  # its takers are not a level further
                    at[s] += 1
                    continue
                us = takers.setdefault(t, list(flow[t]))
                k = tried.get(t, 0)
                while k < len(us) and not (us[k] in flow[t] and level.get(us[k]) == level[s] + 1):
                    k += 1
                tried[t] = k
                if k == len(us):
                    at[s] += 1
                else:
                    path.append(us[k])
                    via.append(t)


def flow_cover(adjacency: dict[int, list[int]], supply: dict[int, int], flow: dict[int, dict[int, int]]) -> tuple[set[int], set[int]]:
    """vertex_cover() of a flow: its ends' numbers add up to as much as flows if and only if that is maximum."""
    sent = dict.fromkeys(adjacency, 0)
    for units in flow.values():
        for s, n in units.items():
            sent[s] += n
    reached = {s for s in adjacency if sent[s] < supply[s]}
    todo, targets = list(reached), set()
    while todo:
        for t in adjacency[todo.pop()]:
            if t not in targets:
                targets.add(t)
                new = flow[t].keys() - reached
                reached |= new
                todo += new
    return set(adjacency) - reached, targets


def components(edges: DataFrame) -> DataFrame:
    """edges with a number of their component (column component), alike within a graph; ids are below 2^62."""
    e = edges.select("graph", "src", "dst").distinct()
    ends = e.select("graph", (F.col("src") * 2).alias("a"), (F.col("dst") * 2 + 1).alias("b"))
    roots = connected_components(ends, ["graph"]).select("graph", (F.col("node") / 2).cast("long").alias("src"), F.col("root").alias("component"), (F.col("node") % 2 == 0).alias("is_src"))
    return e.join(roots.filter("is_src").drop("is_src"), ["graph", "src"]).select("graph", "src", "dst", "component")


ASSIGNED = "graph string, src long, dst long, in_cover int"


def _solve(t: pa.Table) -> pa.Table:
    graph = t.column("graph")[0].as_py()
    adjacency: dict[int, list[int]] = {}
    for s, d in zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True):
        adjacency.setdefault(s, []).append(d)
    match = maximum_matching(adjacency)
    a, b = vertex_cover(adjacency, match)
    if len(a) + len(b) != len(match):
        raise ValueError("a matching is not maximum")
    src, dst = list(match), list(match.values())
    covered = [1 if s in a else 2 for s in src]  # the end of the matched edge that covers
    n = len(src)
    return pa.table({"graph": pa.array([graph] * n, pa.string()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "in_cover": pa.array(covered, pa.int32())})


def _solve_flow(t: pa.Table) -> pa.Table:
    """_solve() of edges (graph, src, dst, ns, nd) between ends that stand for ns and nd: also n, the pairs matched."""
    graph = t.column("graph")[0].as_py()
    adjacency: dict[int, list[int]] = {}
    src, dst, ns, nd = (t.column(c).to_pylist() for c in ("src", "dst", "ns", "nd"))
    for s, d in zip(src, dst, strict=True):
        adjacency.setdefault(s, []).append(d)
    supply, demand = dict(zip(src, ns, strict=True)), dict(zip(dst, nd, strict=True))
    flow = maximum_flow(adjacency, supply, demand)
    a, b = flow_cover(adjacency, supply, flow)
    if sum(supply[s] for s in a) + sum(demand[d] for d in b) != sum(sum(x.values()) for x in flow.values()):
        raise ValueError("a matching is not maximum")
    rows = [(s, d, 1 if s in a else 2, n) for d, units in flow.items() for s, n in units.items()]
    src, dst, covered, n = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"graph": pa.array([graph] * len(rows), pa.string()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "in_cover": pa.array(covered, pa.int32()), "n": pa.array(n, pa.int64())})


#: Edges of a component that one task solves; larger ones are solved by rounds over all of their edges at once.
MOST_EDGES = 2_000_000
#: Neighbours of an end that are tried first where there are more than MOST_EDGES edges in all.
BUDGET = 4


def assignments(edges: DataFrame, most: int = MOST_EDGES, budget: int = BUDGET) -> DataFrame:
    """(graph, src, dst, in_cover) of a maximum matching of each graph; in_cover: 1 the source, 2 the target covers.

    Up to `most` edges are solved by component. More are too many for most matchings to be worth searching whole: a
    matching of few edges of each end is proven on all of them by its cover. Of edges that the cover leaves out, which
    are just those by which the matching might grow, some of each end then join the few, twice as many every time.
    """
    e = edges.select(F.col("graph").cast("string").alias("graph"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    e = stage(e, "edges")
    if e.count() <= most:
        return _by_component(e, most)
    few = _candidates(e, budget)
    while True:
        few = stage(few, "few")
        found = stage(_by_component(few, most), "tried")
        left = stage(_candidates(uncovered(e, found), budget), "uncovered")
        if left.isEmpty():
            return found
        few, budget = few.unionByName(left), 2 * budget


class CosineGraphs(NamedTuple):
    """Graphs between a and b (id, vec), one for each threshold by its name, whose edges are told by cosines."""

    a: DataFrame
    b: DataFrame
    thresholds: dict[str, float]
    absolute: bool = False
    double: bool = False

    def edges(self) -> DataFrame:
        e = S.cosine_edges(self.a, self.b, min(self.thresholds.values()), self.absolute)
        s = F.abs("score") if self.absolute else F.col("score")
        fine = lambda t: (s.cast("float") >= F.lit(t).cast("float")) & (s >= t if self.double else F.lit(True))
        of = F.filter(F.array(*(F.when(fine(t), F.lit(name)) for name, t in self.thresholds.items())), lambda x: x.isNotNull())
        return e.select(F.explode(of).alias("graph"), "src", "dst")

    def among(self, chosen: DataFrame) -> DataFrame:
        """Those of chosen (graph, src, dst) that are edges, by their own cosines, which may differ from a tile's by rounding (1e-12)."""
        unit = [S.normalised(x.select("id", "vec")).select(F.col("id").alias(end), F.col("vec").alias(f"v{end}")) for x, end in ((self.a, "src"), (self.b, "dst"))]
        score = S.dot(F.col("vsrc"), F.col("vdst"))
        bar = F.element_at(F.create_map(*(F.lit(x) for pair in self.thresholds.items() for x in pair)), F.col("graph"))
        scored = chosen.select("graph", "src", "dst").join(unit[0], "src").join(unit[1], "dst").withColumn("score", F.abs(score) if self.absolute else score)
        near = F.col("score") + 1e-12
        fine = near.cast("float") >= bar.cast("float")
        return scored.filter(F.col("graph").isin(*self.thresholds) & (fine & (near >= bar) if self.double else fine)).select("graph", "src", "dst")

    def beside(self, assigned: DataFrame) -> list[CosineGraphs]:
        """Each graph on the vectors that the cover of a matching leaves: its edges are those left out."""
        out = []
        for name, t in self.thresholds.items():
            mine = assigned.filter(F.col("graph") == name)
            a = self.a.join(mine.filter("in_cover = 1").select(F.col("src").alias("id")), "id", "left_anti")
            b = self.b.join(mine.filter("in_cover = 2").select(F.col("dst").alias("id")), "id", "left_anti")
            if not a.isEmpty() and not b.isEmpty():
                out.append(CosineGraphs(a, b, {name: t}, self.absolute, self.double))
        return out


#: Pairs of vectors up to which all edges of cosine graphs are written.
MOST_PAIRS = 100_000_000


def cosine_assignments(graphs: list[CosineGraphs], pairs: int = MOST_PAIRS, most: int = MOST_EDGES, budget: int = BUDGET) -> DataFrame:
    """assignments() of graphs of cosines. With more than `pairs` pairs of vectors their edges are not written.

    Some edges of each pair of tiles are matched. The matching is proven on all by its cover: between the vectors that
    are not in it no cosine reaches the threshold. While some do, some of those edges join. Equal vectors are one, which
    stands for their number, so that their edges are looked for and matched once.
    """
    graphs = [g._replace(a=stage(g.a, "vectors"), b=stage(g.b, "vectors")) for g in graphs]
    if sum(g.a.count() * g.b.count() for g in graphs) <= pairs:
        return assignments(reduce(DataFrame.unionAll, [g.edges() for g in graphs]), most)

    merged = [(_classes(g.a), _classes(g.b)) for g in graphs]
    if any(not x.filter("place > 0").isEmpty() for x in chain(*merged)):
        found = _of_classes(graphs, merged, pairs, most, budget)
        if found is not None:
            return found
    return _proven(graphs, budget, lambda few: _by_graph(few, most))


def _proven(graphs: list[CosineGraphs], budget: int, solve: Callable[[DataFrame], DataFrame | None], few: DataFrame | None = None) -> DataFrame | None:
    """A matching that solve() finds among few edges, at first `few`, and that is proven on all; None where solve() gives it up."""

    def some(gs: list[CosineGraphs], each: int) -> DataFrame:
        return stage(_candidates(stage(reduce(DataFrame.unionAll, [S.thinned_edges(*g, each=each) for g in gs]), "thinned"), budget), "some")

    few, each = some(graphs, 1) if few is None else few, budget
    while True:
        found = solve(few)
        if found is None:
            return None
        found = stage(found, "tried")
        left = [x for g in graphs for x in g.beside(found)]
        left = some(left, each) if left else None
        if left is None or left.isEmpty():
            return found
        few, budget, each = stage(few.unionByName(left), "few"), 2 * budget, 2 * each


def _classes(vectors: DataFrame) -> DataFrame:
    """(id, vec, rep, place): vectors (id, vec) with the least id of those equal to them and their place among these, staged."""
    reps = stage(vectors.groupBy("vec").agg(F.min("id").alias("rep")), "classes")
    return stage(placed(vectors.join(reps, "vec"), [F.col("id").asc()], by=["rep"]), "members")


def _of_classes(graphs: list[CosineGraphs], merged: list[tuple[DataFrame, DataFrame]], pairs: int, most: int, budget: int) -> DataFrame | None:
    """cosine_assignments() where vectors have copies, which have the same edges: one of each stands for all in a flow.

    Members are paired by their places. None: a graph has over `most` edges even so, too many for a task.
    """
    kept = [g._replace(a=stage(a.filter("place = 0").select("id", "vec"), "vectors"), b=stage(b.filter("place = 0").select("id", "vec"), "vectors")) for g, (a, b) in zip(graphs, merged, strict=True)]

    def of_graphs(side: int, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
        named = [rows(m[side]).withColumn("graph", F.explode(F.array(*(F.lit(name) for name in g.thresholds)))) for g, m in zip(graphs, merged, strict=True)]
        return stage(reduce(DataFrame.unionByName, named), "members")

    ns, nd = (of_graphs(k, lambda m, end=end, n=n: m.groupBy(F.col("rep").alias(end)).agg(F.count("*").alias(n))) for k, end, n in ((0, "src", "ns"), (1, "dst", "nd")))

    def solve(few: DataFrame) -> DataFrame | None:
        if not few.groupBy("graph").count().filter(F.col("count") > most).isEmpty():
            return None
        return few.join(ns, ["graph", "src"]).join(nd, ["graph", "dst"]).groupBy("graph").applyInArrow(_solve_flow, f"{ASSIGNED}, n long")

    whole = None
    if sum(g.a.count() * g.b.count() for g in kept) <= pairs:  # all edges, where they are not too many
        whole = stage(reduce(DataFrame.unionAll, [g.edges() for g in kept]), "edges")
        whole = whole if whole.groupBy("graph").count().filter(F.col("count") > most).isEmpty() else None
    found = _proven(kept, budget, solve) if whole is None else stage(solve(whole), "tried")
    if found is None:
        return None
    before = lambda end, other: F.sum("n").over(Window.partitionBy("graph", end).orderBy(other)) - F.col("n")
    units = found.withColumns({"s": before("src", "dst"), "d": before("dst", "src")}).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    units = units.select("graph", F.col("src").alias("sr"), F.col("dst").alias("dr"), "in_cover", (F.col("s") + F.col("k")).alias("sp"), (F.col("d") + F.col("k")).alias("dp"))
    for k, end, r, p in ((0, "src", "sr", "sp"), (1, "dst", "dr", "dp")):
        units = units.join(of_graphs(k, lambda m, end=end, r=r, p=p: m.select(F.col("id").alias(end), F.col("rep").alias(r), F.col("place").alias(p))), ["graph", r, p])
    return units.select("graph", "src", "dst", "in_cover")


def _by_graph(edges: DataFrame, most: int) -> DataFrame:
    """A maximum matching of each graph with all edges searched: graphs in a task each, by component if one has over `most` edges."""
    if edges.groupBy("graph").count().filter(F.col("count") > most).isEmpty():
        return edges.groupBy("graph").applyInArrow(_solve, ASSIGNED)
    return _by_component(edges, most)


def _by_component(edges: DataFrame, most: int) -> DataFrame:
    """A maximum matching of each graph with all edges searched: components in a task each, giant ones by rounds."""
    e = stage(components(edges), "components")
    giant = e.groupBy("graph", "component").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("graph", "component")
    giant = stage(giant, "giant")
    if giant.isEmpty():
        return e.groupBy("graph", "component").applyInArrow(_solve, ASSIGNED)
    giant = F.broadcast(giant) if giant.limit(MOST_GIANTS + 1).count() <= MOST_GIANTS else giant
    small = e.join(giant, ["graph", "component"], "left_anti").groupBy("graph", "component").applyInArrow(_solve, ASSIGNED)
    return small.unionByName(by_rounds(e.join(giant, ["graph", "component"], "left_semi").select("graph", "src", "dst")))


#: Giant components whose names are broadcast.
MOST_GIANTS = 10_000


def by_rounds(edges: DataFrame) -> DataFrame:
    """(graph, src, dst, in_cover) of a maximum matching, by rounds over all edges: no task holds a component.

    A round searches breadth first from all free sources at once; a target belongs to the least root that reaches it,
    so the trees are apart. Once free targets are reached, each root that has one takes its least and the path to it is
    turned over. A search that reaches none proves the matching maximum, and what it has reached is the cover. Rounds
    are written to the shared folder; only whether there are rows reaches the driver.
    """
    e = stage(edges.distinct(), "edges")
    match = stage(e.limit(0), "match")
    while True:
        frontier = e.select("graph", "src").distinct().join(match, ["graph", "src"], "left_anti").withColumn("root", F.col("src"))
        seen, ends = None, None
        while ends is None:
            reach = frontier.join(e, ["graph", "src"]).groupBy("graph", "dst").agg(F.min(F.struct("root", F.col("src").alias("parent"))).alias("by"))
            reach = reach.select("graph", "dst", "by.root", "by.parent")
            layer = stage(reach if seen is None else reach.join(seen, ["graph", "dst"], "left_anti"), "layer")
            if layer.isEmpty():
                seen = e.limit(0).select("graph", "dst") if seen is None else seen.select("graph", "dst")
                covered = match.join(seen.withColumn("hit", F.lit(2)), ["graph", "dst"], "left")
                return covered.select("graph", "src", "dst", F.coalesce("hit", F.lit(1)).cast("int").alias("in_cover"))
            seen = layer if seen is None else stage(seen.unionByName(layer), "seen")
            free = layer.join(match, ["graph", "dst"], "left_anti")
            if not free.isEmpty():
                ends = free.groupBy("graph", "root").agg(F.min("dst").alias("dst")).select("graph", "dst")
            else:
                frontier = layer.join(match, ["graph", "dst"]).select("graph", "src", "root")
        turned = None
        while True:
            step = stage(ends.join(seen, ["graph", "dst"]).select("graph", F.col("parent").alias("src"), "dst"), "step")
            if step.isEmpty():
                break
            turned = step if turned is None else turned.unionByName(step)
            ends = step.select("graph", "src").join(match, ["graph", "src"]).select("graph", "dst")
        match = stage(match.join(turned, ["graph", "src"], "left_anti").unionByName(turned.select(*match.columns)), "match")


#: Ends of a cover that are broadcast.
MOST_COVER = 500_000


def uncovered(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Edges that the cover of a matching leaves out; none: the matching is proven maximum."""
    s = assigned.filter("in_cover = 1").select("graph", "src")
    d = assigned.filter("in_cover = 2").select("graph", "dst")
    s, d = (F.broadcast(x) if x.limit(MOST_COVER + 1).count() <= MOST_COVER else x for x in (s, d))
    return edges.select(F.col("graph").cast("string").alias("graph"), "src", "dst").join(s, ["graph", "src"], "left_anti").join(d, ["graph", "dst"], "left_anti")


def _candidates(edges: DataFrame, budget: int) -> DataFrame:
    """The edges to at most `budget` neighbours of each end, chosen by a hash; all of those of fewer."""
    out = None
    for end, other in (("src", "dst"), ("dst", "src")):
        w = Window.partitionBy("graph", end).orderBy(F.xxhash64("graph", "src", "dst"), other)
        few = edges.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= budget).drop("n")
        out = few if out is None else out.union(few)
    return out.distinct()


def certified(edges: DataFrame, budget: int = 32, growth: int = 4) -> tuple[DataFrame, list[int]]:
    """(assignments, budgets tried): a maximum matching found on candidate edges and proven on all of them.

    While the cover of the candidates' matching leaves an edge of the whole graph out, the budget grows; from the
    largest degree on all edges are candidates. That changes the time taken, not the size of the matching.
    """
    e = stage(edges.select(F.col("graph").cast("string").alias("graph"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "edges")
    degrees = [e.groupBy("graph", end).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 for end in ("src", "dst")]
    tried = []
    while True:
        whole = budget >= max(degrees)
        tried.append(budget)
        found = stage(assignments(e if whole else _candidates(e, budget)), "tried")
        if uncovered(e, found).isEmpty():
            return found, tried
        if whole:
            raise ValueError("a matching of the whole graph is not maximum")
        budget *= growth


def invalid_witness(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of chosen (graph, src, dst) that break a rule: not an edge, or a source or target used twice."""
    stray = chosen.select("graph", "src", "dst").join(edges.select("graph", "src", "dst"), ["graph", "src", "dst"], "left_anti").withColumn("why", F.lit("not an edge"))
    twice = lambda end: chosen.groupBy("graph", end).agg(F.count("*").alias("n"), F.min("src").alias("s"), F.min("dst").alias("d")).filter("n > 1").select("graph", F.col("s").alias("src"), F.col("d").alias("dst"), F.lit(f"{end} twice").alias("why"))
    return stray.unionAll(twice("src")).unionAll(twice("dst"))


def persistent(assigned: DataFrame, targets: int) -> DataFrame:
    """Sources matched in each of the graphs, which are matched independently."""
    return assigned.groupBy("src").agg(F.countDistinct("graph").alias("n")).filter(F.col("n") == targets).select("src")


def matched_fraction(assigned: DataFrame, width: int) -> DataFrame:
    """Matched sources of each graph over all `width` features, dead ones included."""
    return assigned.groupBy("graph").agg(F.count("*").alias("matched")).withColumn("proportion", F.col("matched") / F.lit(width))


def hall_triple(a: set, b: set, c: set) -> bool:
    """Whether three sets have distinct representatives."""
    return all(len(set().union(*x)) >= len(x) for x in ([a], [b], [c], [a, b], [a, c], [b, c], [a, b, c]))


def has_triple(a: Column, b: Column, c: Column) -> Column:
    """hall_triple for arrays; the three least members of each set are enough, as no union is asked for more than three."""
    size = lambda *x: F.size(reduce(F.array_union, x))
    return (F.size(a) >= 1) & (F.size(b) >= 1) & (F.size(c) >= 1) & (size(a, b) >= 2) & (size(a, c) >= 2) & (size(b, c) >= 2) & (size(a, b, c) >= 3)


def largest_weight_assignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, score) of an assignment of largest total cosine between dictionaries a and b (id, vec).

    It is solved in one task, which holds the product of the two sizes in numbers: dictionaries, not corpora.
    """
    rows = a.select(F.lit(0).alias("side"), "id", "vec").unionByName(b.select(F.lit(1).alias("side"), "id", "vec"))

    def solve(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        v = np.array(t.column("vec").to_pylist(), np.float64)
        order = np.lexsort((ids, side))
        side, ids, v = side[order], ids[order], v[order]
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        x, y = ids[side == 0], ids[side == 1]
        s = v[side == 0] @ v[side == 1].T
        pairs = maximum_weight(s) if len(x) and len(y) else []
        return pa.table({"src": pa.array([int(x[i]) for i, _ in pairs], pa.int64()), "dst": pa.array([int(y[j]) for _, j in pairs], pa.int64()), "score": pa.array([float(s[i, j]) for i, j in pairs], pa.float64())})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "src long, dst long, score double")


def maximum_weight(weights: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of an assignment of all rows of largest total weight (rows <= columns), by shortest paths."""
    cost = -np.asarray(weights, float)
    n, m = cost.shape
    if n > m:
        return sorted((j, i) for i, j in maximum_weight(np.asarray(weights).T))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            row = owner[j0]
            open_ = np.flatnonzero(~used[1:]) + 1
            reduced = cost[row - 1, open_ - 1] - u[row] - v[open_]
            better = reduced < least[open_]
            least[open_[better]], way[open_[better]] = reduced[better], j0
            j1 = open_[least[open_].argmin()]
            step = least[j1]
            np.add.at(u, owner[used], step)
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            j1 = way[j0]
            owner[j0] = owner[j1]
            j0 = j1
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])
