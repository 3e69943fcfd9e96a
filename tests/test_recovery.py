"""Recovery, k-means, encoders, bundles, places and quantiles, certified matchings: against plain Python."""

import json
import tarfile
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.functions import workflow as W
from featlake.operators import activations as A
from featlake.operators import cooccurrence as C
from featlake.operators import graph, order, recovery, sampling, temporal
from featlake.operators import matching as M
from featlake.operators import similarity as S
from featlake.sources import bundles, encode
from featlake.sources import files
from featlake.streaming import streams

RNG = np.random.default_rng(11)


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")


# places and quantiles


def test_places_and_running_sums(spark):
    rows = [(f"g{i % 3}", int(v), i, int(w)) for i, (v, w) in enumerate(zip(RNG.integers(0, 9, 200), RNG.integers(0, 5, 200), strict=True))]
    d = spark.createDataFrame(rows, "g string, v int, i int, w long").repartition(7)
    whole = sorted(rows, key=lambda r: (r[1], r[2]))
    assert {r["i"]: r["place"] for r in order.placed(d, [F.desc("v"), F.asc("i")]).collect()} == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    by, before = {}, {}
    for g in ("g0", "g1", "g2"):
        mine = [r for r in whole if r[0] == g]
        by |= {r[2]: k for k, r in enumerate(mine)}
        before |= {r[2]: sum(x[3] for x in mine[:k]) for k, r in enumerate(mine)}
    assert {r["i"]: r["place"] for r in order.placed(d, [F.asc("v"), F.asc("i")], by=["g"]).collect()} == by
    assert {r["i"]: r["before"] for r in order.running(d, [F.asc("v"), F.asc("i")], "w", by=["g"]).collect()} == before
    assert order.placed(d.limit(0), [F.asc("i")]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_quantiles_equal_numpy(spark, n):
    v = RNG.integers(0, 50, n) / 7
    d = spark.createDataFrame([(k % 2, float(x)) for k, x in enumerate(v)] + [(0, None)], "g int, v double")
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    assert list(order.quantiles(d, "v", points).first()) == pytest.approx([np.quantile(v, p) for p in points.values()])
    for r in order.quantiles(d, "v", points, ["g"]).collect():
        assert list(r)[1:] == pytest.approx([np.quantile(v[r["g"] :: 2], p) for p in points.values()])
    assert order.quantiles(d.filter("v < 0"), "v", {"a": 0.5}).first()["a"] is None


def test_a_misleading_sample_does_not_change_the_median(spark):
    a = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(RNG.lognormal(size=501))], "row_id long, feature int, value double")
    want = float(np.median([r["value"] for r in a.collect()]))
    assert [A.pooled_median_bracketed(a, k).first()["median"] for k in (1, 2, 9, 1000)] == [want] * 4


def test_split_halves_each_stratum(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else f"s{i % 5}") for i in range(103)], "k long, s string")
    n = {(r["s"], r["split"]): r["count"] for r in sampling.stratified_half(d, "k", "s", 3).groupBy("s", "split").count().collect()}
    assert sum(n.values()) == 103 and all(n[s, "train"] - n[s, "test"] in (0, 1) for s in (None, "s1", "s2", "s3", "s4"))


def test_shard_batches(spark):
    d = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 100 + i) for i in range(90)], "s string, r long")
    got = {}
    for r in sampling.shard_batches(d, "s", "r", 40, 16, 5).collect():
        got.setdefault(r["draw"], []).append((r["place"], r["shard"], r["row"]))
    assert len(got) == 40 and 20 <= sum(x[0][1] == "b" for x in got.values()) < 40
    for x in got.values():
        rows = [r for _, _, r in sorted(x)]
        assert len({s for _, s, _ in x}) == 1 and max(rows) - min(rows) == len(rows) - 1 == (9 if x[0][1] == "a" else 15)
        assert rows != sorted(rows)


# co-occurrence


@pytest.mark.parametrize(("tile", "rows", "least"), [(1024, 20_000, 1), (7, 20_000, 3), (7, 15, 1), (5, 9, 4)])
def test_counts_equal_all_pairs(spark, tile, rows, least):
    baskets = [(r, f"f{f}") for r in range(60) for f in range(40) if RNG.random() < (0.9 if r % 9 == 0 else 0.08)]
    d = spark.createDataFrame(baskets, "row_id long, feature string")
    of = {}
    for r, f in baskets:
        of.setdefault(r, set()).add(f)
    want = {}
    for fs in of.values():
        for a in fs:
            for b in fs:
                if a <= b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = {(r["i"], r["j"]): r["n"] for r in C.counts(d, least, tile, rows).collect()}
    assert got == {k: n for k, n in want.items() if n >= least}
    assert C.counts(d.limit(0)).count() == 0


def test_counts_move_each_entry_once_more_than_there_are_tiles():
    """A row in 4 tiles of 2 entries: ten pairs of tiles, 4 * 5 * 2 less the repeated lists of four diagonals; a long feature is counted in parts."""
    codes = pa.array([[t * 65536 + x for t in range(4) for x in (3, 9)]], pa.list_(pa.int32()))
    dealt = pa.Table.from_batches(C._dealt([pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), codes], ["s", "codes"])]))
    assert dealt.num_rows == 10 and dealt.schema.field("la").type.value_type == pa.int16()
    assert sum(len(x) for c in ("la", "lb") for x in dealt.column(c).to_pylist()) == 2 * 4 * 4
    fa = np.zeros(3000, np.int16)
    got = [(i.tolist(), j.tolist(), n.tolist()) for i, j, n in C._pairs_of(fa, np.arange(3001), np.tile(np.arange(200, dtype=np.int16), 3000), np.arange(3001) * 200, 1)]
    assert got == [([0] * 200, list(range(200)), [3000] * 200)]


def test_neighbours_and_edges_without_all_pairs(spark):
    d = spark.createDataFrame([(r, f"f{f:02}") for r in range(120) for f in range(30) if RNG.random() < 1 / (1 + f % 6) or (f == 7 and r % 5 == 0)], "row_id long, feature string")
    pairs = C.counts(d, 3)
    for f in ("f00", "f07", "none"):
        want = C.neighbours(pairs, F.lit(f), 6).collect()
        assert C.beside(d, f, 6, 3).collect() == want and (f == "none") == (want == [])
    how = {"support": 5, "overlap": 4, "wilson": 0.3, "reverse": 0.9, "lift": 0.5}
    want = sorted(C.containment(pairs, F.lit(120), **how).collect())
    assert sorted(C.containment(C.counts(d, 3, own=C.numbered(d, 3)), F.lit(120), **how).collect()) == want and len(want) > 20


def test_interval_join_of_spans_of_any_length(spark):
    points = [(i, float(x)) for i, x in enumerate(RNG.uniform(-100, 100, 300))] + [(900 + i, 5.0) for i in range(40)]
    spans = [(i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(RNG.uniform(-120, 100, 50), 10 ** RNG.uniform(-3, 4, 50), strict=True))] + [(77, 3.0, 3.0), (78, 4.0, 2.0)]
    got = temporal.interval_join(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, lo double, hi double"), "x", "lo", "hi", 2.0)
    rows = [(r["p"], r["s"]) for r in got.collect()]
    assert sorted(rows) == sorted((p, s) for p, x in points for s, lo, hi in spans if lo <= x < hi)


# graphs and matchings


def test_components_of_named_graphs(spark):
    e = [("a", i, i + 1) for i in range(50)] + [("b", 2 * i, 2 * i + 2) for i in range(20)] + [("b", 1, 1)]
    got = {(r["graph"], r["node"]): r["root"] for r in graph.connected_components(spark.createDataFrame(e, "graph string, a long, b long"), ["graph"]).collect()}
    assert got == {("a", i): 0 for i in range(51)} | {("b", 2 * i): 0 for i in range(21)}


@pytest.mark.parametrize("seed", range(3))
def test_certified_matching_is_maximum(spark, seed):
    rng = np.random.default_rng(seed)
    m = rng.random((25, 21)) < rng.uniform(0.05, 0.9)
    e = spark.createDataFrame([("g", int(i), int(j)) for i, j in np.argwhere(m)], "graph string, src long, dst long")
    found, tried = M.certified(e, 1)
    near = {int(i): [int(j) for j in np.flatnonzero(r)] for i, r in enumerate(m) if r.any()}
    assert found.count() == len(M.maximum_matching(near)) and M.invalid_witness(e, found).count() == 0
    assert tried == [4**k for k in range(len(tried))]


def test_triples_of_truncated_sets(spark):
    sets = [{1}, {2}, {1, 2}, {1, 2, 3}, {3, 4, 5, 6}, set()]
    rows = [(i, j, k, sorted(a)[:3], sorted(b)[:3], sorted(c)[:3]) for i, a in enumerate(sets) for j, b in enumerate(sets) for k, c in enumerate(sets)]
    d = spark.createDataFrame(rows, "i int, j int, k int, a array<int>, b array<int>, c array<int>")
    for r in d.withColumn("y", M.has_triple(F.col("a"), F.col("b"), F.col("c"))).collect():
        a, b, c = (sets[r[x]] for x in "ijk")
        assert r["y"] == any(len({x, y, z}) == 3 for x in a for y in b for z in c) == (all((a, b, c)) and M.hall_triple(a, b, c))


def test_largest_weight_of_dictionaries(spark):
    a, b = RNG.normal(size=(4, 3)), RNG.normal(size=(5, 3))
    s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    got = M.largest_weight_assignment(vectors(spark, a), vectors(spark, b, 10)).collect()
    assert sum(r["score"] for r in got) == pytest.approx(max(sum(s[i, c] for i, c in enumerate(p)) for p in permutations(range(5), 4)))


# similarity


def test_cosine_median(spark):
    v = RNG.normal(size=(31, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    n, median = S.cosine_median(vectors(spark, v), tile=7)
    assert n == 31 * 30 // 2 and median == pytest.approx(np.median((u @ u.T)[np.triu_indices(31, 1)]))
    assert S.cosine_median(vectors(spark, v[:1]))[0] == 0


def test_k_means_is_that_of_plain_loops_and_resumes(spark):
    x = np.vstack([RNG.normal(size=(40, 3)) + 6 * k for k in range(3)])
    d = vectors(spark, x).repartition(5)
    folder = files.fresh(spark, "fit")
    S.k_means(d, "id", "vec", 3, 2, 1, folder)
    centres, history = S.k_means(d, "id", "vec", 3, 6, 1, folder)
    straight, again = S.k_means(d, "id", "vec", 3, 6, 1)
    assert np.allclose(centres, straight) and np.allclose(history, again) and history == sorted(history, reverse=True)
    first = [r["vec"] for r in d.orderBy(sampling.hash_order(1, "id"), "id").limit(3).collect()]
    c = np.array(first)
    for k in range(6):
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        assert history[k] == pytest.approx(((x - c[near]) ** 2).sum())
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(3)])
    assert np.allclose(c, centres)
    warm, one = S.k_means(d, "id", "vec", 3, 1, 1, start=centres)
    assert one[0] <= history[-1] + 1e-9 and warm.shape == (3, 3)
    with pytest.raises(ValueError, match="another fit"):
        S.k_means(d, "id", "vec", 3, 7, 2, folder)


# recovery


def test_families_equal_plain_loops(spark):
    a, b = RNG.normal(size=(21, 5)), RNG.normal(size=(40, 5))
    b[3] = a[6]  # the parent of a family itself: nothing is left of it beside the parent
    bars = (0.5, 0.7, 0.9)
    atoms = spark.createDataFrame([(i // 3, i % 3, v.tolist()) for i, v in enumerate(a)], "family long, part long, vec array<double>")
    got = {r["family"]: r for r in recovery.families(atoms, vectors(spark, b), bars, tile=9).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    ua, ub = unit(a), unit(b)
    for f in range(7):
        p = ua[3 * f]
        off = lambda m: m - np.outer(m @ p, p)
        rest = off(ub)
        live = np.linalg.norm(rest, axis=1) > 1e-6
        near = np.vstack([np.abs(ub @ p), np.abs(unit(off(ua[3 * f + 1 : 3 * f + 3])) @ np.where(live[:, None], rest, 1.0).T / np.where(live, np.linalg.norm(rest, axis=1), 1.0)) * live])
        assert [got[f][c] for c in ("parent", "child_a", "child_b")] == pytest.approx(near.max(1).tolist())
        for t, bar in enumerate(bars):
            s = [set(np.flatnonzero(r >= bar).tolist()) for r in near]
            assert got[f]["recovered"][t] == any(len({x, y, z}) == 3 for x in s[0] for y in s[1] for z in s[2])


def test_activation_recovery_equals_plain_loops(spark):
    rows, features, targets = 60, 6, 4
    z = np.where(RNG.random((2 * rows, features)) < 0.4, RNG.choice([0.005, 0.04, 0.12, 0.35, 0.9, 1.2], (2 * rows, features)), 0).astype(np.float32)
    y = RNG.random((2 * rows, targets)) < 0.3
    y[:, 3] = False
    y[:3, 3] = True  # a target that no feature may meet
    z[:3] = 0
    acts = spark.createDataFrame([(int(r), int(f), float(z[r, f])) for r, f in np.argwhere(z > 0)], "row_id long, feature int, value float")
    member = spark.createDataFrame([(int(r), int(t)) for r, t in np.argwhere(y)], "row_id long, target int")
    train = (acts.filter(F.col("row_id") < rows), member.filter(F.col("row_id") < rows))
    test = (acts.filter(F.col("row_id") >= rows), member.filter(F.col("row_id") >= rows))
    f1 = np.zeros((targets, features, 16))
    test_f1 = np.zeros_like(f1)
    for part, out in ((slice(0, rows), f1), (slice(rows, None), test_f1)):
        for h, bar in enumerate(recovery.ACTIVATION_THRESHOLDS):
            fired = z[part] > np.float32(bar)
            out[:, :, h] = 2 * (y[part].T.astype(int) @ fired.astype(int)) / np.maximum(1, y[part].sum(0)[:, None] + fired.sum(0)[None])
    best, tid = f1.max(2), f1.argmax(2)
    selected = recovery.select_activations(*train)
    assert {(r["target"], r["feature"]): (r["h"], pytest.approx(r["f1"])) for r in selected.collect()} == {(t, f): (tid[t, f], best[t, f]) for t, f in np.argwhere(best > 0)}
    neurons = recovery.best_neurons(selected, train[1])
    for r in recovery.evaluate_pairs(neurons, *test).collect():
        f = best[r["target"]].argmax()
        assert (r["feature"], r["h"]) == (f, tid[r["target"], f] if best[r["target"], f] else 0)
        assert r["test_f1"] == pytest.approx(test_f1[r["target"], f, r["h"]])
    goal = float(np.sort(best[:3].max(1))[0])
    pairs = recovery.distinct_neurons(selected, goal).collect()
    near = {t: [int(f) for f in np.flatnonzero(best[t] >= goal)] for t in range(targets) if (best[t] >= goal).any()}
    assert len(pairs) == len(M.maximum_matching(near)) == len({r["feature"] for r in pairs})


# encoders


def test_requests_stay_within_the_budget():
    texts = ["x" * n for n in RNG.integers(0, 700, 300)] + ["y" * 9000]
    cut = list(encode.requests(texts, 500, 20))
    assert [s for s, _ in cut] == [0, *[e for _, e in cut[:-1]]] and cut[-1][1] == len(texts)
    assert all(e - s == 1 or (sum(-(-len(t) // 3.5) for t in texts[s:e]) <= 500 and e - s <= 20) for s, e in cut)


def test_requests_are_tried_again_and_halved():
    waits, calls = [], []

    def encoder(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        if len(calls) % 3 == 0:
            raise encode.Busy
        return encode.Hashing()(texts)

    texts = [f"a b{k}" for k in range(9)]
    assert (encode.ask(encoder, texts, sleep=waits.append) == encode.Hashing()(texts)).all() and waits and calls[0] == 9

    def never(texts):
        raise encode.Busy

    waits.clear()
    with pytest.raises(encode.Busy):
        encode.ask(never, texts, sleep=waits.append)
    assert waits == [0.5, 1.0, 2.0, 4.0]
    with pytest.raises(ValueError, match="other rows"):
        encode.ask(lambda t: np.zeros((1, 2)), texts)


def test_embedding_sources_agree_with_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(9000, None), (9001, "")], "doc_id long, text string"))
    h = F.xxhash64("w")
    w = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    want = {(r[0], r[1]): r[2] for r in w.groupBy("doc_id", F.pmod(h, F.lit(16)).cast("int")).agg(F.sum(F.when(h > 0, 1).otherwise(-1))).collect()}
    got = {r["doc_id"]: r["embedding"] for r in encode.embed(docs, "doc_id", "text", encode.Hashing, budget=2000).collect()}
    assert set(got) == {k for k, _ in want} and all(x == want.get((k, i), 0) for k, v in got.items() for i, x in enumerate(v))


def test_jobs_restore_order_and_report_gaps(spark):
    docs = spark.createDataFrame([(k, f"text {k} é") for k in (5, 3, 11, 2)], "k long, t string")
    answers = encode.run_jobs(spark, encode.submit(docs, "k", "t", 3), encode.Hashing)
    rows, faults = encode.collect_jobs(docs, "k", answers)
    assert [r["k"] for r in rows.orderBy("place").collect()] == [2, 3, 5, 11] and faults.count() == 0
    rows, faults = encode.collect_jobs(docs.unionAll(spark.createDataFrame([(99, "x")], docs.schema)), "k", answers)
    assert [tuple(r) for r in faults.collect()] == [(99, 0)]


# bundles


def test_bundles(tmp_path):
    root = tmp_path / "a"
    (root / "deep").mkdir(parents=True)
    (root / "x.txt").write_text("x")
    (root / "deep/y.bin").write_bytes(b"\0\1")
    bundles.seal(root, "k", {"n": 1})
    one = bundles.archive(root, tmp_path / "one.tar.gz")
    (root / "x.txt").touch()
    assert one == bundles.archive(root, tmp_path / "two.tar.gz")
    with pytest.raises(FileExistsError):
        bundles.archive(root, tmp_path / "two.tar.gz")
    assert bundles.unpack(tmp_path / "one.tar.gz", tmp_path / "out")["kind"] == "k" and (tmp_path / "out/deep/y.bin").read_bytes() == b"\0\1"
    (root / "x.txt").write_text("z")
    (root / "more").write_text("z")
    assert bundles.problems(root) == [("x.txt", "changed"), ("more", "unlisted")]
    with pytest.raises(ValueError):
        bundles.archive(root, tmp_path / "three.tar")
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    manifest["files"] += [manifest["files"][0], {"path": "../out", "bytes": 1, "sha256": ""}, {"path": "gone", "bytes": 1, "sha256": ""}]
    (tmp_path / "out/manifest.json").write_text(json.dumps(manifest))
    assert {p for _, p in bundles.problems(tmp_path / "out")} == {"listed twice", "unsafe", "missing"}


def test_hostile_archives_are_refused(tmp_path):
    for k, (name, kind) in enumerate([("../x", tarfile.REGTYPE), ("/x", tarfile.REGTYPE), ("x", tarfile.SYMTYPE)]):
        with tarfile.open(tmp_path / f"{k}.tar", "w") as tar:
            m = tarfile.TarInfo(name)
            m.type, m.linkname = kind, "/etc/passwd"
            tar.addfile(m)
        with pytest.raises(ValueError):
            bundles.unpack(tmp_path / f"{k}.tar", tmp_path / f"out{k}")
        assert not (tmp_path / f"out{k}").exists()


# text and workflow


def test_repair_by_runs():
    once = lambda t, code="latin-1": t.encode("utf-8").decode(code)
    assert T.mend(f"fine é, {once('für')} and {once('日本')}") == "fine é, für and 日本"
    assert T.mend(once(once("naïve"))) == "naïve" and T.mend(once("€5", "cp1252")) == "€5"
    assert T.mend("Ã") == "Ã" and T.mend("Âx") == "Âx" and T.mend("") == ""
    assert T.cleaned("a’b—c​\x07\td﻿") == "a'b--c d"


def test_folded_and_floor(spark):
    d = spark.createDataFrame([("  ﬁ  Ⅳ\tStraße ", 0.1), (None, 0.3), ("x", 1e-46), ("y", -0.1)], "t string, x double")
    got = d.select(T.folded(F.col("t")).alias("f"), "x", T.floor_float32(F.col("x")).alias("y")).collect()
    assert got[0]["f"] == "fi iv strasse" and got[1]["f"] is None
    for r in got:
        y = np.float32(r["y"])
        assert float(y) <= r["x"] < float(np.nextafter(y, np.float32(np.inf)))


def test_commands_and_variables_as_columns(spark):
    lines = [["run", "--api-key", "abc", "--token=t=u", "--width", "5"], ["--password", "--secret", "x"], ["x", "--TOKEN"], ["token", "a=b"], []]
    d = spark.createDataFrame([(x,) for x in lines], "a array<string>")
    assert [r[0] for r in d.select(W.redacted(F.col("a"))).collect()] == [W.redact_command(x) for x in lines]
    d = spark.createDataFrame([("${a}/${b}", "1", "${a}"), ("x$${a}${b}", "1", "2"), ("none $ {a}", "1", "2")], "t string, a string, b string")
    got = d.select(W.substituted(F.col("t"), {"a": F.col("a"), "b": F.col("b")})).collect()
    assert [r[0] for r in got] == ["1/${a}", "x${a}2", "none $ {a}"]
    with pytest.raises(Exception, match="no variable zz"):
        d.select(W.substituted(F.lit("${zz}"), {"a": F.col("a")})).collect()


# streams


def test_streams_go_on_after_a_restart(spark):
    folder, table = files.fresh(spark, "feed"), files.fresh(spark, "table")
    merge = lambda b, old: b if old is None else b.unionByName(old)
    d = spark.range(100)
    for k in range(4):
        d.filter(F.col("id") % 4 == k).write.mode("append").parquet(folder)
        # each call knows nothing of the one before but the table's folder
        path = streams.merge_batches(streams.read_files(spark, folder, d.schema, 1), table, merge)
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [i for i in range(100) if i % 4 <= k]
    assert streams.merge_batches(streams.read_files(spark, folder, d.schema, 1), table, merge) == path  # nothing new
    assert len(files.children(spark, table)) <= 2


def test_drained_sums_go_on_after_a_restart(spark):
    folder, at = files.fresh(spark, "feed"), files.fresh(spark, "sums")
    d = spark.range(90).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("v"))
    for part in (0, 1):
        d.filter(F.col("v") % 2 == part).write.mode("append").parquet(folder)
        out = streams.drain(streams.moments(streams.read_files(spark, folder, d.schema, 1), "k", F.col("v")), "complete", at)
    assert {r["k"]: (r["n"], r["s1"]) for r in out.collect()} == {str(k): (30, sum(range(k, 90, 3))) for k in range(3)}


def test_passes_count_each_pair_of_tiles_once_and_bound_what_moves(spark):
    for tiles in (1, 2, 9, 17, 200):
        ranges = C.passes(tiles)
        assert [a for a, _ in ranges] == [0, *(b for _, b in ranges[:-1])] and ranges[-1][1] == tiles
        assert all(sum((2 * (tiles - a) - 1) / tiles for a in range(*r)) <= C.MOVED for r in ranges)
    baskets = [(r, f"f{f}") for r in range(50) for f in range(40) if RNG.random() < 0.3]
    d = spark.createDataFrame(baskets, "row_id long, feature string")
    whole, parts = (sorted(C.counts(d, 2, 5, rows, moved=moved).collect()) for rows, moved in ((100, 100), (20, 1)))
    assert len(C.passes(8, 1)) > 3 and whole == parts
    how = {"support": 5, "overlap": 4, "wilson": 0.3, "reverse": 0.9, "lift": 0.5}
    edges = lambda p: C.containment(p, F.lit(50), **how)
    own = C.numbered(d, 2, 5)
    assert sorted(C.counts(d, 2, own=own, then=edges, moved=1).collect()) == sorted(edges(C.counts(d, 2, 5)).collect())
