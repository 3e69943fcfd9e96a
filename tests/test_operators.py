import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.operators import activations as A
from featlake.operators import cooccurrence as C
from featlake.operators import hierarchy as H
from featlake.operators import linalg as L
from featlake.operators import sampling as SM
from featlake.operators import similarity as S
from featlake.sources import files


def test_top_one_encode(spark):
    enc, bias = np.array([[1, -1, 0], [0, 0, 2]], float), np.array([2, 3], float)
    rows = spark.createDataFrame([(0, [4.0, 3.0]), (1, [1.0, 3.0]), (2, [2.0, 5.0]), (3, [2.0, 3.0])], "id long, x array<float>")
    got = sorted(map(tuple, A.encode(rows, "id", "x", enc, bias, 1).collect()))
    assert got == [(0, 0, 2.0), (1, 1, 1.0), (2, 2, 4.0)]


def test_signed_and_absolute_cosine(spark):
    a = spark.createDataFrame([(0, [0.7, 0.51**0.5]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    b = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<float>")
    pairs = lambda **k: {(r["src"], r["dst"]) for r in S.cosine_edges(a, b, 0.7, tile=2, **k).collect()}
    assert (0, 0) in pairs() and (1, 0) not in pairs() and (1, 0) in pairs(absolute=True)


def test_best_cosines_emit_one_row_a_tile(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = {k: rng.normal(size=5).tolist() for k in range(60)} | {70: [1.0, 0.0, 0.0, 0.0, 0.0], 71: [2.0, 0.0, 0.0, 0.0, 0.0], 72: [3.0, 0.0, 0.0, 0.0, 0.0]}
    a, b = (spark.createDataFrame([(k, x) for k, x in v.items() if k % 2 == r], "id long, vec array<double>") for r in (0, 1))
    emitted = []
    whole = S.best_match
    monkeypatch.setattr(S, "best_match", lambda scores: emitted.append(scores.count()) or whole(scores))
    got = {r["src"]: (r["dst"], r["score"]) for r in S.best_cosines(a, b, tile=8).collect()}
    assert emitted[0] <= 5 * a.count()  # tiles of b, not rows
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in v.items()}
    for k in v:
        if k % 2 == 0:
            s = {j: round(float(unit[k] @ unit[j]), 12) for j in v if j % 2}
            assert got[k][0] == min(j for j in s if s[j] == max(s.values())) and abs(got[k][1] - max(s.values())) < 1e-9


def test_zero_vector_is_an_error(spark):
    a = spark.createDataFrame([(0, [0.0, 0.0])], "id long, vec array<float>")
    with pytest.raises(Exception, match="no finite length"):
        S.normalised(a).collect()


def test_candidate_union(spark):
    nan = float("nan")
    fwd = spark.createDataFrame([(0, 0, 0.7), (0, 1, -0.9), (1, 0, nan), (1, -1, 0.9)], "src long, dst long, score double")
    rev = spark.createDataFrame([(0, 1, 0.8), (1, 0, 0.6)], "src long, dst long, score double")
    assert sorted(map(tuple, S.candidate_union(fwd, rev, 0.7, 2, 2).collect())) == [(0, 0), (1, 0)]


def test_bracketed_median_equals_exact(spark):
    for n in (1, 2, 7, 1000):
        a = spark.range(n).select(F.col("id").alias("row_id"), F.lit(0).alias("feature"), (F.pmod(F.xxhash64("id"), F.lit(997)) + 1).cast("float").alias("value"))
        assert A.pooled_median_bracketed(a).first()["median"] == A.pooled_median(a).first()["median"]


def test_tile_and_partition_do_not_matter(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))], "id long, vec array<float>")
    few = {(r["src"], r["dst"]) for r in S.cosine_edges(a, a, 0.5, tile=7).collect()}
    assert few == {(r["src"], r["dst"]) for r in S.cosine_edges(a, a, 0.5).collect()}


def test_shortcuts(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "d")], "parent string, child string")
    assert sorted(map(tuple, C.without_shortcuts(e).collect())) == [("a", "b"), ("a", "d"), ("b", "c")]


def test_pooled_mean(spark):
    pts = [("A", "x", w, 1.0) for w in range(9)] + [(c, "y", w, 0.0) for c in ("B1", "B2") for w in range(9)]
    df = spark.createDataFrame(pts, "category string, level string, width int, score double")
    cells = H.cells(H.regrets(df, ["category"], "score"), ["width"], 0.1)
    assert all(r["mean_score"] == pytest.approx(1 / 3) for r in cells.collect())
    assert H.check_trajectories(df, ["category"], "width", 9).count() == 0
    assert H.check_trajectories(df.unionAll(df.limit(1)), ["category"], "width", 9).count() == 1
    assert H.check_trajectories(df.filter("width <> 3 or category <> 'A'"), ["category"], "width", 9).count() == 1


def test_prefix_targets(spark):
    rows = spark.createDataFrame([(0, "ab", "test"), (1, "ac", "train"), (2, "bb", "test")], "id long, t string, split string")
    targets, member = H.prefix_targets(rows, "id", "t", (1,), 2)
    assert [tuple(r) for r in targets.collect()] == [(1, "a", 2)] and sorted(r["row_id"] for r in member.collect()) == [0, 1]


def test_reservoir_merges(spark):
    a = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("feature"), ((F.col("id") % 50 + 1) / 100.0).cast("float").alias("value"))
    p = F.xxhash64("row_id")
    whole = set(map(tuple, SM.reservoir(a, p, 4).select("feature", "bin", "slot", "row_id").collect()))
    parts = [SM.reservoir(a.filter(F.col("row_id") % 2 == k), p, 4) for k in (0, 1)]
    assert whole == set(map(tuple, SM.merge_reservoirs(*parts, 4).select("feature", "bin", "slot", "row_id").collect()))


def test_text(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" a \t b ",), ("5% & {x}_\\",)], "t string")
    assert [r[0] for r in df.select(T.normalise_space(F.col("t"))).collect()] == ["[EMPTY]", "[EMPTY]", "a b", "5% & {x}_\\"]
    assert df.filter("t like '5%'").select(T.latex(F.col("t"))).first()[0] == r"5\% \& \{x\}\_\textbackslash{}"


def test_unsafe_paths(spark):
    bad = ["../escape", "/absolute", "x/../../escape", "a\\b", "a//b", "./a"]
    df = spark.createDataFrame([(p,) for p in [*bad, "a/b.c"]], "p string").select("p", files.safe_path(F.col("p")).alias("ok"))
    assert {r["p"] for r in df.collect() if r["ok"]} == {"a/b.c"}


def test_csv_keeps_quotes_and_breaks(spark, tmp_path):
    rows = [("a\nb", 'x "y"', ""), ("c,d", "e", "f")]
    files.write_csv(spark.createDataFrame(rows, "a string, b string, c string"), f"{tmp_path}/x")
    got = files.read_csv(spark, f"{tmp_path}/x", ["a", "b"])
    assert sorted(tuple(v or "" for v in r) for r in got.collect()) == sorted(rows)
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/x", ["zz"])


def test_pursuit_recovers_support():
    rng = np.random.default_rng(1)
    atoms = rng.normal(size=(30, 12))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    target = 3 * atoms[4] - 2 * atoms[17]
    chosen, w, rest = L.pursue(atoms, target, 1e-6, 12)
    assert {4, 17} <= set(chosen) and rest <= 1e-6


def test_subset_sampler_is_exact():
    w = np.array([1.0, 2.0, 3.0])
    s = L.subsets(3, 2, w, np.random.default_rng(0), 20000)
    assert (s[:, 0] < s[:, 1]).all()
    share = {p: np.mean((s == p).all(1)) for p in ((0, 1), (0, 2), (1, 2))}
    assert all(abs(share[p] - w[list(p)].prod() / 11) < 0.02 for p in share)


def test_pca_matches_covariance(spark):
    x = np.random.default_rng(2).normal(size=(200, 4)) * [3, 2, 1, 0.5]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    _, values, parts = L.pca(L.gram(df, "v"), 4)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    assert np.allclose(parts @ parts.T, np.eye(4))
