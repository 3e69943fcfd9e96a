"""Groups by shingle similarity: recall by kind of edit, links found past a failed one, the exact bar."""

import numpy as np
import pytest

from featlake.llm import near_dup

RNG = np.random.default_rng(7)


def words(n):
    return [f"w{x}" for x in RNG.integers(0, 5000, n)]


def similarity(x, y):
    a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (x, y))  # noqa: B905
    return len(a & b) / len(a | b)


def groups(spark, texts, **how):
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    return {r["doc_id"]: r["group_id"] for r in near_dup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def appended(w, extra):
    return w + words(extra)


def replaced(w, extra):
    at = len(w) // 3
    return w[:at] + words(extra // 2) + w[at + extra // 2 :]


@pytest.mark.parametrize("edit", [appended, replaced])
def test_recall_of_block_edits(spark, edit):
    texts, alike = {}, []
    for i in range(150):
        w = words(int(RNG.integers(100, 800)))
        texts[i], texts[1000 + i] = w, edit(w, int(len(w) * RNG.uniform(0.1, 0.2)))
        if similarity(w, texts[1000 + i]) >= 0.8:
            alike.append(i)
    got = groups(spark, texts)
    assert len(alike) > 80 and np.mean([got[i] == got[1000 + i] for i in alike]) > 0.97


def test_links_under_a_key_whose_least_text_fails(spark):
    """Two texts alike in 0.8 that meet only under keys with a third, which is like neither and has the least id."""
    texts, found = {}, 0
    keys = lambda w: set(near_dup.band_keys(near_dup.shingle_hashes(" ".join(w).encode())))
    for _ in range(5000):
        least = words(200)
        one = least[:60] + words(24) + least[84:]
        two = one[:-20] + words(20)
        if similarity(one, two) < 0.8 or similarity(least, one) >= 0.8 or similarity(least, two) >= 0.8:
            continue
        if (met := keys(one) & keys(two)) and met <= keys(least):
            texts |= {10 * found: least, 10 * found + 1: one, 10 * found + 2: two}
            found += 1
        if found == 3:
            break
    got = groups(spark, texts)
    assert found == 3 and all(got[i] == i - (i % 10 == 2) for i in texts)


@pytest.mark.parametrize("block", [near_dup.MEMBERS, 3])
def test_chain_of_alike_texts(spark, block):
    base = words(600)
    got = groups(spark, {99 - i: base[10 * i : 10 * i + 200] for i in range(30)} | {0: words(200)}, block=block)
    assert got.pop(0) == 0 and set(got.values()) == {70}


def test_meeting_equals_all_pairs():
    sets = [np.unique(RNG.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    node = np.arange(60)
    for bar in (0.4, 0.5, 0.6):
        pairs = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= bar * len(np.union1d(sets[i], sets[j]))]
        found = near_dup.alike(node, node, sets, bar)
        assert len(found) < 60
        roots = []
        for links in (pairs, found):
            g = node.copy()
            for i, j in links:
                g[g == g[i]] = g[j]
            roots.append([int(np.flatnonzero(g == x)[0]) for x in g])
        assert roots[0] == roots[1]


def test_bar_is_exact(spark):
    texts, alike = {}, {}
    for i in range(200):
        w = words(300)
        texts[i], texts[1000 + i] = w, w[: 260 + i % 20] + words(40 - i % 20)
        alike[i] = similarity(w, texts[1000 + i])
    got = groups(spark, texts)
    assert sum(0.76 < x < 0.8 for x in alike.values()) > 40
    assert not any(got[i] == got[1000 + i] for i, x in alike.items() if x < 0.8)


def test_golay_keys_find_pairs_without_a_band(spark, monkeypatch):
    """Candidates of the named method are linked, once verified, where no band of MinHashes is shared; others are not."""
    w = words(900)
    texts = {1: w, 2: w[:450] + words(1) + w[451:], 3: words(900)}
    monkeypatch.setattr(near_dup, "band_keys", lambda hashes: [])
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    fps = {r["doc_id"]: r["fp"] for r in near_dup.sketches(d).collect()}
    assert (fps[1] ^ fps[2]).bit_count() <= near_dup.MAX_BITS < (fps[1] ^ fps[3]).bit_count()
    got = {r["a"]: r["b"] for r in near_dup.golay_pairs(near_dup.sketches(d).withColumnRenamed("doc_id", "node")).collect()}
    assert got == {1: 2}
    assert groups(spark, texts) == {1: 1, 2: 1, 3: 3}


def test_texts_stay_where_they_are(spark):
    """Only ids move to pick the texts of candidates, whatever their number below the bound."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
        found = near_dup._texts_of(docs, spark.range(3, 5).withColumnRenamed("id", "node"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r["node"] for r in found.collect()) == [3, 4]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_unlike_sizes_are_not_read(spark):
    """Sets of which one is under 0.8 of the other cannot be alike in 0.8; an id of several texts keeps all its chances."""
    classes = spark.createDataFrame([(1, 100), (2, 80), (3, 79), (4, 10), (4, 125)], "node long, size long")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 4), (2, 4)], "a long, b long")
    assert sorted(map(tuple, near_dup._of_like_size(pairs, classes, 0.8).collect())) == [(1, 2), (1, 4)]
