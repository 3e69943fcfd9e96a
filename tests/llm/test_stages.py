"""The stages of the pipeline against plain Python on whole small tables."""

import re

import pytest

import corpus_pipeline as C
from featlake.llm import near_dup, pii, quality, substring

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, bar=0.8):
    """Least id of each text's component, over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        both = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if n >= bar * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    empty = [i for i, s in sets.items() if not s]
    for i in empty:
        root[find(i)] = min(find(i), min(empty))
    return {i: find(i) for i in sets}


def test_near_dedup_equals_all_pairs(spark, docs):
    """Planted copies, appended, shortened, templated and reordered texts, groups of one least text and the empty ones."""
    base = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    more, at = [], 100_000
    for k, (_, t) in enumerate(base[:120]):
        w = t.split()
        half = len(w) // 2
        more += [(at + 10 * k, " ".join(w + w[: len(w) // 8])), (at + 10 * k + 1, " ".join(w[: -max(1, len(w) // 9)])), (at + 10 * k + 2, " ".join(w[half:] + w[:half])), (at + 10 * k + 3, f"report {k} of the day " + " ".join(w[:90])), (at + 10 * k + 4, t.upper())]
    rows = base + more + [(300_000, ""), (300_001, None), (300_002, " \n")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in near_dup.similar_groups(table).collect()}
    assert sum(len(x) > 1 for x in {g: [i for i in want if want[i] == g] for g in want.values()}.values()) > 150
    wrong = [i for i in want if got[i] != want[i]]
    # what MinHash bands may miss at the bar itself: two in a thousand
    assert len(wrong) <= 0.002 * len(rows), wrong[:5]
    kept = {r["doc_id"] for r in C.near_dedup(spark, table, DATA).select("doc_id").collect()}
    assert kept == {i for i, g in got.items() if g == i}


def test_an_unrelated_text_does_not_part_two_alike(spark):
    """Three texts over the same words: one in order, one shuffled, and that with its last two words swapped."""
    import random

    w = [f"word{k}" for k in range(400)]
    mixed = w[:]
    random.Random(5).shuffle(mixed)
    swapped = mixed[:-2] + mixed[:-3:-1]
    for texts in ([w, mixed, swapped], [mixed, swapped]):
        rows = [(i, " ".join(t)) for i, t in enumerate(texts, 1)]
        got = {r["doc_id"]: r["group_id"] for r in near_dup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == groups(rows)


def test_quality_stage_keeps_what_the_scores_accept(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    want = {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in C.quality_filter(spark, docs, DATA).select("doc_id").collect()} == want


def without_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        bad = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                bad[s : s + 20] = [True] * 20
            seen.add(k)
        out[i] = b" ".join(x for x, b in zip(w, bad, strict=True) if not b).decode() if any(bad) else t or ""
    return out


def test_substring_stage_equals_plain_python(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = C.substring_dedup(spark, docs, DATA).collect()
    want = without_repeats(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want and sum(want[i] != (t or "") for i, t in rows) > 20
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_pii_stage_replaces_the_spans(spark, docs):
    found = {r["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in C.redact(spark, docs, DATA).collect():
        t, out, at = text[r["doc_id"]], "", 0
        for x in found[r["doc_id"]].split(",") if found[r["doc_id"]] else []:
            kind, a, z = x.split(":")
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(z))
        assert r["text"] == out + t[at:] and r["n_chars"] == len(r["text"])
    assert sum(bool(s) for s in found.values()) > 20
