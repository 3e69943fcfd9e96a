"""Texts made to confuse hashes, and columns named like the operators' own, through every operator and stage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from featlake.llm import substring

DATA = "/root/testdata/sf0.001"
#: Names that operators use, or might.
ODD = ["_text", "_email", "_x", "_id", "_key", "_th", "_firsts", "found", "redacted", "n_words", "n_removed", "kept", "row", "body", "key", "id", "th", "firsts", "root", "digest", "group_id", "a.b", "q`t"]


def mirrored(n):
    """Two words of 2^n letters, one with the letters of the other swapped: polynomials modulo 2^64 cannot tell them apart."""
    t = "".join("ab"[k.bit_count() & 1] for k in range(1 << n))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_mirrored_words_are_told_apart(spark):
    shared = " ".join(f"w{k}" for k in range(19))
    one, two = mirrored(10)
    rows = [(0, f"{shared} {one}"), (1, f"{shared} {two}"), (2, f"{shared} {one}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.removed_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 20}


def test_mirrored_runs_of_words_are_told_apart():
    for lane in (substring._FIRST, substring._SECOND):
        hashes = []
        for text in mirrored(12):
            x = " ".join(text).encode()
            hashes.append(set(substring.Words(np.frombuffer(x, np.uint8), np.array([0, len(x)])).runs(lane, substring.WINDOW).tolist()))
            assert len(hashes[-1]) == len({text[k : k + 20] for k in range(len(text) - 19)})


def test_word_hashes_follow_the_bytes():
    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(list("ab"), n)) for n in [*range(1, 40)] * 20] + ["x" * n for n in (255, 256, 257, 5000)] + ["x" * 4999 + "y", "é", "è"]
    raw = " ".join(made).encode()
    w = substring.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    for lane in (substring._FIRST, substring._SECOND):
        h = w.runs(lane, 1).tolist()
        assert len(h) == len(made) and len(set(zip(made, h, strict=True))) == len(set(made)) == len(set(h))


@pytest.mark.parametrize(("most", "bits"), [(0, 20), (1 << 12, 20), (1 << 20, 25), (1 << 30, 29)])
def test_bitmap_follows_the_count(spark, most, bits):
    found = substring._bitmap(spark.range(0, 50).select(F.col("id").alias("h")), most)
    assert 8 * len(found) == 1 << bits and np.unpackbits(found, bitorder="little").nonzero()[0].tolist() == [*range(50)]


def test_the_query_merges_and_compacts(spark, monkeypatch):
    logs = []
    made = substring.Log.__init__
    monkeypatch.setattr(substring.Log, "__init__", lambda self, *a, **k: (made(self, *a, **k), logs.append(self), setattr(self, "seen", []))[0])
    commit = substring.Log.commit
    monkeypatch.setattr(substring.Log, "commit", lambda self, *a: (self.seen.append(len(self.names)), commit(self, *a))[1])
    substring.removed_words(spark.read.parquet(f"{DATA}/documents.parquet")).count()
    assert logs[0].seen == [0, 1, 2, 1] and len(logs[0].names) == 2 and logs[0].names[0].startswith("merged")


def test_columns_of_any_name_come_through_the_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.select("*", *(F.lit(f"v{k}").alias(n) for k, n in enumerate(ODD)))
    for name, step in C.STAGES[:-1]:
        odd = C.stage(step(spark, odd, DATA), name)
        assert odd.columns == [*docs.columns, *ODD], name
        first = odd.first().asDict()
        assert {n: first[n] for n in ODD} == {n: f"v{k}" for k, n in enumerate(ODD)}, name
    want = odd.count()
    assert C.STAGES[-1][1](spark, odd, DATA).select("doc_id").distinct().count() == want


def test_pipeline_of_an_empty_and_a_null_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    nothing = spark.createDataFrame([(None,) * 5, (None,) * 5, (3, None, None, None, None), (4, "", "", "", 0), (4, "", "", "", 0)], docs.schema)
    for rows in (docs.limit(0), nothing):
        at = rows
        for name, step in C.STAGES[1:-1]:
            at = C.stage(step(spark, at, DATA), name)
            assert at.columns == docs.columns, name
        assert at.count() == (0 if rows.isEmpty() else 5 - 2)
        tokens = C.STAGES[-1][1](spark, at, DATA).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
        assert all(r["n"] in (1, 2) for r in tokens)


def test_kept_text_is_that_of_the_digest(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).select("doc_id", "text").collect()}
    for r in substring.removed_words(docs).collect():
        assert hashlib.sha256(b" ".join((text[r["doc_id"]] or "").encode().split())).hexdigest() == r["kept_sha256"]
