"""The two byte networks against plain loops over single chunks and windows; what they are fitted on; ties of turns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.llm import chat, language, quality

RNG = np.random.default_rng(12)


def made(n):
    return [b"", b"a", b"x" * 15, b"x" * 16, b"x" * 17, bytes(RNG.integers(0, 256, 700, dtype=np.uint8).tolist()), *(bytes(RNG.integers(32, 122, int(k), dtype=np.uint8).tolist()) for k in RNG.integers(1, 900, n))]


def buffers(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


@pytest.mark.parametrize("slab", [64, 1 << 17])
def test_quality_equals_plain_loops(slab, monkeypatch):
    monkeypatch.setattr(quality, "SLAB", slab)
    texts = made(40)
    m = quality.train(texts, [len(t) % 2 for t in texts])
    got = quality.probability(quality.pooled(*buffers(texts), m), m)
    for text, p in zip(texts, got, strict=True):
        best = np.full(quality.FILTERS, -np.inf)
        k = 0
        while True:
            part = list(text[k : k + quality.WIDTH])
            part += [quality.PAD] * (quality.WIDTH - len(part))
            best = np.maximum(best, m["embed"][part].reshape(-1) @ m["conv"] + m["bias"])
            if k + quality.WIDTH >= len(text):
                break
            k += quality.STRIDE
        assert p == pytest.approx(1 / (1 + np.exp(-(np.tanh(best) @ m["out"] + m["out_bias"]))), abs=1e-5)


def test_language_equals_plain_loops():
    texts = [t for t in made(30) if t]
    m = language.train([t * 3 for t in texts], ["ab"[len(t) % 2] for t in texts])
    names, got = language.predict(*buffers(texts), m)
    mask = language._mask().reshape(language.WIDEST, language.EMBED, language.FILTERS)
    for text, name, p in zip(texts, names, got, strict=True):
        total = np.zeros(len(m["langs"]))
        for s in range(0, len(text), language.WINDOW):
            part = list(text[s : s + language.WINDOW + language.WIDEST - 1])
            part += [language.PAD] * (language.WINDOW + language.WIDEST - 1 - len(part))
            best = np.full(language.FILTERS, -np.inf)
            for k in range(language.WINDOW):
                x = m["embed"][part[k : k + language.WIDEST]]
                best = np.maximum(best, np.einsum("we,wef->f", x, m["conv"].reshape(mask.shape) * mask))
            z = np.tanh(best + m["bias"]) @ m["out"] + m["out_bias"]
            total += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * min(language.WINDOW, len(text) - s)
        total /= len(text)
        want = np.exp(total - total.max())
        if language.LETTER.search(text.decode("utf-8", "replace")):
            assert name == m["langs"][total.argmax()] and p == pytest.approx((want / want.sum()).max(), abs=1e-4)
        else:
            assert (name, p) == (language.UND, 0.0)


def test_fits_are_bounded_and_repeats_count_once(spark, monkeypatch):
    """One sampled id fills a third of the table, some texts are very long, one id is marked both ways."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append((texts, labels)))
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append((texts, langs)))
    rows = [(i, f"text {i} " * (6000 if i < 3 else 3), "abc"[i % 3]) for i in range(60)] + [(0, "text 0 again", "a")] * 30
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] * 2 + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    quality.fit(d, labels)
    language.fit(d)
    language.fit(d, langs=2)
    (texts, y), (spoken, langs), (_, two) = seen
    learned = {r["doc_id"] for r in d.filter(~language.held_out()).select("doc_id").distinct().collect()}
    assert len(y) == len(learned - {5}) and len(spoken) == len(learned)
    assert all(len(t) <= quality.FIT_CHARS for t in texts + spoken) and max(map(len, texts)) == quality.FIT_CHARS
    assert set(langs) == set("abc") and set(two) == {"a", "b"}


def test_tied_turns_are_ordered_by_their_text_as_given(spark):
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "<a"), (1, 0, "user", "<\\|"), (2, 3, "assistant", "<|b"), (2, 3, "assistant", "<a|")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.formatted_digests(d).collect()}
    for c in (1, 2):
        whole = "".join(f"{r[2]}\n{r[3]}\n" for r in sorted(r for r in rows if r[0] == c))
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_mask_covers_the_formatted_text(spark):
    parts = [("text", "look <|x|> ", None, None), ("image", None, "s3://a.png", 576), ("text", "and 😀", None, None)]
    d = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", parts), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(d).first()
    assert sum(x["length"] for x in r["loss_mask"]) == len(r["formatted"])
    at, under = 0, []
    for x in r["loss_mask"]:
        if x["loss"]:
            under.append(r["formatted"][at : at + x["length"]])
        at += x["length"]
    assert under == ["look <\\|x|> <|image:1|>and 😀", ""]
    chats = chat.format_chats(d)
    # the mask is what counts: without it nothing is learned, whatever the roles
    bare = chats.withColumn("loss_mask", F.transform("loss_mask", lambda x: F.struct(x["length"].alias("length"), F.lit(False).alias("loss"))))
    assert [chat.digests(x).first()["loss_chars"] for x in (chats, bare)] == [len("look <|x|> <|image:1|>and 😀"), 0]
