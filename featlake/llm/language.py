"""Language identification: a byte convolutional network in numpy.

Filters of widths 2, 3 and 4 run over fixed-length windows of bytes that cover the whole text; each filter's largest
response in a window is kept, a softmax layer gives each window's class scores, and a document's class is that with
the largest mean log-probability over its windows, weighted by their bytes.

Defined cases: null text and text without a letter give `und` with score 0; repeated rows get the same answer; an
empty table gives an empty result; with no labelled row to learn from every text gives `und`; beyond FIT_LANGS
languages those of fewest documents are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import bounded_sample, crops, fold, held_out, map_batches, slabs, string_buffers

WINDOW, EMBED, PER_WIDTH = 256, 6, 10
WIDTHS = (2, 3, 4)
WIDEST = max(WIDTHS)
FILTERS = PER_WIDTH * len(WIDTHS)
PAD = 256
#: Documents of each language that the model is fitted on, at most, and windows of each document an epoch looks at.
FIT_PER_LANG, FIT_WINDOWS = 400, 2
#: Languages that are learned, those of most documents, and code points of a document that reach the driver.
FIT_LANGS, FIT_CHARS = 256, 16384
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 11
SLAB = 1 << 17
UND = "und"
LETTER = regex.compile(r"\p{L}")

Model = dict


def _mask() -> np.ndarray:
    """Which inputs each filter sees: one of width w sees the first w of WIDEST bytes."""
    m = np.zeros((WIDEST, EMBED, FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        m[:w, :, k * PER_WIDTH : (k + 1) * PER_WIDTH] = 1
    return m.reshape(WIDEST * EMBED, FILTERS)


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as rows of WINDOW + WIDEST - 1 symbols (padded), the document of each, and its bytes."""
    lengths = np.diff(at)
    each = np.maximum(1, -(-lengths // WINDOW))
    doc = np.repeat(np.arange(len(lengths)), each)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    start = at[:-1][doc] + k * WINDOW
    room = np.concatenate((raw, np.zeros(WINDOW + WIDEST, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(room, WINDOW + WIDEST - 1)[start].astype(np.int16)
    left = at[1:][doc] - start
    rows[np.arange(rows.shape[1]) >= left[:, None]] = PAD
    return rows, doc, np.minimum(left, WINDOW)


def _pool(rows: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = m["embed"][rows]
    x = np.lib.stride_tricks.sliding_window_view(e.reshape(len(rows), -1), WIDEST * EMBED, axis=1)[:, ::EMBED]
    r = np.ascontiguousarray(x).reshape(-1, WIDEST * EMBED) @ m["conv"]
    return x, r.reshape(len(rows), WINDOW, FILTERS), e


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def window_scores(rows: np.ndarray, m: Model) -> np.ndarray:
    out = np.empty((len(rows), len(m["langs"])), np.float32)
    step = max(1, SLAB // WINDOW)
    for s in range(0, len(rows), step):
        r = _pool(rows[s : s + step], m)[1].max(1)
        out[s : s + step] = log_softmax(np.tanh(r + m["bias"]) @ m["out"] + m["out_bias"])
    return out


def train(texts: list[bytes], langs: list[str]) -> Model:
    rng = np.random.default_rng(SEED)
    names = sorted(set(langs))
    mask = _mask()
    m = {
        "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32),
        "conv": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.3, (FILTERS, len(names))).astype(np.float32),
        "out_bias": np.zeros(len(names), np.float32),
    }
    if len(names) > 1:
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        rows, doc, size = windows(np.frombuffer(b"".join(texts), np.uint8), at)
        y = np.array([names.index(x) for x in langs])[doc]
        inverse = 1 / np.bincount(y, minlength=len(names))
        weight = (inverse * len(y) / len(names))[y].astype(np.float32)
        pick = np.lexsort((rng.random(len(doc)), doc))  # windows of each document in random order
        state: dict = {}
        t = 0
        first = np.searchsorted(doc, np.arange(len(texts)))
        count = np.bincount(doc, minlength=len(texts))
        for epoch in range(EPOCHS):
            chosen = np.concatenate([pick[first + (epoch * FIT_WINDOWS + j) % count] for j in range(FIT_WINDOWS)])
            chosen = rng.permutation(np.unique(chosen[size[chosen] >= 24]))
            for s in range(0, len(chosen), BATCH):
                i = chosen[s : s + BATCH]
                x, r, _ = _pool(rows[i], m)
                best = r.argmax(1)
                h = np.tanh(np.take_along_axis(r, best[:, None, :], 1)[:, 0] + m["bias"])
                d = np.exp(log_softmax(h @ m["out"] + m["out_bias"]))
                d[np.arange(len(i)), y[i]] -= 1
                d = (d * weight[i][:, None] / len(i)).astype(np.float32)
                dh = (d @ m["out"].T) * (1 - h * h)
                inputs = x[np.arange(len(i))[:, None], best]  # windows x filters x inputs
                g_conv = np.einsum("wf,wfi->if", dh, inputs) * mask
                dx = np.einsum("wf,if->wfi", dh, m["conv"]).reshape(-1, EMBED)
                g_embed = np.zeros_like(m["embed"])
                np.add.at(g_embed, rows[i][np.arange(len(i))[:, None, None], best[..., None] + np.arange(WIDEST)].reshape(-1), dx)
                t += 1
                for k, g in {"conv": g_conv, "bias": dh.sum(0), "out": h.T @ d + 1e-4 * m["out"], "out_bias": d.sum(0), "embed": g_embed}.items():
                    a, b = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
                    state[k] = a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
                    m[k] -= (RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m | {"langs": names}


def predict(raw: np.ndarray, at: np.ndarray, m: Model) -> tuple[list[str], np.ndarray]:
    """Language and its probability for every document of the buffer."""
    n, names = len(at) - 1, m["langs"]
    total = np.zeros((n, max(1, len(names))))
    for a, b in slabs(at, SLAB) if names else ():
        rows, doc, size = windows(raw[at[a] : at[b]], at[a : b + 1] - at[a])
        s = window_scores(rows, m) * size[:, None]
        np.add.at(total, doc + a, s)
    total /= np.maximum(1, np.diff(at))[:, None]
    best = total.argmax(1)
    p = np.exp(total - total.max(1, keepdims=True))
    p = p[np.arange(n), best] / p.sum(1)
    und = [not names or not LETTER.search(raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(n)]
    p[und] = 0.0
    return [UND if u else names[k] for u, k in zip(und, best, strict=True)], p


def fit(documents: DataFrame, per_lang: int = FIT_PER_LANG, langs: int = FIT_LANGS) -> Model:
    """Train on a bounded, reproducible sample of each language outside the held-out fold; repeated ids count once a language."""
    known = documents.select("doc_id", F.col("lang").cast("string").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2))
    most = known.groupBy("y").count().orderBy(F.desc("count"), "y").limit(langs).select("y")
    ids = bounded_sample(known.join(F.broadcast(most), "y").distinct(), "doc_id", "y", per_lang)
    # at most langs * per_lang rows, so the broadcast and what reaches the driver are bounded
    part = crops(F.col("text"), F.col("doc_id"), FIT_CHARS).alias("part")
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("y"), "text").join(F.broadcast(ids), ["doc_id", "y"]).select("doc_id", "y", part).groupBy("doc_id", "y").agg(F.min("part").alias("part")).collect()
    rows = sorted((r[0], r[1], r[2]) for r in rows if r[2] and LETTER.search(r[2]))
    return train([r[2].encode() for r in rows], [r[1] for r in rows])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = string_buffers(b.column(1))
            lang, p = predict(raw, at, model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def classify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return identify(documents, fit(documents)).select("doc_id", held_out(), "lang_pred", "score")
