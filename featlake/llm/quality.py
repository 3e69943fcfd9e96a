"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

Learned filters slide over overlapping chunks (WIDTH bytes, every STRIDE bytes) that cover the whole document.
Each filter keeps its largest response over the document, and a logistic layer combines these into one
probability. A document is scored in slabs of bounded size whose maxima are merged, so that its length does not
bound memory.

Defined cases: null and empty text count as one chunk of padding and get the score of that; repeated rows get the
same score; an empty table gives an empty result; further columns are kept out of the result of `score`.
Training without rows of both labels gives the constant score of the prior (0.5 without any row); ids that are marked
both ways are not learned from, and rows that repeat an id count once there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import bounded_sample, crops, fold, held_out, map_batches, slabs, string_buffers

WIDTH, STRIDE, EMBED, FILTERS = 16, 8, 6, 24
PAD = 256
#: Documents of each label that the model is fitted on, at most.
FIT_PER_LABEL = 1000
#: Code points of each of them that reach the driver, and bytes of these that an epoch looks at, cut at a random place.
FIT_CHARS, CROP = 16384, 4096
EPOCHS, BATCH, RATE, SEED = 24, 32, 0.01, 7
SLAB = 1 << 17
ACCEPT = 0.7

Model = dict[str, np.ndarray]


def chunk_starts(n_bytes: int) -> int:
    """Number of chunks of a document: one at each STRIDE bytes until its end is covered, at least one."""
    return max(1, -(-(n_bytes - WIDTH) // STRIDE) + 1)


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents, each padded to whole chunks, and where each document's chunks begin (n + 1)."""
    lengths = np.diff(at)
    chunks = np.maximum(1, -(-(lengths - WIDTH) // STRIDE) + 1)
    slots = (chunks - 1) * STRIDE + WIDTH
    slots += -slots % STRIDE  # every document starts at a multiple of STRIDE
    begin = np.concatenate(([0], np.cumsum(slots)))
    out = np.full(int(begin[-1]) + WIDTH, PAD, np.int16)
    where = np.repeat(begin[:-1] - at[:-1], lengths) + np.arange(len(raw))
    out[where] = raw
    return out, begin


def _responses(symbols: np.ndarray, begin: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as rows, responses of every filter, and which rows are chunks' first rows of each document."""
    e = m["embed"][symbols]
    n = int(begin[-1]) // STRIDE
    rows = np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (e.strides[0] * STRIDE, e.strides[1]))
    return rows, rows @ m["conv"] + m["bias"], begin[:-1] // STRIDE


def pooled(raw: np.ndarray, at: np.ndarray, m: Model) -> np.ndarray:
    """Largest response of each filter over each whole document."""
    out = np.full((len(at) - 1, m["conv"].shape[1]), -np.inf, np.float32)
    for a, b in slabs(at, SLAB):
        step = SLAB if b - a == 1 else max(1, int(at[b] - at[a]))
        # no piece starts where only padding would be left to cover
        end = int(at[a]) + chunk_starts(int(at[b] - at[a])) * STRIDE if b - a == 1 else int(at[a]) + 1
        for s in range(int(at[a]), end, step):
            # a long document goes through in pieces that overlap by a chunk
            piece = raw[s : min(int(at[b]), s + step + WIDTH)] if b - a == 1 else raw[at[a] : at[b]]
            inner = np.array([0, len(piece)]) if b - a == 1 else at[a : b + 1] - at[a]
            symbols, begin = _padded(piece, inner)
            _, r, first = _responses(symbols, begin, m)
            # rows that straddle two documents' slots belong to none
            valid = np.zeros(len(r), bool)
            chunks = np.maximum(1, -(-(np.diff(inner) - WIDTH) // STRIDE) + 1)
            valid[np.repeat(first, chunks) + np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)] = True
            r[~valid] = -np.inf
            out[a:b] = np.maximum(out[a:b], np.maximum.reduceat(r, first, axis=0))
    return out


def probability(features: np.ndarray, m: Model) -> np.ndarray:
    z = np.tanh(features) @ m["out"] + m["out_bias"]
    return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _adam(m: Model, g: Model, state: dict, t: int) -> None:
    for k, v in g.items():
        a, b = state.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
        a, b = 0.9 * a + 0.1 * v, 0.999 * b + 0.001 * v * v
        state[k] = a, b
        m[k] -= (RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Fit the network by Adam on the logistic loss; both labels weigh the same."""
    rng = np.random.default_rng(SEED)
    m = {
        "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32),
        "conv": rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "out_bias": np.zeros((), np.float32),
    }
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        m["out"][:] = 0
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        m["out_bias"] = np.float32(np.log(share / (1 - share)))
        return m
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    state: dict = {}
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            ids = order[s : s + BATCH]
            cut = [texts[i] if len(texts[i]) <= CROP else texts[i][(o := int(rng.integers(len(texts[i]) - CROP))) : o + CROP] for i in ids]
            at = np.concatenate(([0], np.cumsum([len(x) for x in cut])))
            symbols, begin = _padded(np.frombuffer(b"".join(cut), np.uint8), at)
            rows, r, first = _responses(symbols, begin, m)
            chunks = np.maximum(1, -(-(np.diff(at) - WIDTH) // STRIDE) + 1)
            best = np.stack([a + r[a : a + c].argmax(0) for a, c in zip(first, chunks, strict=True)])  # documents x filters
            h = np.tanh(r[best, np.arange(FILTERS)])
            p = 1 / (1 + np.exp(-(h @ m["out"] + m["out_bias"])))
            d = (p - y[ids]) * weight[ids] / len(ids)
            dh = d[:, None] * m["out"] * (1 - h * h)
            x = rows[best]  # documents x filters x inputs
            g_conv = np.einsum("df,dfi->if", dh, x)
            dx = np.einsum("df,if->dfi", dh, m["conv"]).reshape(-1, EMBED)
            sym = symbols[(best * STRIDE)[..., None] + np.arange(WIDTH)].reshape(-1)
            g_embed = np.zeros_like(m["embed"])
            np.add.at(g_embed, sym, dx)
            t += 1
            _adam(m, {"conv": g_conv + 1e-4 * m["conv"], "bias": dh.sum(0), "out": h.T @ d + 1e-3 * m["out"], "out_bias": d.sum(), "embed": g_embed}, state, t)
    return m


def fit(documents: DataFrame, labels: DataFrame, per_label: int = FIT_PER_LABEL) -> Model:
    """Train on a bounded, reproducible sample of labelled rows outside the held-out fold."""
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 2))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).filter("y = most").select("doc_id", "y")
    ids = bounded_sample(marked, "doc_id", "y", per_label)
    # at most 2 * per_label rows, so the broadcast and what reaches the driver are bounded
    part = crops(F.col("text"), F.col("doc_id"), FIT_CHARS).alias("part")
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", part).groupBy("doc_id", "y").agg(F.min("part").alias("part")).collect()
    rows.sort(key=lambda r: r[0])
    return train([(r[2] or "").encode() for r in rows], [r[1] for r in rows])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) of every document, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = string_buffers(b.column(1))
            p = probability(pooled(raw, at, model), model) if len(at) > 1 else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 at a score of ACCEPT or more)."""
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that the classifier does not reject."""
    model, text = fit(documents, labels), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw, at = string_buffers(b.column(text))
                yield b.filter(pa.array(probability(pooled(raw, at, model), model) >= ACCEPT))

    return map_batches(documents, run, documents.schema)
