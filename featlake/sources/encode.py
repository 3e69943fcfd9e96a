"""Embedding sources: texts through an encoder in bounded requests, with retries, halving and the order of the keys restored.

An encoder takes a list of texts and gives a matrix, a row for each; a network service, a local model or, as here, a
deterministic hashing encoder. It raises Busy where the same request may succeed later, and MemoryError where a
smaller one may.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.operators.order import placed
from featlake.sources.files import fresh

Encoder = Callable[[Sequence[str]], np.ndarray]


class Busy(Exception):
    """A request that failed for now."""


#: Tokens and texts of a request, characters a token stands for, tries of a request and seconds before the second one.
BUDGET, MOST, CHARS_PER_TOKEN, TRIES, WAIT = 20_000, 250, 3.5, 5, 0.5


class Hashing:
    """Signed counts of the words of a text in `dim` buckets; an empty word counts too."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, t in enumerate(texts):
            for w in t.split(" "):
                h = xxhash.xxh64_intdigest(w.encode(), 42)
                signed = h - (1 << 64) if h >> 63 else h
                out[k, signed % self.dim] += 1 if signed > 0 else -1
        return out


def requests(texts: Sequence[str], budget: int = BUDGET, most: int = MOST) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts whose estimated tokens fit the budget; a larger text stands alone."""
    first, used = 0, 0
    for k, t in enumerate(texts):
        n = -(-len(t) // CHARS_PER_TOKEN)
        if k > first and (used + n > budget or k - first >= most):
            yield first, k
            first, used = k, 0
        used += n
    if first < len(texts):
        yield first, len(texts)


def ask(encoder: Encoder, texts: Sequence[str], tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> np.ndarray:
    """One request: tried again after doubling waits while it is Busy, halved when it is too large."""
    for k in range(tries):
        try:
            out = np.asarray(encoder(texts), np.float32)
            if out.shape[0] != len(texts) or not np.isfinite(out).all():
                raise ValueError("an encoder gave other rows than asked, or numbers that are not finite")
            return out
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return np.vstack([ask(encoder, part, tries, wait, sleep) for part in (texts[:half], texts[half:])])
        except Busy:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)
    raise ValueError("no try was allowed")


def embed(docs: DataFrame, key: str, text: str, make: Callable[[], Encoder], budget: int = BUDGET, most: int = MOST, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """(key, embedding) of every row; make() gives the encoder, once in each task. Null text counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for f in frames:
            texts = f["text"].tolist()
            for s, e in requests(texts, budget, most):
                yield pd.DataFrame({"key": f["key"].iloc[s:e], "embedding": list(ask(encoder, texts[s:e], tries, wait))})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def submit(docs: DataFrame, key: str, text: str, jobs: int) -> str:
    """Write keyed requests as JSON lines, `jobs` folders of them; gives their folder."""
    path = fresh(docs.sparkSession, "requests")
    line = F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.coalesce(text, F.lit("")).alias("text")))
    docs.select(line.alias("value"), F.pmod(F.xxhash64(key), F.lit(jobs)).alias("job")).write.partitionBy("job").text(path)
    return path


def run_jobs(spark: SparkSession, asked: str, make: Callable[[], Encoder]) -> str:
    """Stand-in for a service that answers jobs: keyed answers as JSON lines in no order; gives their folder."""
    path = fresh(spark, "answers")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for f in frames:
            rows = [json.loads(x) for x in f["value"]]
            for s, e in requests([r["text"] for r in rows]):
                found = ask(encoder, [r["text"] for r in rows[s:e]])
                yield pd.DataFrame({"value": [json.dumps({"key": r["key"], "embedding": v.tolist()}) for r, v in zip(rows[s:e], found, strict=True)]})

    answers = spark.read.text(asked).select("value").mapInPandas(run, "value string")
    answers.withColumn("h", F.xxhash64("value")).sort("h").select("value").write.text(path)
    return path


def collect_jobs(docs: DataFrame, key: str, answers: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): every row's key, embedding and place in the order of the keys; keys with no answer or several."""
    kind = docs.schema[key].dataType
    found = docs.sparkSession.read.text(answers).select(F.from_json("value", "key string, embedding array<float>").alias("a")).select(F.col("a.key").cast(kind).alias(key), "a.embedding")
    counts = docs.select(key).join(found.groupBy(key).agg(F.count("*").alias("answers")), key, "left").fillna(0, ["answers"])
    return placed(found.join(docs.select(key), key, "left_semi"), [F.col(key).asc()]), counts.filter("answers <> 1")
