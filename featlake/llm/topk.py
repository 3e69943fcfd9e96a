"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors become integers floor(SCALE * x). Candidates are dealt evenly to blocks; a block holds, for each dimension, its
candidates sorted by that dimension. A query walks all lists at once, from the end that its sign favours, and scores
what it meets; the walk ends when the best that any unmet candidate could reach, the query's inner product with the
lists' present values, is below the k-th score so far (at a tie the walk goes on, as a smaller id may follow).
A block is moved and its lists are built once; the queries then stream by, one batch at a time. The best k of each
block are merged by rank.

Scores are exact: rows whose products could leave the integers that a double holds (2^53) are multiplied as integers
of any size. A score beyond the range of a long is ranked by its exact value and given as the range's end.

Defined cases: vectors that are null, or that hold null or non-finite components take no part, nor do rows without id;
a vector meets those of its own length alone (an inner product needs equal lengths; that of empty vectors is 0); every
repeated row is a candidate of its own, equal queries are asked once, and different vectors of one id share its rank
list; a query never gets a row of its own id; with fewer than k candidates all are given; empty tables give an empty
result; further columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import map_batches, stage

SCALE, K, EVERY = 256, 5, 50
#: Candidates of a block: what a task holds, whatever the input.
BLOCK = 8192
FIRST_DEPTH = 32
#: Distinct lengths whose numbers of blocks are broadcast (8 bytes each), and salts of a join beyond.
MOST_LENGTHS, SALTS = 100_000, 64
EXACT = 2.0**53
LONGEST = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the vectors that can take part, as doubles."""
    x = F.col(vector)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"))


def _whole(x: float) -> int:
    """floor(SCALE * x), whatever its size."""
    return int(x) * SCALE if abs(x) >= EXACT else math.floor(SCALE * x)


def _exact(xs: np.ndarray, q: list[int]) -> list[int]:
    return [sum(_whole(a) * b for a, b in zip(x, q, strict=True)) for x in xs.tolist()]


class Lists:
    """A block's candidates, sorted by id, with their order in each dimension."""

    def __init__(self, ids: np.ndarray, xs: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, xs = ids[order], xs[order]
        #: Largest component with which a sum of products stays below EXACT.
        self.most = math.sqrt(EXACT / max(1, xs.shape[1])) - 1
        narrow = (np.abs(xs) * SCALE <= self.most).all(1)
        self.ids, self.vs = ids[narrow], np.floor(xs[narrow] * SCALE)
        self.by = np.ascontiguousarray(np.argsort(self.vs, axis=0, kind="stable").T.astype(np.int32))  # ascending
        self.wide_ids, self.wide = ids[~narrow], xs[~narrow]
        self.all = (ids, xs)

    def search(self, query: int, x: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the best k candidates other than the query's own rows, best first."""
        if (np.abs(x) * SCALE <= self.most).all():
            found = self.walk(query, np.floor(x * SCALE), k)
            ids, rows = self.wide_ids, self.wide
        else:
            found, (ids, rows) = [], self.all
        if len(ids):
            scores = _exact(rows, [_whole(a) for a in x.tolist()])
            found += [(int(i), s) for i, s in zip(ids.tolist(), scores, strict=True) if i != query]
            found = sorted(found, key=lambda r: (-r[1], r[0]))[:k]
        return found

    def walk(self, query: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        n = len(self.ids)
        dims = np.flatnonzero(q)
        lists = np.where((q[dims] > 0)[:, None], self.by[dims, ::-1], self.by[dims])
        seen = np.zeros(n, bool)
        a, z = np.searchsorted(self.ids, query), np.searchsorted(self.ids, query, "right")
        seen[a:z] = True
        best, score = np.zeros(0, np.int64), np.zeros(0)
        depth, done = 0, FIRST_DEPTH
        while True:
            met = np.zeros(n, bool)
            if len(dims):
                met[lists[:, depth:done].ravel()] = True
            else:
                met[:] = True  # the zero query: all score zero
            met &= ~seen
            new = np.flatnonzero(met)
            seen |= met
            if len(new):
                best = np.concatenate((best, new))
                score = np.concatenate((score, self.vs[new] @ q))
                if len(best) > k:
                    bar = np.partition(score, len(score) - k)[len(score) - k]
                    keep = score >= bar
                    best, score = best[keep], score[keep]
                    top = np.lexsort((best, -score))[:k]
                    best, score = best[top], score[top]
            if done >= n or not len(dims) or seen.all():
                break
            bound = float(self.vs[lists[:, done - 1], dims] @ q[dims])
            if len(best) == k and score.min() > bound:
                break
            depth, done = done, min(n, 2 * done)
        top = np.lexsort((best, -score))[:k]
        return [(int(i), int(s)) for i, s in zip(self.ids[best[top]], score[top], strict=True)]


def _answers(k: int):
    """Rows (d, block, asks, id, x), by block its candidates and then the queries, to the best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, None
        ids: list[np.ndarray] = []
        xs: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            d, block, asks, i = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            at, flat = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy()
            cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            out: list[tuple[int, int, int]] = []
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if (d[s], block[s]) != key:
                    key, lists, ids, xs = (d[s], block[s]), None, [], []
                x = flat[at[s] : at[e]].reshape(e - s, int(d[s]))
                if not asks[s]:
                    ids.append(i[s:e].copy())
                    xs.append(x.copy())
                    continue
                if lists is None and ids:
                    lists = Lists(np.concatenate(ids), np.concatenate(xs))
                if lists is not None:
                    out += [(int(q), c, score) for q, v in zip(i[s:e], x, strict=True) for c, score in lists.search(int(q), v, k)]
            if out:
                q, c, score = zip(*out, strict=True)
                most = [min(LONGEST, max(-LONGEST - 1, x)) for x in score]
                tell = [1 if x > LONGEST else -1 if x < -LONGEST - 1 else 0 for x in score]
                beyond = [str(abs(x)) if y else None for x, y in zip(score, tell, strict=True)]
                size = [y * len(t) if t else 0 for y, t in zip(tell, beyond, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(most, pa.int64()), pa.array(size, pa.int32()), pa.array(beyond, pa.string())], ["query_id", "vec_id", "score", "size", "beyond"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for each of queries (both as from usable()).

    Rows go to blocks by their number in the table, so that no repeated id or vector fills one; each of the stated
    queries goes to all blocks of its length.
    """
    of = vectors.select(F.size("x").alias("d"), "id", "x", F.monotonically_increasing_id().alias("n"))
    blocks = stage(of.groupBy("d").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "lengths")
    on = ["d"]
    if blocks.count() <= MOST_LENGTHS:
        blocks = F.broadcast(blocks)
    else:  # a length may be that of most rows
        on, of = ["d", "salt"], of.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)))
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = of.join(blocks, on).select("d", F.pmod(F.xxhash64("n"), "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), "id", "x")
    asked = queries.select(F.size("x").alias("d"), "id", "x").distinct().withColumn("salt", F.pmod(F.xxhash64("id", "x"), F.lit(SALTS))).join(blocks, on)
    asked = asked.select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "x")
    met = rows.unionAll(asked).repartition("d", "block").sortWithinPartitions("d", "block", "asks")
    some = map_batches(met, _answers(k), "query_id long, vec_id long, score long, size int, beyond string")
    # what is beyond a long is ordered by sign, number of digits and digits
    best = [F.desc("score"), F.desc("size"), F.when(F.col("size") > 0, F.col("beyond")).desc_nulls_last(), F.when(F.col("size") < 0, F.col("beyond")).asc_nulls_last(), F.asc("vec_id")]
    w = Window.partitionBy("query_id").orderBy(*best)
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """The search with the rows whose vec_id is divisible by `every` as queries."""
    rows = stage(usable(vectors), "vectors")
    return search(rows, rows.filter(F.col("id") % every == 0), k, block)
