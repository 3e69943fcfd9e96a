"""Substring dedup over a log-structured fingerprint index.

A window is WINDOW consecutive words. Its fingerprint in the index is the least hash of the GRAM-word runs inside it
(equal windows have the same, at the same place), so that a run of windows shares an entry and the index holds about
a seventh of the windows. The index is a log of immutable runs: each batch's entries are sorted and written once, and
runs are merged when FANOUT of them stand beside each other. For each batch:

1. its entries are aggregated into a new sorted run;
2. the new run is merge-joined with the historical runs; entries that history holds, or the batch holds twice, are
   collected in a bitmap whose size follows their number, up to 2 ** MOST_BITS bits;
3. windows of the batch and of earlier documents whose entry is in the bitmap are verified on two independent hashes
   of all their words, of 64 and 32 bits; the earliest start of each is kept (false positives of the bitmap only add
   such windows);
4. words covered by a window that is not the earliest are removed;
5. the run joins the log, which is compacted once it has FANOUT runs.

Words are hashed by eight bytes at a time and runs of words by doubling, each step one to one in either side, so that
no periodic or mirrored text makes hashes meet, as it can with polynomials modulo 2^64. Of 10^12 different windows two
agree on all 96 bits with a chance of about 10^-5.

Batches go by ascending doc_id, so what is earlier is in history or in the batch.

Defined cases: null and empty texts have no words and an empty kept text; texts of under WINDOW words lose none;
a null doc_id counts as smallest; rows that repeat both doc_id and text count as one document and get the same
result, rows that repeat doc_id with other texts are ordered by a hash of the text; an empty table gives an empty
result; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from featlake.llm.common import columns, freeing, map_batches, parts_for, replaced, shared_dir, slabs, stage, string_buffers, unused

WINDOW, GRAM = 20, 8
SLAB = 1 << 18
#: Bytes of a word that are hashed side by side with other words.
LONG_WORD = 256
#: Least and most bits, as powers of two, of the bitmap of repeated entries: 128 kB to 64 MB. It has BITS_EACH bits or
#: more for each entry up to its most; beyond, more windows are verified in vain.
LEAST_BITS, MOST_BITS, BITS_EACH = 20, 29, 16
#: Runs at which the log is compacted, and batches of a table.
FANOUT, BATCHES = 3, 4
#: Documents for each file of a run, and of a batch's first windows.
ROWS_EACH = 50_000
#: Windows of a batch of rows that are held to drop repeats among them.
MOST_HELD = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class _Lane:
    """A family of 64-bit hashes without algebraic structure: of words, and of runs of words by doubling."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.start, self.size, self.left, self.by = (rng.integers(1, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)).tolist()

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of a pair; for either side fixed it is one to one in the other."""
        z = b * np.uint64(self.left)
        z ^= a
        z ^= z >> np.uint64(32)
        z *= np.uint64(self.by)
        z ^= z >> np.uint64(29)
        return z

    def words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of raw[start:end] for each word, eight bytes at a time; very long words go through XXH3."""
        size = end - start
        h = size.astype(np.uint64) * np.uint64(self.size) + np.uint64(self.start)
        if not len(size):
            return h
        eights = np.ndarray((len(raw),), "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
        live = np.arange(len(size))
        for k in range(0, LONG_WORD, 8):
            if k:
                live = live[size[live] > k]
            if not len(live):
                break
            h[live] = self.join(h[live], eights[start[live] + k] & _FIRST_BYTES[np.minimum(size[live] - k, 8)])
        for i in live[size[live] > LONG_WORD].tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes(), self.seed)
        return h

    def runs(self, h: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of `width` of the values h: of runs of powers of two, put together from the longest on."""
        n, power, done = len(h) - width + 1, 1, 0
        out, each = None, h
        parts = {}
        while power <= width:
            parts[power] = each
            if 2 * power <= width:
                each = self.join(each[:-power], each[power:])
            power *= 2
        for power in sorted(parts, reverse=True):
            if width & power:
                part = parts[power][done : done + n]
                out = part if out is None else self.join(out, part)
                done += power
        return out


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FIRST, _SECOND = _Lane(20240601), _Lane(977)


class Words:
    """Words of a buffer of documents: start and end of each, and the first word of each document (n + 1)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        inside = np.zeros(len(raw) + 1, bool)
        inside[:-1] = ~_SPACE[raw]
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside[:-1]
        before[at] = False  # no word goes on into the next document
        self.start = np.flatnonzero(inside & ~before)
        ends = before & ~inside
        last = at[1:][np.diff(at) > 0]
        ends[last[inside[last - 1]]] = True
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, at)
        self.raw = raw
        self._hashes: dict[int, np.ndarray] = {}

    def runs(self, of: _Lane, width: int) -> np.ndarray:
        """Hash of each run of `width` words, those over the end of a document included."""
        if of.seed not in self._hashes:
            self._hashes[of.seed] = of.words(self.raw, self.start, self.end)
        return of.runs(self._hashes[of.seed], width)

    def window_starts(self) -> np.ndarray:
        n = np.maximum(0, np.diff(self.first) - WINDOW + 1)
        return np.repeat(self.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def anchors(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its entry and the word where that stands: the leftmost least hash of GRAM words inside."""
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    gram = words.runs(_FIRST, GRAM)

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(gram[b] < gram[a], b, a)

    span, width = WINDOW - GRAM + 1, 1
    best = np.arange(len(gram))
    while 2 * width <= span:
        best = lower(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = lower(best[: width - span], best[span - width :])
    at = best[starts]
    return gram[at], at


def _present(entries: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    p = (entries & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def entries(documents: DataFrame) -> DataFrame:
    """(h, n): the entries of documents with how often they stand there, summed within a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = string_buffers(b.column(0))
            for a, z in slabs(at, SLAB):
                w = Words(raw[at[a] : at[z]], at[a : z + 1] - at[a])
                h, place = anchors(w, w.window_starts())
                _, once = np.unique(place, return_index=True)
                h, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    return map_batches(documents.select("text"), run, "h long, n byte")


class Log:
    """Sorted immutable runs of entries (h, many) in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/featlake/{uuid.uuid4().hex}/log"
        self.names: list[str] = []

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema("h long, many boolean").parquet(f"{self.path}/{name}")

    def history(self) -> DataFrame | None:
        out = None
        for n in self.names:
            out = self.read(n) if out is None else out.unionAll(self.read(n))
        return out

    def _write(self, run: DataFrame, name: str, files: int) -> DataFrame:
        """A run of distinct entries as sorted files; its shuffle goes with the write."""
        return stage(run, name, files, f"{self.path}/{name}", "h")

    def append(self, documents: DataFrame, files: int) -> DataFrame:
        """Write the sorted run of a batch, in `files` files; it takes part in the log from commit() on."""
        self.fresh = f"run-{len(self.names):05d}-{uuid.uuid4().hex[:8]}"
        self.files = files
        return self._write(entries(documents).groupBy("h").agg((F.sum("n") > 1).alias("many")), self.fresh, files)

    def commit(self, fanout: int = FANOUT) -> None:
        self.names.append(self.fresh)
        if len(self.names) >= fanout:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one; the old ones stay on disk for readers that began before."""
        merged = self.history().groupBy("h").agg((F.max("many") | (F.count("*") > 1)).alias("many"))
        name = f"merged-{uuid.uuid4().hex[:8]}"
        self._write(merged, name, self.files * len(self.names))
        self.names = [name]


def _bitmap(repeated: DataFrame, most: int) -> np.ndarray:
    """Bits of the repeated entries, of which there are `most` at most; 2 ** MOST_BITS / 32768 rows of 4 kB or fewer reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (most * BITS_EACH).bit_length()))
    p = F.expr(f"(h & {(1 << bits) - 1}) + 1")
    with freeing(repeated.sparkSession):
        rows = repeated.select(p.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for k, part in rows:
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
    return out


def _keyed(documents: DataFrame, told_apart: bool) -> DataFrame:
    """doc_id, text and th, which tells rows of one doc_id apart where there are such (else it is zero)."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("th", F.xxhash64("text") if told_apart else F.lit(0).cast("long"))


def _local_firsts(found: list[tuple]) -> pa.RecordBatch:
    """Of equal windows the first by document and position, in the order of the scan."""
    w, x, known, doc, th = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((x >> 32, th, doc, known))  # a null id comes first
    order = order[np.argsort(w[order], kind="stable")]
    new = np.ones(len(w), bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (x[order][1:] - x[order][:-1] & 0xFFFFFFFF != 0)
    keep = np.sort(order[new])
    return pa.RecordBatch.from_arrays([pa.array(w[keep].view(np.int64)), pa.array(x[keep]), pa.array(doc[keep], mask=~known[keep]), pa.array(th[keep])], ["w", "x", "doc_id", "th"])


def candidates(documents: DataFrame, bitmap: np.ndarray, told_apart: bool) -> DataFrame:
    """(w, x, doc_id, th): windows whose entry is in the bitmap, by two independent hashes of their words.

    x holds the position above and the second hash in its lower 32 bits; what does not compress stands side by side.
    Of windows that repeat among those that a task holds (MOST_HELD) only the first goes on, so that a passage that a
    third of all documents share is sent once for thousands of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            raw, at = string_buffers(b.column(1))
            ids, known, th = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            for a, z in slabs(at, SLAB):
                words = Words(raw[at[a] : at[z]], at[a : z + 1] - at[a])
                starts = words.window_starts()
                h, _ = anchors(words, starts)
                starts = starts[_present(h, bitmap)]
                if not len(starts):
                    continue
                w = words.runs(_FIRST, WINDOW)[starts]
                c = (words.runs(_SECOND, WINDOW)[starts] >> np.uint64(32)).astype(np.int64)
                doc = np.searchsorted(words.first, starts, "right") - 1
                x = (starts - words.first[doc]) << 32 | c
                found.append((w, x, known[a + doc], ids[a + doc], th[a + doc]))
                held += len(starts)
                if held > MOST_HELD:
                    yield _local_firsts(found)
                    found, held = [], 0
        if found:
            yield _local_firsts(found)

    return map_batches(_keyed(documents, told_apart), run, "w long, x long, doc_id long, th long")


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by window, document and position, the first of each window."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        w, x = b.column(0).to_numpy(), b.column(1).to_numpy()
        c = x & 0xFFFFFFFF
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
        new[0] = (w[0], c[0]) != before
        before = (w[-1], c[-1])
        first = b.append_column("pos", pa.array((x >> 32).astype(np.int32))).filter(pa.array(new))
        yield first.select(["doc_id", "th", "pos"])


def _removed(starts: np.ndarray, bad: np.ndarray, words: Words) -> np.ndarray:
    cover = np.zeros(len(words.start) + 1, np.int64)
    hit = starts[bad]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return np.cumsum(cover)[:-1] > 0


def _kept(bitmap: np.ndarray, text: bool, names: tuple[str, ...]):
    """Rows (.., text, firsts): keep what no later window covers; the results get `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, raw_text, firsts = b.columns[:-2], b.columns[-2], b.columns[-1]
            raw, at = string_buffers(raw_text)
            n_words, n_removed, kept = [], [], []
            for a, z in slabs(at, SLAB):
                w = Words(raw[at[a] : at[z]], at[a : z + 1] - at[a])
                starts = w.window_starts()
                h, _ = anchors(w, starts)
                bad = _present(h, bitmap)
                part = firsts.slice(a, z - a)
                flat = part.flatten().to_numpy().astype(np.int64)
                many = part.value_lengths().fill_null(0).to_numpy()
                known = np.repeat(w.first[:-1], many) + flat  # words at which an earliest window starts
                bad[np.searchsorted(starts, known)] = False
                gone = _removed(starts, bad, w)
                body = w.raw.tobytes()
                base = int(at[a])
                for i in range(z - a):
                    f, l = int(w.first[i]), int(w.first[i + 1])
                    g = gone[f:l]
                    n = int(g.sum())
                    n_words.append(l - f)
                    n_removed.append(n)
                    doc = body[int(at[a + i]) - base : int(at[a + i + 1]) - base]
                    if text and not n:
                        kept.append(doc.decode())
                        continue
                    words = doc.split()
                    if n:
                        words = [x for x, y in zip(words, g.tolist(), strict=True) if not y]
                    whole = b" ".join(words)
                    kept.append(whole.decode() if text else hashlib.sha256(whole).hexdigest())
            cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *cols], [*b.schema.names[: len(own)], *names])

    return run


def result_names(documents: DataFrame) -> tuple[str, str, str]:
    """Names, unlike all of the documents', of the columns that dedupe adds."""
    return tuple(unused(documents, n) for n in ("n_words", "n_removed", "kept"))


def dedupe_batch(log: Log, batch: DataFrame, earlier: DataFrame | None, text: bool = False, told_apart: bool = True) -> DataFrame:
    """All columns of the batch with words, removed words and what is kept (its digest, or its text), by result_names.

    earlier: the documents that are in the log's history, all of smaller doc_id. The log gets the batch's run.
    text: give the kept text; one without removed words stays as it is, white space included.
    told_apart: tell rows of one doc_id apart by their texts; not needed where ids are unique.
    """
    size = batch.count()
    run = log.append(batch, parts_for(size, ROWS_EACH))
    repeated = run.filter("many").select("h")
    if (history := log.history()) is not None:
        repeated = repeated.unionAll(run.filter("not many").select("h").hint("merge").join(history.select("h"), "h", "left_semi"))
    bitmap = _bitmap(repeated, run.count())
    log.commit()
    found = candidates(batch, bitmap, told_apart)
    if earlier is not None:
        found = found.unionAll(candidates(earlier, bitmap, told_apart))
    first = found.repartition("w").sortWithinPartitions("w", F.expr("x & 4294967295"), "doc_id", "th", "x").mapInArrow(_earliest, "doc_id long, th long, pos int")
    firsts = stage(first.groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_list("pos").alias("firsts")), "firsts", parts_for(size, ROWS_EACH))
    rows = batch.select(F.struct(*columns(batch)).alias("row"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").cast("long").alias("key"))
    of = F.xxhash64("body") if told_apart else F.lit(0).cast("long")
    joined = rows.join(firsts, F.col("key").eqNullSafe(F.col("id")) & (of == F.col("th")), "left").select("row.*", "body", "firsts")
    names = result_names(batch)
    out = StructType(list(batch.schema)).add(names[0], "long").add(names[1], "long").add(names[2], "string")
    return map_batches(joined, _kept(bitmap, text, names), out)


def _batches(documents: DataFrame, n: int) -> list[tuple[DataFrame, DataFrame | None]]:
    """The documents in n batches by ascending doc_id, each with all before it."""
    key = F.col("doc_id")
    cuts = documents.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    out = []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        low = F.lit(True) if lo is None else key >= lo
        high = F.lit(True) if hi is None else (key < hi) | (key.isNull() if lo is None else F.lit(False))
        out.append((documents.filter(low & high), None if lo is None else documents.filter((key < lo) | key.isNull())))
    return out


def dedupe(documents: DataFrame, batches: int = BATCHES, text: bool = False) -> DataFrame:
    """dedupe_batch over the whole table, in batches by ascending doc_id."""
    log = Log(documents.sparkSession)
    repeats = not documents.groupBy("doc_id").count().filter("count > 1").isEmpty()
    out = None
    for batch, earlier in _batches(documents, batches):
        part = dedupe_batch(log, batch, earlier, text, repeats)
        out = part if out is None else out.unionAll(part)
    return out


def removed_words(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents."""
    done = dedupe(documents.select("doc_id", "text"), batches)
    return done.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def without_repeats(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents with repeated passages taken out of text (and n_chars set to what is left)."""
    kept = F.col(result_names(documents)[2])
    return replaced(dedupe(documents, batches, text=True), documents, kept)
