"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints (64 bits) are cut into segments of 23, 23 and 18 bits. A segment decodes, in the perfect binary Golay
code [23, 12, 7], to the codeword within three errors; the codewords of a segment and of its one-bit neighbours (one
or six of them) are its indices. Two segments that differ in at most two bits share a word between them, hence an
index. With at most four errors over three segments, either a segment is without error and another has at most two
(an exact segment and an index of another: six tables), or each has at least one and so at most two (indices of the
first two: one table). Fingerprints meet under equal keys, and every meeting is verified on all 64 bits.

Within a key only the least spanning forest of the verified links leaves the task, and each link under one key alone, so
output grows with the members and not with their pairs; components are found over distinct fingerprints. A key with more than BLOCK members is dealt
again as pairs of blocks, so that no task holds more than two blocks.

Defined cases: null and empty texts have fingerprint zero, linked like any other; repeated rows and equal
fingerprints are one class; an empty table gives an empty result; rows with a null doc_id get a component_id from
the others of their component, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import map_batches, stage, text_files
from featlake.llm.graph import connected_components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
BLOCK = 1 << 15
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text: a bit is 1 if set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: lower-cases A-Z only, splits at x20 and x09-x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    votes = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 15):
        votes += np.unpackbits(h[s : s + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint((x or "").encode(), shingle) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def _remainders() -> np.ndarray:
    """For each 12-bit message the 11 check bits of its codeword."""
    out = np.zeros(4096, np.int32)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        out[m] = r
    return out


CHECKS = _remainders()


def _errors() -> np.ndarray:
    """For each syndrome the one error pattern of weight three or less."""
    out = np.zeros(2048, np.int32)
    for n in range(4):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            out[CHECKS[e >> 11] ^ (e & 2047)] = e
    return out


ERRORS = _errors()


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (v ^ ERRORS[CHECKS[v >> 11] ^ (v & 2047)]) >> 11


def indices(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each segment and its one-bit neighbours, without repeats: (row, index)."""
    flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.int64)
    k = np.sort(decode(v[:, None] ^ flips), axis=1)
    new = np.ones(k.shape, bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    row, col = np.nonzero(new)
    return row, k[row, col].astype(np.int64)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): under at least one key any two fingerprints within MAX_BITS bits meet."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    near = [indices(s, w) for s, (_, w) in zip(seg, SEGMENTS, strict=True)]
    rows, out = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                row, k = near[j]
                rows.append(row)
                out.append((np.int64(3 * i + j) << 40) | (seg[i][row] << 12) | k)
    (ra, ka), (rb, kb) = near[0], near[1]
    first, count = np.searchsorted(rb, np.arange(len(fps))), np.bincount(rb, minlength=len(fps))
    each = count[ra]
    inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    rows.append(np.repeat(ra, each))
    out.append((np.int64(9) << 40) | (np.repeat(ka, each) << 12) | kb[np.repeat(first[ra], each) + inner])
    return np.concatenate(rows), np.concatenate(out)


def _few(v: np.ndarray, width: int, none: int) -> np.ndarray:
    """The indices of each segment in ascending order, six at most, the rest filled with none."""
    flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.int64)
    k = np.sort(decode(v[:, None] ^ flips), axis=1).astype(np.int64)
    k[:, 1:][k[:, 1:] == k[:, :-1]] = none
    return np.sort(k, axis=1)[:, :6]


def least_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least key that the fingerprints a and b have in common; -1 if they have none."""
    parts = [[((x.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS] for x in (a, b)]
    none = 1 << 20
    near = []
    for u, v, (_, w) in zip(*parts, SEGMENTS, strict=True):
        x, y = _few(u, w, none), _few(v, w, none + 1)
        near.append(np.where((x[:, :, None] == y[:, None, :]).any(2), x, none).min(1))
    out = np.where((near[0] < none) & (near[1] < none), (np.int64(9) << 40) | (near[0] << 12) | near[1], -1)
    for i in (2, 1, 0):
        for j in (2, 1, 0):
            if i != j:
                same = (parts[0][i] == parts[1][i]) & (near[j] < none)
                out = np.where(same, (np.int64(3 * i + j) << 40) | (parts[0][i] << 12) | near[j], out)
    return out


_FAR = np.uint64((1 << 64) - 1)


def forest(fps: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of the least spanning forest of the graph of fingerprints within MAX_BITS bits (Prim's algorithm).

    Edges are ordered by distance, then by a hash of both ends, alike wherever they are found: an edge that some key's
    forest leaves out is then in no least forest of the whole graph. known: numbers of groups; members of one are
    connected already and need no edge.
    """
    rest, group = fps, fps if known is None else known
    mark = _mixed(rest.view(np.uint64), 0)
    weight, origin = np.full(len(rest), _FAR), np.zeros(len(rest), np.int64)
    out: list[tuple[int, int]] = []
    while len(rest):
        k = int(weight.argmin())
        p, m, g = rest[k], mark[k], group[k]
        if weight[k] != _FAR and weight[k]:
            out.append((int(origin[k]), int(p)))
        stay = np.arange(len(rest)) != k
        rest, mark, group, weight, origin = rest[stay], mark[stay], group[stay], weight[stay], origin[stay]
        d = np.bitwise_count((rest ^ p).view(np.uint64)).astype(np.uint64)
        w = np.where(d <= MAX_BITS, (d + np.uint64(1) << np.uint64(58)) | ((mark + m) >> np.uint64(6)), _FAR)
        if known is not None:
            w[group == g] = 0
        closer = w < weight
        weight[closer], origin[closer] = w[closer], p
    return out


def _links(key: np.ndarray, fp: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
    """Links (a, b, seed) between groups among rows sorted by key, whole keys only.

    A link is given under the least key that its ends have in common, and so once in all.
    """
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((begin, [len(key)])))
    a, b, k = [], [], []
    for n in (2, 3, 4):
        g = begin[size == n]
        for i, j in combinations(range(n), 2):
            x, y = fp[g + i], fp[g + j]
            hit = (np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS) & (group[g + i] != group[g + j])
            a.append(x[hit])
            b.append(y[hit])
            k.append(key[g][hit])
    for s, n in zip(begin[size > 4].tolist(), size[size > 4].tolist(), strict=True):
        x, c = fp[s : s + n], group[s : s + n]
        if n <= 256:
            d = (np.bitwise_count((x[:, None] ^ x).view(np.uint64)) <= MAX_BITS) & (c[:, None] != c)
            if not d.any():
                continue
        if found := forest(x, c):
            e = np.array(found, np.int64)
            a.append(e[:, 0])
            b.append(e[:, 1])
            k.append(np.full(len(e), key[s]))
    return _once(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, k)))


def _once(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> list[tuple[int, int, int]]:
    """Links found under the least key of their ends, as (a, b, seed)."""
    mine = least_key(a, b) == key & ((1 << SEED_BITS) - 1)
    return list(zip(np.minimum(a, b)[mine].tolist(), np.maximum(a, b)[mine].tolist(), (key[mine] >> SEED_BITS).tolist(), strict=True))


#: Bits of a key below the number of its fingerprint, where texts have several.
SEED_BITS = 44
LINKS = "kind int, a long, b long, block int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["kind", "a", "b", "block"])


class _Meeting:
    """Links among rows that arrive sorted by key; a key with more than `block` rows is passed on in blocks."""

    def __init__(self, block: int):
        self.block, self.hot, self.number = block, None, 0

    def overflow(self, key: int, fp: np.ndarray) -> list[tuple]:
        if key != self.hot:
            self.hot, self.number = key, 0
        out = []
        for s in range(0, len(fp), self.block):
            out.extend((1, key, x, self.number) for x in fp[s : s + self.block].tolist())
            self.number += 1
        return out

    def close(self, key: np.ndarray, fp: np.ndarray, group: np.ndarray) -> list[tuple]:
        """Whole keys; the first may be the rest of one that has overflowed."""
        out: list[tuple] = []
        if len(key) and key[0] == self.hot:
            n = int(np.searchsorted(key, key[0], "right"))
            out, key, fp, group = self.overflow(int(key[0]), fp[:n]), key[n:], fp[n:], group[n:]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((begin, [len(key)]))) if len(key) else begin
        large = size > self.block
        for s, n in zip(begin[large].tolist(), size[large].tolist(), strict=True):
            out += self.overflow(int(key[s]), fp[s : s + n])
        if large.any():
            keep = np.repeat(~large, size)
            key, fp, group = key[keep], fp[keep], group[keep]
        if len(key):
            out += [(0, a, b, seed) for a, b, seed in _links(key, fp, group)]
        return out


def _meet(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _Meeting(block)
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy()]
            new.append(b.column(2).to_numpy().astype(np.int64) if b.num_columns > 2 else new[1])
            key, fp, group = (np.concatenate(x) for x in zip(held, new, strict=True))
            whole = int(np.searchsorted(key, key[-1]))
            rows = m.close(key[:whole], fp[:whole], group[:whole])
            held = [key[whole:], fp[whole:], group[whole:]]  # one key, of which more may come
            if len(held[0]) > block:
                rows += m.overflow(int(held[0][0]), held[1])
                held = [x[:0] for x in held]
            if rows:
                yield _batch(rows)
        if rows := m.close(*held):
            yield _batch(rows)

    return run


def links(classes: DataFrame, block: int = BLOCK, files: int | None = None) -> DataFrame:
    """(a, b, seed): links that connect all distinct fingerprints within MAX_BITS bits of each other.

    classes: fp, and where texts have several fingerprints their number (seed) and the number of a group that is
    connected already (known, an int); only fingerprints of one seed meet, and only links between groups are given.
    """
    several = "seed" in classes.columns

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                fps = part.column(0).to_numpy()
                row, key = keys(fps)
                cols = [pa.array(fps[row])]
                if several:
                    key |= part.column(1).to_numpy().astype(np.int64)[row] << SEED_BITS
                    cols.append(part.column(2).take(pa.array(row)))
                yield pa.RecordBatch.from_arrays([pa.array(key), *cols], ["key", "fp", "known"][: 1 + len(cols)])

    rows = classes.select("fp", "seed", "known") if several else classes.select("fp")
    met = rows.mapInArrow(spread, "key long, fp long, known int" if several else "key long, fp long")
    met = stage(met.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet(block), LINKS), "links", files)
    hot = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    top = hot.groupBy("key").agg(F.max("block").alias("top"))
    pairs = (
        hot.join(top, "key")
        .select("key", "fp", "block", F.explode(F.sequence(F.lit(0), "top")).alias("other"))
        .select("key", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )

    def block_pair(t: pa.Table) -> pa.Table:
        e = np.array(forest(np.unique(t.column("fp").to_numpy())), np.int64).reshape(-1, 2)
        found = _once(e[:, 0], e[:, 1], np.full(len(e), t.column("key")[0].as_py()))
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "seed": pa.array(cols[2], pa.int32())})

    return met.filter("kind = 0").select("a", "b", F.col("block").alias("seed")).unionAll(pairs.groupBy("key", "i", "j").applyInArrow(block_pair, "a long, b long, seed int"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id reachable over links) of every row of documents."""
    files = text_files(documents)
    fps = stage(fingerprints(documents, shingle), "fingerprints", files)
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", files)
    roots = connected_components(links(classes, block, files), files=files).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(components, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For groups by similarity: words of a shingle, the similarity, bands of MinHashes of a text and hashes in each.
SIMILAR_SHINGLE, SIMILARITY, BANDS, WIDTH = 5, 0.8, 20, 6
#: Texts, and shingles of texts, that one side of a meeting holds.
MEMBERS, MEMBER_SHINGLES = 1024, 1 << 21
#: Ids that are broadcast to where the texts are; for more the texts are shuffled.
MOST_NODES = 500_000


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    z = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_TURNS = _mixed(np.arange(2 * BANDS * WIDTH, dtype=np.uint64), SEED).reshape(2, -1, 1)


def shingle_hashes(text: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, ascending; none if it has no words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingle hashes, each made of WIDTH MinHashes; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * WIDTH, _FAR)
    for s in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[s : s + 1024] ^ _TURNS[0]) * (_TURNS[1] | np.uint64(1))).min(1))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, WIDTH))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: a bit is 1 if set in over half of them."""
    votes = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 15):
        votes += np.unpackbits(hashes[s : s + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def sketches(documents: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """doc_id, digest (of the set of shingles), size (of that set), band keys and SimHash (fp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, bands, fps = [], [], [], []
            for x in b.column(1):
                h = shingle_hashes((x.as_py() or "").encode(), shingle)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                bands.append(band_keys(h))
                fps.append(set_fingerprint(h))
            cols = [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "size", "bands", "fp"])

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, digest binary, size long, bands array<long>, fp long")


def _texts_of(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the documents with an id among nodes."""
    nodes = F.broadcast(nodes) if nodes.limit(MOST_NODES + 1).count() <= MOST_NODES else nodes
    return documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")


def _of_like_size(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets can be as alike as asked, by their sizes alone; once each."""
    x, y = (classes.select(F.col("node").alias(c), F.col("size").alias(f"s{c}")).distinct() for c in "ab")
    both = pairs.distinct().join(x, "a").join(y, "b")
    return both.filter(F.least("sa", "sb") >= similarity * F.greatest("sa", "sb") - 1e-6).select("a", "b").distinct()


def _shingle_sets(documents: DataFrame, nodes: DataFrame, classes: DataFrame, shingle: int, files: int) -> DataFrame:
    """node and hashes (its set of shingle hashes) of the texts of the classes of some nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                sets = [shingle_hashes((x.as_py() or "").encode(), shingle).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "digest", "hashes"])

    found = map_batches(_texts_of(documents, nodes), run, "node long, digest binary, hashes binary").join(classes.select("node", "digest"), ["node", "digest"], "left_semi")
    return stage(found.dropDuplicates(["node", "digest"]).select("node", "hashes"), "shingle_sets", files)


def _alike(similarity: float):
    """Pairs whose sets of shingles are as alike as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(_reaches(both, len(x) + len(y), similarity))
            yield b.select(b.schema.names[:2]).filter(pa.array(hit, pa.bool_()))

    return run


def _reaches(both, sizes, similarity: float):
    return both >= similarity * (sizes - both) - 1e-9


def similar_groups(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, block: int = MEMBERS) -> DataFrame:
    """doc_id and group_id (the least doc_id of its group) of every document with an id.

    Candidates are texts whose SimHashes meet under Golay-code keys within MAX_BITS bits, and, as SimHashes of texts
    alike in just 0.8 are often further apart, texts with an equal band of MinHashes of their shingles: of texts alike
    in 0.8 a share of 1 - (1 - 0.8^6)^20 = 0.998 have one. Links are the candidates whose sets of shingles are as alike as `similarity`
    (Jaccard), groups the components of the links. Texts with equal sets are one class.
    """
    files = text_files(documents)
    rows = stage(sketches(documents, shingle).filter("doc_id is not null"), "sketches", files)
    classes = stage(rows.groupBy("digest", "size", "bands", "fp").agg(F.min("doc_id").alias("node")), "sketch_classes", files)
    each = classes.select(F.explode("bands").alias("key"), "node", "size")
    shared = each.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    members = stage(each.join(shared, "key"), "members", files)
    golay = stage(golay_pairs(classes, files), "golay", files)
    # each against the least of its key: all there is to compare in most, and one component of most large ones
    pairs = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).unionAll(golay)
    pairs = stage(_of_like_size(pairs, classes, similarity), "candidates", files)
    nodes = members.filter("n > 2").select("node").unionAll(pairs.select("a")).unionAll(pairs.select("b"))
    sets = _shingle_sets(documents, stage(nodes.distinct(), "nodes", files), classes, shingle, files)
    sides = [sets.select(F.col("node").alias(c), F.col("hashes").alias(h)) for c, h in (("a", "x"), ("b", "y"))]
    first = stage(map_batches(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y"), _alike(similarity), "a long, b long"), "similar", files)
    roots = connected_components(first, files=files).select("node", "root")
    rest = stage(_meetings(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), sets, similarity, block), "similar", files)
    roots = connected_components(first.unionAll(rest), files=files).select("node", "root")
    of = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("group_id"))
    return rows.select("doc_id", "digest").join(of, "digest").select("doc_id", "group_id")


def golay_pairs(classes: DataFrame, files: int | None = None) -> DataFrame:
    """(a, b): candidates among classes (node, size, fp), by Golay-code keys of their fingerprints.

    The least nodes of fingerprints that links() joins, and each node with the least one of its own fingerprint.
    """
    some = classes.filter("size > 0")
    least = stage(some.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints", files)
    own = some.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"n{c}")) for c in ("a", "b"))
    met = links(least.select("fp"), files=files).select("a", "b").join(x, "a").join(y, "b")
    return own.unionAll(met.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def _meetings(members: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): links that connect all members of a key that are alike and of different roots.

    Keys of two are settled against their least member already, and of keys with the same members (two 64-bit hashes of
    them) one is met. A key of more than `block` members, or of very long ones, is dealt as pairs of blocks.
    """
    of_key = members.groupBy("key").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"), F.min("root").alias("_low"), F.max("root").alias("_high"), F.expr("bit_xor(xxhash64(node))").alias("_x"), F.expr("bit_xor(xxhash64(node, 1))").alias("_y"))
    of_key = of_key.filter("_n > 2 and _low <> _high").groupBy("_n", "_size", "_x", "_y").agg(F.min("key").alias("key")).select("key", F.ceil(F.greatest(F.col("_n") / block, F.col("_size") / MEMBER_SHINGLES)).alias("blocks"))
    mine = members.select("key", "node", "root").join(of_key, "key").withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = mine.withColumn("j", F.explode(F.expr("if(blocks = 1, array(0L), array_remove(sequence(0L, blocks - 1), i))")))
    dealt = dealt.select("key", "node", "root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        found = alike(t.column("node").to_numpy(), t.column("root").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")], similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


def alike(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by pairs of sets as alike as asked; sets of one root are so already."""
    group, out = root.copy(), []
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    here = np.zeros(at.max() + 1, bool)
    for i in range(len(sets)):
        if (group == group[i]).all():
            continue
        mine = at[first[i] : first[i] + size[i]]
        here[mine] = True
        both = np.add.reduceat(here[at], first, dtype=np.int64)
        here[mine] = False
        for j in np.flatnonzero(_reaches(both, size + size[i], similarity)).tolist():
            if group[j] != group[i]:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                group[group == group[j]] = group[i]
    return out
