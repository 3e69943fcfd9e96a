"""Packing by a bounded-space online algorithm.

Each partition keeps OPEN windows open. A document's ids come in order; whole windows are emitted as they are, and the
rest goes to the open window that it fills best. When it fits none, the fullest window is emitted: what it lacks is cut
from the piece, so that it is full. What is left open at the end of the partitions is merged in a tree: GROUP neighbours
run their leftovers together and cut them at every window, GROUP of the rests meet in the next round and so on; the
last rest is cut at powers of two. So no sequence is padded, a document is cut only where a window ends, and no task
holds the leftovers of more than GROUP tasks.

sequence_id is made from the round, the partition or group, and a counter; offset is gapless from 0 in each sequence.

Defined cases: null and empty texts are one end mark; very long texts are cut in as many windows as they need and are
tokenized in one piece; repeated rows are packed like others; an empty table gives an empty result; a null doc_id
stays null.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import map_batches, parts_for, stage, text_files

LENGTH, OPEN, END = 2048, 32, 1
#: Fixed value: the added tokens of byte_bpe_50k.json, which it finds inside texts whether or not it adds any itself.
SPECIAL = {"<|endoftext|>": 50256}
#: Partitions, or rests of the round before, whose leftovers are merged in one task.
GROUP = 8

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoder of a rank file; SPECIAL's strings in a text are the tokens of these ids, unless the file ranks such an id."""
    if path not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        ids = set(ranks.values())
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={k: v for k, v in SPECIAL.items() if v not in ids})
    return _encoders[path]


def default_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the byte-level vocabulary: the same ids as byte_bpe_50k.json, several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPENED = PIECE + ", ids binary, part long"


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_sequence: int, open_windows: int = OPEN, length: int = LENGTH):
        self.next, self.most, self.length = first_sequence, open_windows, length
        self.open: list[tuple[list, int]] = []  # pieces, tokens
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self.emit([(doc, at, ids[at : at + self.length], total)])
            at += self.length
        if at < total:
            self.place((doc, at, ids[at:], total))

    def place(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        n = len(ids)
        fits = [k for k, (_, used) in enumerate(self.open) if used + n <= self.length]
        if fits:
            best = max(fits, key=lambda k: self.open[k][1])
            pieces, used = self.open[best]
            pieces.append(piece)
            if used + n == self.length:
                self.emit(pieces)
                del self.open[best]
            else:
                self.open[best] = pieces, used + n
        elif len(self.open) < self.most:
            self.open.append(([piece], n))
        else:
            best = max(range(len(self.open)), key=lambda k: self.open[k][1])
            pieces, used = self.open.pop(best)
            gap = self.length - used
            self.emit([*pieces, (doc, start, ids[:gap], total)])
            self.place((doc, start + gap, ids[gap:], total))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_NAMES = [x.split()[0] for x in PIECE.split(", ")]
_SCHEMA = pa.schema([*((n, pa.int64()) for n in _NAMES), ("ids", pa.binary()), ("part", pa.int64())])


def _merge(rows: list[tuple], first_sequence: int, last: bool, part: int, length: int) -> list[tuple]:
    """Run pieces (doc, start, ids, total) together and cut at every window; the rest stays open unless last."""
    p = Packer(first_sequence, length=length)
    window, used = [], 0
    for doc, start, ids, total in rows:
        while len(ids):
            n = min(len(ids), length - used)
            window.append((doc, start, ids[:n], total))
            start, ids, used = start + n, ids[n:], used + n
            if used == length:
                p.emit(window)
                window, used = [], 0
    if not last:
        return [(*x, None, part) for x in p.out] + [(d, s, len(i), None, t, None, None, i.tobytes(), part) for d, s, i, t in window]
    size = length
    while window:  # the rest, at powers of two
        while size > used:
            size //= 2
        taken, left, room = [], [], size
        for doc, start, ids, total in window:
            n = min(room, len(ids))
            if n:
                taken.append((doc, start, ids[:n], total))
            if n < len(ids):
                left.append((doc, start + n, ids[n:], total))
            room -= n
        p.emit(taken)
        window, used = left, used - size
    return [(*x, None, part) for x in p.out]


def _merged(level: int, last: bool, length: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        cols = t.select(["part", "doc_id", "start", "ids", "doc_tokens"]).to_pydict()
        rows = sorted(zip(*cols.values(), strict=True), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        pieces = [(d, s, np.frombuffer(i, "<u4"), n) for _, d, s, i, n in rows]
        part = key[0].as_py()
        return pa.Table.from_batches([_arrow(_merge(pieces, level << 56 | part << 24, last, part, length), _SCHEMA)])

    return run


def pack(documents: DataFrame, vocabulary: tuple[str, str] | None = None, open_windows: int = OPEN, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        p = Packer(part << 32, open_windows, length)
        of = encoder(path, pattern)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = of.encode(text.as_py() or "", allowed_special="all")
                ids.append(END)
                p.add(doc, np.array(ids, "<u4"))
            if p.out:
                yield _arrow([(*x, None, part) for x in p.out], _SCHEMA)
                p.out = []
        rows = [(d, s, len(i), None, t, None, None, i.tobytes(), part) for pieces, _ in p.open for d, s, i, t in pieces]
        if rows:
            yield _arrow(rows, _SCHEMA)

    done = stage(map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, OPENED), "pieces", text_files(documents))
    out, open_rows = done.filter("sequence_id is not null").select(*_NAMES), done.filter("sequence_id is null")
    parts, level = (open_rows.agg(F.max("part")).first()[0] or 0) + 1, 0
    while level == 0 or parts > 1:
        parts, level = -(-parts // group), level + 1
        merged = open_rows.withColumn("g", F.expr(f"part div {group}")).groupBy("g").applyInArrow(_merged(level, parts == 1, length), OPENED)
        merged = stage(merged, "merged", parts_for(parts))
        out, open_rows = out.unionAll(merged.filter("sequence_id is not null").select(*_NAMES)), merged.filter("sequence_id is null")
    return out
