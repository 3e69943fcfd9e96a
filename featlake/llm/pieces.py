"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch are sorted, which lays out their trie depth first, and each word goes on from the
forward scores of the prefix that it shares with the one before it. At each place the pass keeps the best last piece:

* with a unigram vocabulary the one whose path has the highest sum of scores (Viterbi; of equals the longest piece);
* with a BPE vocabulary, whose scores rank merges and whose best sum is not its segmentation, the piece t whose
  predecessor p (the last piece of the shorter prefix) stays beside it, that is, p + t merge to p and t again. There is
  just one, and as with scores it depends on nothing after it.

A text is its marked form (a mark in front, each space as a mark) cut before each mark that follows another
character; no piece spans such a cut (a vocabulary with one that does is refused). Characters outside the vocabulary
are bytes, or the unknown piece where it has no bytes.

Defined cases: null counts as empty, without pieces, and decodes to the empty text; a text's own U+2581 decodes to a
space, as in the format; repeated rows give the same; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featlake.llm.common import map_batches

MARK = "▁"
#: A marked word: marks, then what is not a mark.
WORD = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
#: Marked words whose pieces a task remembers, and how long a word may be to be remembered.
REMEMBERED, LONGEST = 600_000, 64
#: Pairs of pieces whose standing side by side a task remembers.
PAIRS = 2_000_000
#: Fixed values of the format: how far below the least score an unknown character is, and the two kinds of model.
UNKNOWN_PENALTY, UNIGRAM, BPE = 10.0, 1, 2
#: Fixed value: what the unknown piece decodes to.
UNKNOWN_TEXT = " \u2047 "


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return out

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, message[at : at + size]
        at += size


def kind_of(model: bytes) -> int:
    """Kind of a serialized model: field 3 of its trainer's settings, which are field 2; unigram where nothing is said."""
    for number, value in _fields(model):
        if number == 2:
            return next((v for n, v in _fields(value) if n == 3), UNIGRAM)
    return UNIGRAM


class Pieces:
    """A SentencePiece vocabulary, unigram or BPE."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = kind_of(sp.serialized_model_proto())
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"{path} is neither a unigram nor a BPE vocabulary")
        self.unigram = kind == UNIGRAM
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}", self.text[i]) for i in plain):
            raise ValueError(f"{path} has pieces of several words")
        self.id = {self.text[i]: i for i in plain}
        self.score = {i: sp.get_score(i) for i in plain}
        self.low = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        byte = [i for i in range(n) if sp.is_byte(i)]
        self.byte = {int(self.text[i][3:5], 16): i for i in byte}
        self.of_byte = {i: b for b, i in self.byte.items()}
        #: Finds all pieces that end at each place, longest first; those that no merging gives are left out.
        self.ends = ahocorasick.Automaton()
        for t, i in self.id.items():
            if self.unigram or len(t) == 1 or self.merge(t) == [t]:
                self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        self.stable: dict[int, bool] = {}

    def merge(self, chars: str) -> list[str]:
        """Pieces of a string by merging the best pair again and again, the leftmost of equals."""
        part: list[str | None] = list(chars)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0:
                s = part[i] + part[right[i]]
                if (k := self.id.get(s)) is not None:
                    heapq.heappush(heap, (-self.score[k], i, s))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != s:
                continue
            part[i], part[j] = s, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            offer(left[i])
        return [p for p in part if p is not None]

    def beside(self, p: int, t: int) -> bool:
        """Whether the piece p followed by t stays p and t."""
        key = p << 20 | t
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            a, b = self.text[p], self.text[t]
            known = self.stable[key] = self.merge(a + b) == [a, b]
        return known

    def forward(self, word: str, last: list[tuple[int, int]], start: int) -> None:
        """Fill last[start + 1:] with the last piece (id, length) of each prefix, given those of shorter prefixes.

        A character outside the vocabulary is a piece of id -1, beside which anything stays.
        """
        stable, done = self.stable, start
        for at, (t, size) in self.ends.iter(word):
            end = at + 1
            if end <= done:
                continue
            while done < end - 1:  # no piece ends there
                done += 1
                last[done] = (-1, 1)
            p = last[end - size][0]
            if size == end or p < 0:
                fits = True
            else:
                fits = stable.get(p << 20 | t)
                if fits is None:
                    fits = self.beside(p, t)
            if fits:
                last[end] = (t, size)
                done = end
        while done < len(word):
            done += 1
            last[done] = (-1, 1)

    def forward_best(self, word: str, best: list[tuple[int, int, float]], start: int) -> None:
        """Fill best[start + 1:] with the last piece (id, length) and the score of the best path to each place, given those before."""
        done, low, score = start, self.low, self.score

        def close(end: int) -> None:
            """Settle a place at which all pieces are known: an unknown character only where no piece of one character ends."""
            if not single and (top is None or best[end - 1][2] + low > top[2]):
                best[end] = (-1, 1, best[end - 1][2] + low)
            else:
                best[end] = top

        top, single = None, False
        for at, (t, size) in self.ends.iter(word):
            end = at + 1
            if end <= start:
                continue
            while done + 1 < end:
                done += 1
                close(done)
                top, single = None, False
            path = best[end - size][2] + score[t]
            if top is None or path > top[2]:
                top = (t, size, path)
            single = single or size == 1
        while done < len(word):
            done += 1
            close(done)
            top, single = None, False

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct marked words, in one pass over their sorted order."""
        out, before, last = {}, "", [(0, 0, 0.0)]
        step = self.forward_best if self.unigram else self.forward
        for w in sorted(words):
            n, most = 0, min(len(w), len(before))
            while n < most and w[n] == before[n]:
                n += 1
            del last[n + 1 :]
            last += [(-1, 1)] * (len(w) - n)
            step(w, last, n)
            found, at = [], len(w)
            while at:
                t, size = last[at][:2]
                if t >= 0:
                    found.append(t)
                elif self.byte:
                    found += [self.byte[b] for b in reversed(w[at - 1].encode())]
                elif not found or found[-1] != self.unknown:  # unknown characters side by side are one piece
                    found.append(self.unknown)
                at -= size
            found.reverse()
            out[w] = struct.pack(f"<{len(found)}I", *found)
            before = w
        return out

    def decode(self, ids: Sequence[int]) -> str:
        out = bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                out.append(b)
            elif i == self.unknown:
                out += UNKNOWN_TEXT.encode()
            elif i not in self.silent:
                out += self.text[i].encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}
#: Ids of remembered words by model; a Python worker keeps them from task to task.
_known: dict[str, dict[str, bytes]] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def marked_words(text: str) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoded(texts: list[str], p: Pieces, known: dict[str, bytes]) -> list[bytes]:
    """Ids of each text; new words of all texts go through one pass and are remembered, the oldest half forgotten when full."""
    cut = [marked_words(t) for t in texts]
    fresh = p.encode_words(list({w for ws in cut for w in ws} - known.keys()))
    known.update(fresh)
    out = [b"".join(map(known.__getitem__, ws)) for ws in cut]
    for w in fresh:
        if len(w) > LONGEST:
            del known[w]
    if len(known) > REMEMBERED:
        recent = dict(islice(known.items(), len(known) // 2, None))
        known.clear()
        known.update(recent)
    return out


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known = pieces(path), _known.setdefault(path, {})
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for s, e in _slices([len(t) for t in texts], 1 << 20):
                ids = _encoded(texts[s:e], p, known)
                at = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give the empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def round_trips(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_chars, decoded_sha256 of every document."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known = pieces(path), _known.setdefault(path, {})
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for s, e in _slices([len(t) for t in texts], 1 << 20):
                ids = _encoded(texts[s:e], p, known)
                back = [p.decode(struct.unpack(f"<{len(i) // 4}I", i)) for i in ids]
                cols = [
                    b.column(0).slice(s, e - s),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string")
