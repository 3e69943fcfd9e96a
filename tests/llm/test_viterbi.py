"""The shared-prefix Viterbi pass against the library, on unigram vocabularies put together by hand (none is trained)."""

import random
import struct

import pytest
import sentencepiece

from featlake.llm import pieces

ABC = "abcdeé日"


def field(number, value):
    """A field of a serialized message: an int, a float, or bytes."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(made, with_bytes):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    rows += [(t, score, 1) for t, score in made]
    out = b"".join(field(1, field(1, t.encode()) + field(2, score) + field(3, kind)) for t, score, kind in rows)
    trainer = field(3, 1) + (field(35, 1) if with_bytes else b"")
    normal = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return out + field(2, trainer) + field(3, normal)


def vocabulary(rng):
    made = {rng.choice(["", "▁"]) + "".join(rng.choices(ABC[:5], k=rng.randint(1, 5))) for _ in range(60)} | {"▁", "▁▁", "a", "b", "é", "日日"}
    return [(t, -rng.randint(1, 80) / 8) for t in sorted(made)]  # eighths add up exactly, in the library's floats too


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_paths_equal_the_library(tmp_path, with_bytes):
    rng = random.Random(3)
    for round_ in range(12):
        path = tmp_path / f"{round_}.model"
        path.write_bytes(model(vocabulary(rng), with_bytes))
        sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
        p = pieces.Pieces(str(path))
        assert p.unigram
        texts = [" ".join("".join(rng.choices(ABC + "xy", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 8))) for _ in range(120)]
        got = pieces._encoded(texts, p, {})
        for t, ids in zip(texts, got, strict=True):
            ids = list(struct.unpack(f"<{len(ids) // 4}I", ids))
            assert ids == sp.encode(t), (t, ids, sp.encode(t))
            assert not with_bytes or p.decode(ids) == t


def test_unigram_scores_are_the_best_of_all_cuts(tmp_path):
    rng = random.Random(5)
    path = tmp_path / "all.model"
    path.write_bytes(model(vocabulary(rng), True))
    p = pieces.Pieces(str(path))

    def best(w):
        cuts = [p.score[p.id[w]]] if w in p.id else []
        for k in range(1, len(w)):
            if w[:k] in p.id:
                cuts.append(p.score[p.id[w[:k]]] + best(w[k:]))
        if w and w[0] not in p.id:
            cuts.append(p.low + (best(w[1:]) if len(w) > 1 else 0.0))
        return max(cuts, default=-1e9)

    for _ in range(200):
        w = "▁" + "".join(rng.choices(ABC, k=rng.randint(0, 8)))
        last = [(0, 0, 0.0)] + [(-1, 1)] * len(w)
        p.forward_best(w, last, 0)
        assert last[-1][2] == best(w)


def test_prefix_scores_are_shared(tmp_path):
    path = tmp_path / "shared.model"
    path.write_bytes(model(vocabulary(random.Random(7)), True))
    p, begun = pieces.Pieces(str(path)), []
    step = p.forward_best
    p.forward_best = lambda w, best, start: (begun.append(start), step(w, best, start))[1]
    p.encode_words(["▁abc", "▁abcd", "▁abd", "▁b"])
    assert begun == [0, 4, 3, 1]


def test_a_vocabulary_across_words_is_refused(tmp_path):
    path = tmp_path / "across.model"
    path.write_bytes(model([("▁a", -1.0), ("a▁b", -2.0)], True))
    with pytest.raises(ValueError, match="several words"):
        pieces.Pieces(str(path))
    assert not pieces.Pieces(pieces.default_model()).unigram
