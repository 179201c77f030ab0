"""Agenda encoding against the sentencepiece library on whole texts, odd rows, and other kinds of vocabulary."""

import hashlib
import random
import struct

import pytest

from quaylight.llm import pieces
from quaylight.llm.queries import piece_model

LETTERS = "ab t i n g the \t\n é漢字▁\U0001f600 ́\x00<s></s><0x0A>  ﬁ.,;7"
ODD = ["", " ", "   ", "▁", "a▁▁b", " a", "a ", "\n", "<s>", "</s> x", "<0x0A>", "x" * 500, " " * 7, "the " * 4000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(80))) for _ in range(1500)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.mark.parametrize("size", [pieces.SLICE, 40])
def test_ids_are_the_library_s(texts, library, size, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", size)
    coder = pieces.PieceCoder(piece_model())
    ids, sizes, odd = coder.encoded(texts, check=True)
    assert coder.by_word and coder.as_is and not odd.any()
    at = 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text)
        at += n
    assert at == len(ids)


def test_heap_and_vector_steps_agree(texts):
    coder = pieces.PieceCoder(piece_model())
    words = sorted({w for t in texts for w in coder.library.normalize(t).split(" ") if w})
    ids, sizes = coder.short_words(words)
    assert ids.tolist() == [i for w in words for i in coder.coded(w)]
    assert sizes.tolist() == [len(coder.coded(w)) for w in words]


@pytest.mark.parametrize("check", ["words", "texts", "none"])
def test_rows(spark, texts, library, check):
    rows = [(k, t, "en", "x", 1) for k, t in enumerate([*texts[:200], None, None])] + [(None, "two words", "en", "x", 1)] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded string, agrees int").repartition(3)
    found = pieces.encode_pieces(frame, piece_model(), check=check).collect()
    want = {d: library.encode(t or "", add_eos=True) for d, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == want[r.doc_id] and r.decoded == library.decode(r.ids)
        assert r.agrees is (None if check == "none" else True)
    digest = {r.doc_id: r for r in pieces.piece_digest(pieces.encode_pieces(frame, piece_model())).collect()}
    for d, ids in want.items():
        assert digest[d].n_tokens == len(ids)
        assert digest[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[d].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(frame.limit(0), piece_model()).count() == 0


def test_decode_keeps_other_columns(spark, library):
    frame = spark.createDataFrame([(1, [450, 937, 2], "k"), (2, [], "l"), (3, None, "m")], "n int, ids array<int>, decoded string")
    found = {r.n: r for r in pieces.decode_pieces(frame.withColumn("other", frame.decoded), piece_model()).collect()}
    assert {n: (r.decoded, r.other) for n, r in found.items()} == {1: (library.decode([450, 937, 2]), "k"), 2: ("", "l"), 3: (None, "m")}


def message(number, value):
    """One field of a protocol buffer message: bytes, whole number or float."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def small_model(vocabulary, extra=b""):
    """A merge-type model without byte pieces."""
    head = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    out = b"".join(message(1, message(1, t.encode()) + message(2, s) + message(3, k)) for t, s, k in [*head, *vocabulary])
    return out + message(2, message(3, 2)) + message(3, message(1, b"identity") + message(4, 0) + extra)


@pytest.mark.parametrize(
    "more",
    [
        [],
        [("a▁b", -0.5, pieces.NORMAL)],
        [("bc", -0.1, pieces.UNUSED), ("abc", -0.2, pieces.NORMAL)],
        [("bca", 0.0, pieces.USER), ("ab", -0.3, pieces.NORMAL)],
    ],
)
def test_other_vocabularies(tmp_path, more):
    """Ties of scores, unknown letters in a row, pieces across words, unused and user-defined pieces."""
    import sentencepiece

    vocabulary = [(c, -9.0, pieces.NORMAL) for c in "abc▁"] + [(p, -1.0, pieces.NORMAL) for p in ("▁a", "aa", "cb", "ca")] + more
    path = tmp_path / "small.model"
    path.write_bytes(small_model(vocabulary))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    coder = pieces.PieceCoder(str(path))
    rng = random.Random(2)
    texts = ["".join(rng.choice("aabbcc xy") for _ in range(rng.randrange(25))) for _ in range(400)]
    ids, sizes, _ = coder.encoded(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t)]
    assert sizes.tolist() == [len(library.encode(t)) for t in texts]
