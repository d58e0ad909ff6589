import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from wickline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as file:
        return pieces.Coder(pieces.Tables(pieces.Vocabulary(file.read())))


ODD = ["", " ", "   a    b ", "▁x a▁b", "\x00a\x7f", "<s></s><unk><0x41>", "é𝕏 ́", " " * 37, "a" * 300, "ab" * 200 + " " * 100 + "x", "中文字符测试" * 30, "\r\n\r\n\t\t", "x" * 5000, "👩‍👩‍👧‍👦 ok"]


def test_ids_and_texts_of_odd_texts(coder, library):
    for text in ODD:
        ids = coder.encode(text)
        assert ids == [1, *library.encode(text), 2]
        assert coder.decode(ids) == library.decode(ids)


def test_ids_of_random_texts(coder, library):
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice("  ▁aaabcdefgéñ\n\t.,!?-=()中日𝕏lnth") for _ in range(rng.randint(0, 60)))
        assert coder.encode(text) == [1, *library.encode(text), 2]
    assert coder.taken_back > 0


def test_decoding_any_ids(coder, library):
    rng = random.Random(9)
    for _ in range(1500):
        ids = [rng.choice([1, 2, 0, 29871, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids)


def test_backtracking_is_the_merges(coder):
    """Against merges over the whole text, also where every piece of a small vocabulary overlaps others."""
    rng = random.Random(10)
    for _ in range(200):
        scores = {c: 0.0 for c in "abc"}
        while len(scores) < 14:
            a, b = rng.choice(sorted(scores)), rng.choice(sorted(scores))
            scores.setdefault(a + b, float(rng.choice([-len(scores), -5])))  # some scores are equal, some better than those of their parts
        tables = pieces.Tables.__new__(pieces.Tables)
        tables.scores = scores
        tables.reachable = [t for t in scores if len(t) > 1 and pieces.remerged(t, scores) == [t]]
        tables.shorter = {t: next((t[:n] for n in range(len(t) - 1, 1, -1) if t[:n] in tables.reachable), t[0]) for t in tables.reachable}
        tables.apart = "(?s:.+)"
        small = pieces.Coder(tables)
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 25)))
            assert small.tokens(text) == pieces.remerged(text, scores)


def test_documents(spark, documents, library):
    rows = [(r[0], r[1]) for r in EDGES] + [(100 + i, t) for i, t in enumerate(ODD)]
    got = sorted((tuple(r) for r in pieces.encode_documents(documents(rows), PATH, with_ids=True).collect()), key=repr)

    def wanted(doc_id, text):
        ids = [1, *library.encode(text or ""), 2]
        return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids

    assert got == sorted((wanted(*r) for r in rows), key=repr)


def test_empty_table_and_repeated_encodings(spark, documents):
    assert pieces.encode_documents(documents([]), PATH).collect() == []
    ids = pieces.encode_documents(documents([(1, "a b"), (1, "a b")]).select("doc_id", "text", F.lit(1).alias("n_tokens")), PATH).collect()
    assert len(ids) == 2 and ids[0] == ids[1]


def test_other_models_are_refused():
    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 127 | 0, value]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4, value])
        return bytes([number << 3 | 2, len(value)]) + value

    piece = field(1, b"a")
    byte = field(1, b"<0x41>") + field(3, pieces.BYTE)
    bpe, plain = field(3, pieces.BPE), field(4, 0)
    fine = field(1, piece) + field(1, byte) + field(1, byte) + field(2, bpe) + field(3, plain)
    assert pieces.Vocabulary(fine).pieces[0] == ("a", 0.0, pieces.NORMAL)
    for model in (
        field(1, piece) + field(1, byte) + field(2, field(3, 1)) + field(3, plain),  # unigrams
        field(1, piece) + field(2, bpe) + field(3, plain),  # without bytes
        fine + field(1, field(1, b"x") + field(3, pieces.USER_DEFINED)),
        field(1, piece) + field(1, byte) + field(1, byte) + field(2, bpe) + field(3, plain + field(2, b"rules")),
        field(1, piece) + field(1, byte) + field(1, byte) + field(2, bpe) + field(3, field(4, 1)),  # removes spaces
    ):
        with pytest.raises(ValueError):
            pieces.Vocabulary(model)


def test_pieces_without_bytes_are_joined_and_places_are_kept_only_when_needed(coder, library):
    tokens = coder.tokens("▁plain")
    assert coder.surface(coder.ids(tokens)) == b" plain" and coder.ids(tokens) == library.encode("plain")
    assert coder.tokens("") == [] and coder.surface(coder.ids(["▁", "\U0001f9ff"])) == " \U0001f9ff".encode()
