import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wickline.llm import bpe

from .conftest import EDGES

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
CODE, WHOLE = bpe.Coder(open(PATH, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(PATH)
ALPHABETS = ["ab", "thean", "abcdefghijklmnopqrstuvwxyz", "aeé中文ß", "!?#-", "th", "aA1'st<|>"]


def expected(text):
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    return ids, WHOLE.decode(ids, skip_special_tokens=False) if ids else ""


@given(st.sampled_from(ALPHABETS).flatmap(lambda a: st.text(a, min_size=1, max_size=200)), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_tree_equals_whole(run, leaf):
    got = []
    for pretoken, special in CODE.pretokens(run):
        got += [special] if special is not None else CODE.whole(pretoken, leaf)
    assert got == expected(run)[0]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    ids, decoded = expected(text)
    assert CODE.text(text.encode("utf-8", "replace")) == (" ".join(map(str, ids)), len(ids), decoded)


def test_plain_letters_and_marks():
    for c in map(chr, [*range(33, 0x400), 0x2028, 0x3000]):
        for text in (c, f"a{c}b", f"'{c}s", f"{c}{c}1_", f"x{c} {c}"):
            assert CODE.text(text.encode())[0] == " ".join(map(str, expected(text)[0]))


def test_documents(spark, documents):
    random.seed(2)
    rows = [*EDGES, (20, "".join(random.choices("abcdef", k=9000))), (21, "<|endoftext|>" + "z" * 300 + "<|startoftext|>" * 30), (22, "w " * 3 + "é" * 500 + " it's" * 40 + "\n" + "ab1-" * 200)]
    rows.append(rows[-1])
    got = bpe.encode_documents(documents(rows), PATH, leaf=100, with_ids=True).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids, decoded = expected(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_empty_table(spark, documents):
    assert bpe.encode_documents(documents([(1, "a")]).limit(0), PATH).collect() == []


def test_long_runs_without_tokens_keep_their_rows(spark, documents):
    rows = [(1, " " * 5_000), (1, " " * 5_000), (2, " 　" + "　" * 5_000), (None, " " * 5_000), (3, "a " + " " * 5_000)]
    got = bpe.encode_documents(documents(rows), PATH, with_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(rows)
    assert sorted(str(r.doc_id) for r in got if tuple(r[1:]) == (0, empty, empty, [])) == ["1", "1", "2", "None"]
    assert [(r.n_tokens, r.ids) for r in got if r.doc_id == 3] == [(1, expected("a")[0])]


def test_long_texts_go_through_the_tree():
    random.seed(4)
    code = bpe.Coder(open(PATH, encoding="utf-8").read())
    words = ["the", "don't", "naïve", "日本語", "x" * 60, "<|endoftext|>", "12ab", "ÉCOLE", "a-b"]
    for leaf in (3, 7, 50, 300):
        text = "".join(random.choice(words) + random.choice([" ", "  ", "\n", "\u00a0", ". "]) for _ in range(500))
        ids, decoded = expected(text)
        assert code.text(text.encode(), leaf) == (" ".join(map(str, ids)), len(ids), decoded)
    assert code.seams > 1_000


def test_the_tree_is_the_path_of_long_documents(spark):
    code, seen = bpe.Coder(open(PATH, encoding="utf-8").read()), 0
    for (text,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("octet_length(text) > 4096").collect():
        before = code.seams
        ids, decoded = expected(text)
        assert code.text(text.encode()) == (" ".join(map(str, ids)), len(ids), decoded)
        seen += code.seams > before
    assert seen > 5


def test_a_file_that_keeps_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    code, library = bpe.Coder(open(path, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(path)
    assert not code.by_word and CODE.by_word
    random.seed(5)
    for leaf in (5, 40, 4096):
        for text in ["Hello World and more", "", "  a  b\n\n c ", "<|endoftext|>x" * 9, "z" * 500 + " Ünïcode's  " + "ab" * 300, *("".join(random.choices("aB é\n'1中<|", k=200)) for _ in range(40))]:
            ids = library.encode(text, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False) if ids else ""
            assert code.text(text.encode(), leaf) == (" ".join(map(str, ids)), len(ids), decoded)


def test_spread_texts_of_either_kind_of_file(spark, documents):
    random.seed(6)
    rows = [(1, " ".join("".join(random.choices("abcde", k=7)) for _ in range(900))), (2, "Short one"), (3, "Some " + "y" * 3_000 + " End")]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
        got = {r.doc_id: r.ids for r in bpe.encode_documents(documents(rows), public_tokenizers.path(name), leaf=100, spread=2_000, with_ids=True).collect()}
        assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_files_of_other_kinds_are_refused():
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"type": "WordPiece"}, {"dropout": 0.1}, {"continuing_subword_prefix": "##"}):
        with pytest.raises(ValueError):
            bpe.Coder(json.dumps(spec | {"model": spec["model"] | change}))


def test_workers_keep_no_words_between_tasks(spark, documents):
    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(c.known) + len(c.older) for c in bpe._coders.values())], pa.int64()), pa.array([len(bpe._coders)], pa.int64())], ["words", "coders"])

    bpe.encode_documents(documents([(i, f"word{i} of many") for i in range(2_000)]).repartition(16), PATH).collect()
    rows = spark.range(64).repartition(16).mapInArrow(kept, "words long, coders long").collect()
    assert sum(r.coders for r in rows) and not sum(r.words for r in rows)
