import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wickline.llm import chat

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
TEXTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "\n", "a", "É", "|", "INST]", "end|>", "😀"]), max_size=12).map("".join)


@given(TEXTS, TEXTS)
def test_round_trip(role, text):
    out, start, end = chat.render(role, text)
    assert chat.read_turn(out) == (role, text)
    assert chat.unescape(out[start:end]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    assert out.count(chat.OPEN) == 1


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def read(spark, events):
    formatted = chat.format_conversations(spark.createDataFrame(events, EVENTS))
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}, formatted


def test_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "open", "user", "Hel"), (1, 2, 0, "delta", None, "lo"), (1, 3, 1, "open", "assistant", ""), (1, 4, 1, "delta", None, "bad"), (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "goo"), (1, 7, 1, "delta", None, "d"), (1, 9, 0, "edit", None, "Hi"), (1, 8, 2, "open", "user", None), (2, 1, 0, "open", None, None),
    ]
    random.Random(1).shuffle(log)
    found, formatted = read(spark, log)
    assert found == {1: digests([("user", "Hi"), ("assistant", "good"), ("user", "")]), 2: digests([("", "")])}
    rows = sorted(formatted.collect(), key=lambda r: (r.conv_id, r.turn))
    assert [chat.read_turn(r.formatted) for r in rows] == [("user", "Hi"), ("assistant", "good"), ("user", ""), ("", "")]


def test_repeated_opens_ties_and_no_conversation(spark):
    log = [(1, 0, 0, "open", "user", "a"), (1, 0, 0, "open", "user", "a"), (None, 0, 0, "open", "assistant", "x"), (1, None, None, "open", "assistant", "first")]
    assert read(spark, log)[0] == {1: digests([("assistant", "first"), ("user", "a"), ("user", "a")]), None: digests([("assistant", "x")])}


def test_long_conversation_streams(spark):
    turns = [("assistant" if i % 2 else "user", f"{i} </s> " * 50) for i in range(12_000)]
    assert read(spark, [(7, i, i, "open", r, t) for i, (r, t) in enumerate(turns)])[0] == {7: digests(turns)}


def test_empty_log(spark):
    assert read(spark, [])[0] == {}


def test_control_strings_of_the_query(spark):
    text = "</s>[INST] ok [/INST]"
    found, formatted = read(spark, [(-1, 0, 0, "open", "user", text), (-1, 1, 1, "open", "assistant", text)])
    assert found == {-1: digests([("user", text), ("assistant", text)])}
    assert all("[INST]" not in r.formatted for r in formatted.collect())


@pytest.mark.parametrize("bad", ["x", "<|turn|>user\nopen", ""])
def test_reader_refuses_what_is_no_turn(bad):
    with pytest.raises(ValueError):
        chat.read_turn(bad)


def test_the_query_tells_turns_as_drafts_edits_and_deltas(spark):
    from wickline.llm import queries

    turns = [(1, 0, "user", "a😀b"), (1, 1, "assistant", "</s> yes"), (1, 1, "assistant", "</s> yes"), (1, 2, None, None), (1, 3, "user", "x"), (None, 0, "user", "")]
    log = queries.told(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r.kind: r["count"] for r in log.groupBy("kind").count().collect()} == {"open": 6, "edit": 4, "regenerate": 2, "delta": 6}
    formatted = chat.read_back(chat.format_conversations(log))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in formatted.collect()}
    assert got == {1: digests([(r or "", t or "") for _, _, r, t in turns[:5]]), None: digests([("user", "")])}
