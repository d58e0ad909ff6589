"""Chat formatting from event logs.

A log row is one event: (conv_id, seq, message, kind, role, text).  ``open``
always starts a message and may carry its first text, ``delta`` appends streamed
text, ``edit`` replaces the text so far and ``regenerate`` throws it away (and
may carry the start of the new one).  Logs are partitioned by conversation and
sorted by sequence, the events of each message are folded into its final text,
and messages are rendered by a template whose control strings are escaped
inside texts, so that the output can be read back exactly.

The rows of a conversation come to one task in order and are folded, rendered
and read back as a stream: a task holds the events of one message at a time,
never a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
# Strings that a text must not smuggle into the output as control.
CONTROL = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string, and double backslashes."""
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}" if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn, and the span of its text in it."""
    head = OPEN + escape_role(role) + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


_HEAD = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL)


def read_turn(rendered: str) -> tuple[str, str]:
    """(role, text) of one rendered turn."""
    if not rendered.startswith(OPEN) or not rendered.endswith(CLOSE):
        raise ValueError("not a rendered turn")
    role = _HEAD.match(rendered, len(OPEN))
    return unescape(role[0]), unescape(rendered[role.end() + len(MIDDLE) : -len(CLOSE)])


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Final (conv_id, role, text) of the sorted events' messages, one after the other."""
    at = None
    role, texts = "", []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text"))
        for conv, message, kind, new_role, new in zip(*columns):
            if at != (conv, message) or kind == "open":
                if at is not None:
                    yield at[0], role, "".join(texts)
                at, role, texts = (conv, message), "", []
            role = role or new_role or ""
            if kind in ("edit", "regenerate"):
                texts = []
            texts.append(new or "")
    if at is not None:
        yield at[0], role, "".join(texts)


SCHEMA = "conv_id long, turn long, formatted string, loss_from int, loss_to int"


def format_conversations(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, formatted, loss_from, loss_to): rendered turns in order.

    ``events`` has conv_id, seq, message, kind, role and text.  A message's place
    is that of its number; its role is the first that is not null or empty.  The
    loss mask is [loss_from, loss_to) of each turn of role ``trained``, else
    empty.  Null texts and roles are empty; events without a conversation belong
    to conversation null.  Events that tie in seq are folded in the order of kind
    and text.  Repeated events are events; other columns are ignored, whatever their
    names.  Concatenating a conversation's
    ``formatted`` by turn gives its full text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, conv, turn = [], 0, object(), 0
        names = ("conv_id", "turn", "formatted", "loss_from", "loss_to")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        for c, role, text in _messages(batches):
            turn, conv = (turn + 1 if c == conv else 0), c
            out, start, end = render(role, text)
            rows.append((c, turn, out, *((start, end) if role == trained else (0, 0))))
            size += len(out)
            if size > 4_000_000 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return _by_conversation(events.select("conv_id", "seq", "message", "kind", "role", "text"), "message", "seq", "kind", "role", "text").mapInArrow(run, SCHEMA)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", *order)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read from rendered turns that are sorted by conversation and turn.

    The turns of a conversation must stand together in order, as
    ``format_conversations`` leaves them; the digests are taken as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done, state = [], None

        def close():
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)
            done.clear()
            return out

        for b in batches:
            for conv, out, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(out)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(out[start:end])
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(out)
            if len(done) >= 1000:
                yield batch()
        if state is not None:
            close()
        if done:
            yield batch()

    return formatted.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
