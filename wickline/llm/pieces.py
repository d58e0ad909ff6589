"""SentencePiece BPE by backtracking over longest matches.

An Aho-Corasick automaton of the pieces gives the longest piece that starts at
each place of a text.  From left to right the longest one is taken that goes
with its left neighbour, the next shorter one if it does not, and if none does
the last token is taken back; a bit for each place remembers that no encoding
goes on from there.  Two tokens go together if the merges, run anew over their
joined text, end in just these two.  A sequence whose neighbours all go
together is the one that BPE makes: a merge runs over characters in the order of
scores, and the first that crossed a border between tokens would also cross it
in the text of the two tokens alone.

Where no piece reaches from one character to the next, a text falls apart, and
a worker remembers the parts it has met.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts, and pairs of tokens, that a worker remembers in each of two generations.
REMEMBERED, PAIRS = 100_000, 200_000
#: Characters of a part that is remembered, and bytes of text whose results a worker holds at a time.
SHORT, AT_ONCE = 64, 500_000
#: Parts whose ids and texts are put together for the digests.
JOINED = 10_000

# The sign for a space, kinds of pieces and of models in a model file, and its fields that are read.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _SCORE, _KIND = 1, 2, 3
_MODEL_TYPE, _AS_SUFFIX, _BEGIN_ID, _END_ID = 3, 24, 41, 42
_RULES, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, message[at : at + size]
        at += size


class Vocabulary:
    """What is read of a model file: pieces with scores and kinds, and the ids of begin and end."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in fields(model):
            if number == _PIECES:
                f = dict(fields(value))
                self.pieces.append((f[_TEXT].decode(), float(np.frombuffer(f.get(_SCORE, bytes(4)), "<f4")[0]), f.get(_KIND, NORMAL)))
            elif number == _TRAINER:
                trainer = dict(fields(value))
            elif number == _NORMALIZER:
                normalizer = dict(fields(value))
        kinds = {kind for _, _, kind in self.pieces}
        if trainer.get(_MODEL_TYPE) != BPE or trainer.get(_AS_SUFFIX) or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("not a BPE model with byte pieces and without pieces of a user")
        if normalizer.get(_RULES) or normalizer.get(_REMOVE_EXTRA, 1) or not normalizer.get(_DUMMY_PREFIX, 1) or not normalizer.get(_ESCAPE, 1):
            raise ValueError("only models that leave texts as they are, but for a space in front, are supported")
        self.begin, self.end = trainer.get(_BEGIN_ID, 1), trainer.get(_END_ID, 2)
        if any(not 0 <= i < len(self.pieces) for i in (self.begin, self.end)):
            raise ValueError("the model has no piece for begin or end")


def remerged(text: str, scores: dict[str, float]) -> list[str]:
    """BPE as it is defined: the neighbours with the best score are merged, the leftmost first."""
    tokens = list(text)
    while len(tokens) > 1:
        best, at = None, -1
        for i in range(len(tokens) - 1):
            score = scores.get(tokens[i] + tokens[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]
    return tokens


class Tables:
    """A vocabulary made ready on the driver: reachable pieces, their next shorter beginnings, and where texts fall apart."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.begin, self.end = vocabulary.begin, vocabulary.end
        self.scores = {text: score for text, score, kind in vocabulary.pieces if kind == NORMAL}
        self.ids = {text: i for i, (text, _, kind) in enumerate(vocabulary.pieces) if kind == NORMAL}
        self.plain = set(self.ids.values())
        self.bytes = [0] * 256
        self.surface: list[bytes | None] = []  # None: a byte
        self.byte_of: dict[int, int] = {}
        for i, (text, _, kind) in enumerate(vocabulary.pieces):
            if kind == BYTE:
                self.byte_of[i] = int(text[3:5], 16)
                self.bytes[self.byte_of[i]] = i
            self.surface.append(None if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode())
        # a piece that merges do not end in is never a token
        self.reachable = [text for text in self.scores if len(text) > 1 and remerged(text, self.scores) == [text]]
        known = set(self.reachable)
        self.shorter = {text: next((text[:n] for n in range(len(text) - 1, 1, -1) if text[:n] in known), text[0]) for text in self.reachable}
        joined = {a + b for text in self.scores for a, b in zip(text, text[1:])}
        alone = "".join(c for c in map(chr, range(128)) if not any(c in text for text in self.scores if len(text) > 1))
        alone = re.escape(alone)
        words = not any(pair[1] == SPACE != pair[0] for pair in joined)
        if words:
            self.apart = (f"[{alone}]|" if alone else "") + f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+"
        else:
            self.apart = f"[{alone}]|[^{alone}]+" if alone else "(?s:.+)"


class Coder:
    """Encodes and decodes by tables."""

    def __init__(self, tables: Tables) -> None:
        import ahocorasick

        self.tables = tables
        self.automaton = ahocorasick.Automaton()
        for piece in tables.reachable:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.apart = re.compile(tables.apart)
        self.pairs: list[dict] = [{}, {}]
        self.known: list[dict] = [{}, {}]
        self.taken_back = 0

    def together(self, left: str, right: str) -> bool:
        """Whether merges over the joined text of two tokens end in these two."""
        pair = left, right
        newer, older = self.pairs
        found = newer.get(pair)
        if found is None:
            found = older.get(pair)
            if found is None:
                found = remerged(left + right, self.tables.scores) == [left, right]
            if len(newer) >= PAIRS:
                self.pairs = [{}, newer]
            self.pairs[0][pair] = found
        return found

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text whose spaces are signs, by backtracking."""
        longest = list(text)
        for last, (before, piece) in self.automaton.iter(text):
            longest[last - before] = piece  # of those of one place, the longest ends last
        length, shorter, together, known = len(text), self.tables.shorter.get, self.together, self.pairs[0].get
        dead: bytearray | None = None
        out: list[str] = []
        at, left = 0, None
        token: str | None = longest[0] if text else None
        while at < length:
            while token is not None:
                fits = left is None or known((left, token))
                if fits is None:
                    fits, known = together(left, token), self.pairs[0].get
                if fits and (dead is None or not dead[at + len(token) >> 3] >> (at + len(token) & 7) & 1):
                    break
                token = shorter(token)
            if token is not None:
                out.append(token)
                at += len(token)
                left, token = token, longest[at] if at < length else None
            else:
                dead = dead or bytearray(length // 8 + 1)
                dead[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                left = out[-1] if out else None
                self.taken_back += 1
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        """Numbers of tokens; a character without a piece is its bytes."""
        known, of_byte = self.tables.ids, self.tables.bytes
        try:
            return [known[t] for t in tokens]
        except KeyError:
            pass
        return [i for t in tokens for i in ((known[t],) if t in known else [of_byte[b] for b in t.encode()])]

    def surface(self, ids: list[int]) -> bytes:
        """The text of ids, with the space in front; a byte that belongs to no character becomes U+FFFD."""
        surface, byte_of, out, run = self.tables.surface, self.tables.byte_of, [], bytearray()
        pieces = [surface[i] for i in ids]
        if None not in pieces:
            return b"".join(pieces)
        for i in ids:
            piece = surface[i]
            if piece is None:
                run.append(byte_of[i])
                continue
            if run:
                out.append(_characters(run))
                run = bytearray()
            out.append(piece)
        return b"".join([*out, _characters(run)])

    def _part(self, part: str) -> tuple[bytes, bytes]:
        newer, older = self.known
        found = older.get(part)
        if found is None:
            ids = self.ids(self.tokens(part))
            found = struct.pack(f"<{len(ids)}I", *ids), self.surface(ids)
        if len(part) <= SHORT:
            if len(newer) >= REMEMBERED:
                self.known = [{}, newer]
            self.known[0][part] = found
        return found

    def parts(self, text: str) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian integers, decoded text) of the parts of a text."""
        if not text:
            return []
        return [self.known[0].get(p) or self._part(p) for p in self.apart.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with begin and end."""
        return [self.tables.begin, *np.frombuffer(b"".join(ids for ids, _ in self.parts(text)), "<u4").tolist(), self.tables.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding set in front is taken off."""
        first = next((i for i in ids if self.tables.surface[i] != b""), None)
        spaced = first in self.tables.plain and self.tables.surface[first].startswith(b" ")
        return self.surface(ids)[spaced:].decode()


def _characters(run: bytearray) -> bytes:
    """UTF-8 of a run of bytes, of which each that is no part of a character becomes U+FFFD."""
    try:
        run.decode()
        return bytes(run)
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + n]).decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out).encode()


_coders: dict[int, Coder] = {}


def _coder(key: int, tables) -> Coder:
    """This worker's coder for broadcast tables."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(tables.value)
    return _coders[key]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, and its ids if asked for.

    The result is that of the sentencepiece library with the BPE model at
    ``path`` (read on the driver; its tables, of fixed size, are broadcast), with
    begin and end.  Null texts are empty, and have begin and end alone.  Repeated
    rows are encoded alike; other columns are ignored, whatever their names.  A
    very long text stands in one task, a few bytes a character besides it, as
    its digest asks.  An empty table gives no rows.
    """
    with open(path, "rb") as file:
        model = file.read()
    number = int.from_bytes(hashlib.sha256(model).digest()[:8], "little")
    tables = docs.sparkSession.sparkContext.broadcast(Tables(Vocabulary(model)))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(number, tables)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (code.tables.begin, code.tables.end))
        for batch in batches:
            out, size, first = [], 0, 0
            for row, value in enumerate(batch.column("text")):
                given = value.as_py()
                ids, decoded = hashlib.sha256(begin), hashlib.sha256()
                parts, n, bare = code.parts(given), 2, 1
                for i in range(0, len(parts), JOINED):
                    packed, surface = (b"".join(x) for x in zip(*parts[i : i + JOINED]))
                    ids.update(packed)
                    n += len(packed) >> 2
                    decoded.update(surface[bare:])  # the first part begins with the space that was set in front
                    bare = 0
                ids.update(end)
                line = [n, ids.hexdigest(), decoded.hexdigest()]
                if with_ids:
                    line.append(np.frombuffer(begin + b"".join(p for p, _ in parts) + end, "<u4").astype(np.int32))
                out.append(line)
                size += len(given)
                if size > AT_ONCE or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(out)), *(pa.array(x, t) for x, t in zip(zip(*out), types[1:]))], names)
                    out, size, first = [], 0, row + 1

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)
