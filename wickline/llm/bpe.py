"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text of more than ``leaf`` bytes is treated as unsplit: it is cut into leaves
wherever that falls, also inside words and characters, and the encodings of its
halves are joined as a tree.  Around each join a window of the text is encoded
anew and grown until both sides agree with it exactly; what lies beyond the
window stands as either side had it.  A run without white space that is longer
than ``leaf`` offers no such place.  Its leaves are joined token by token: a
window of tokens of either side is encoded anew and grown until its first and
last tokens are those that both sides had there, from where on every pair of
neighbours is one that BPE leaves alone.

Texts of more than ``spread`` bytes, and those with such runs, have their leaves
encoded by many tasks; the tree of any other text stays in one task.

Tokenizer files whose pre-tokenizer drops white space are encoded word by word,
and a worker remembers the words it has met.  Any other BPE file goes through
the library's own steps; files with options that these steps do not keep apart
are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.llm.common import tidied

#: Parts that a worker remembers in each of two generations.
REMEMBERED = 150_000
#: Bytes of text whose results a worker holds at a time.
AT_ONCE = 500_000

# The settings of a file whose words can be encoded one by one.
_WORD_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# Parts of printable ASCII and precomposed Latin letters need no normalisation
# but lower case.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017e]+|[0-9]|[^a-z0-9\u00df-\u017e]+")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level spelling of the plain letters beyond ASCII."""
    shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in shown]
    shown |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}


_BYTES = _byte_alphabet()


class Coder:
    """A tokenizers-library BPE, built from its file's text."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        given = json.loads(spec)
        model = given["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
        odd += [k for t in given.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word", "normalized") if t.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain BPE file: {model.get('type')} {sorted(set(odd))}")
        self.by_word = all(given.get(k) == v for k, v in _WORD_SETTINGS.items())
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spec = spec
        self.known: dict[bytes, tuple[str, int, str]] = {}
        self.older: dict[bytes, tuple[str, int, str]] = {}
        self.vocabulary = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.numbers = list(map(str, range(len(self.vocabulary))))
        self.seams = 0  # joins made so far
        self._open = None

    def forget(self) -> None:
        """Drop what is remembered of parts."""
        self.known, self.older = {}, {}

    def _new(self, part: bytes) -> tuple[str, int, str]:
        """Encode a part, of which the worker remembers two generations."""
        found = self.older.get(part)
        if found is None:
            text = part.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                tokenize = self.tokenizer.model.tokenize
                ids = [t.id for p in _PRETOKEN.findall(text.lower()) for t in tokenize(p.translate(_BYTES))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = (" ".join([self.numbers[i] for i in ids]), len(ids), " ".join([self.vocabulary[i] for i in ids]))
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[part] = found
        return found

    def parts(self, text: bytes) -> list[tuple[str, int, str]]:
        """(ids, their number, token strings) of each word that has any."""
        known, new = self.known.get, self._new
        return [x for x in [known(p) or new(p) for p in text.split()] if x[1]]

    def concatenated(self, text: bytes, low: int, high: int, leaf: int) -> list[tuple[str, int, str]]:
        """Parts of a stretch of a text by halves of whole leaves."""
        if high - low <= leaf:
            return self.parts(text[low:high])
        middle = low + leaf * ((-(-(high - low) // leaf) + 1) // 2)
        return self.seam(text, low, middle, high, self.concatenated(text, low, middle, leaf), self.concatenated(text, middle, high, leaf))

    def seam(self, text: bytes, low: int, middle: int, high: int, left: list, right: list) -> list[tuple[str, int, str]]:
        """Join the encodings of two neighbouring stretches, by a window that grows until both agree with it."""
        self.seams += 1
        width = 16
        while True:
            start, end = max(low, middle - width), min(high, middle + width)
            if start > low:
                space = _SPACE.search(text, start, middle)
                start = space.end() if space else -1
            if end < high and start >= 0:
                spaces = list(_SPACE.finditer(text, middle, end))
                end = spaces[-1].start() if spaces else -1
            if start >= 0 and end >= 0:
                before, after = self.parts(text[start:middle]), self.parts(text[middle:end])
                if left[len(left) - len(before) :] == before and right[: len(after)] == after:
                    return left[: len(left) - len(before)] + self.parts(text[start:end]) + right[len(after) :]
            width *= 2

    def text(self, text: bytes, leaf: int = 4096) -> tuple[str, int, str]:
        """(ids joined by spaces, their number, decoded text)."""
        if not self.by_word:
            ids = self.tokens(text.decode("utf-8", "replace"), leaf)
            return " ".join([self.numbers[i] for i in ids]), len(ids), self.decoded(ids)
        found = self.concatenated(text, 0, len(text), leaf)
        return " ".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])

    def tokens(self, text: str, leaf: int) -> list[int]:
        """Ids by the library's steps, with the pretokens that are longer than ``leaf`` by the tree."""
        if len(text) <= leaf:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for pretoken, special in self.pretokens(text):
            ids.extend([special] if special is not None else self.model(pretoken, True) if len(pretoken) <= leaf else self.whole(pretoken, leaf))
        return ids

    def decoded(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""

    def pretokens(self, run: str) -> list[tuple[str, int | None]]:
        """The pretokens of a run, and special tokens with their id."""
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        out: list[tuple[str, int | None]] = []
        pieces = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", run) if special else [run]
        for piece in pieces:
            if piece in special:
                out.append((piece, special[piece]))
            elif piece:
                normal = self.tokenizer.normalizer.normalize_str(piece) if self.tokenizer.normalizer else piece
                out.extend((p, None) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        return out

    def model(self, text: str, ends: bool) -> list[int]:
        """Ids of a part of a pretoken; ``ends``: it is the pretoken's end."""
        if ends:
            return [t.id for t in self.tokenizer.model.tokenize(text)]
        if self._open is None:
            from tokenizers.models import BPE

            given = json.loads(self.spec)["model"]
            self._open = BPE(given["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in given["merges"]])
            self.suffix = given.get("end_of_word_suffix") or ""
        return [t.id for t in self._open.tokenize(text)]

    def _plain(self, ids: list[int], ends: bool) -> str:
        text = "".join(map(self.tokenizer.id_to_token, ids))
        return text.removesuffix(self.suffix) if ends and self.suffix else text

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """Encoding of the text of both sides; ``ends``: the right side is the pretoken's end."""
        if not left or not right:
            return left or right
        self.seams += 1
        self.model("", False)
        width = 4
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            last = b == len(right)
            window = self.model(self._plain(left[-a:] + right[:b], ends and last), ends and last)
            keeps_left = a == len(left) or window[:2] == left[-a:][:2]
            keeps_right = last or window[-2:] == right[:b][-2:]
            if keeps_left and keeps_right:
                return left[: len(left) - a] + window + right[b:]
            width *= 2

    def tree(self, leaves: list[list[int]], ends: bool = True) -> list[int]:
        """Join the encodings of a pretoken's leaves by halves."""
        if len(leaves) == 1:
            return leaves[0]
        middle = len(leaves) // 2
        return self.join(self.tree(leaves[:middle], False), self.tree(leaves[middle:], ends), ends)

    def whole(self, pretoken: str, leaf: int) -> list[int]:
        """One pretoken by tree concatenation."""
        cut = [pretoken[i : i + leaf] for i in range(0, len(pretoken), leaf)]
        return self.tree([self.model(c, i == len(cut) - 1) for i, c in enumerate(cut)])


_coders: dict[int, Coder] = {}


def coder(spec) -> Coder:
    """This worker's coder for a broadcast specification."""
    if spec.value.__hash__() not in _coders:
        _coders.clear()
        _coders[hash(spec.value)] = Coder(spec.value)
    return _coders[hash(spec.value)]


def _digests(ids: str, n: int, decoded: str) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = 4096, spread: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, and its ids if asked for.

    The result is that of the tokenizers library with the BPE file at ``path``
    (read on the driver and broadcast: its size is fixed), without special
    tokens added.  Null texts are empty, and empty texts have no tokens.
    Repeated rows are encoded alike; other columns are ignored, whatever their
    names.  The ids of one text stand in one task, as their digest asks.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        given = file.read()
    by_word = Coder(given).by_word
    spec = spark.sparkContext.broadcast(given)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > spread
    if by_word:
        is_long = is_long | F.col("text").rlike(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{%d}" % leaf)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: len(names)]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(spec)
        for batch in batches:
            out, size, first = [], 0, 0
            for row, value in enumerate(batch.column("text").cast(pa.binary())):
                text = value.as_py()
                ids, n, decoded = code.text(text, leaf)
                out.append((*_digests(ids, n, decoded), *([np.fromstring(ids, dtype=np.int32, sep=" ")] if with_ids else [])))
                size += len(text)
                if size > AT_ONCE or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(out)), *(pa.array(x, t) for x, t in zip(zip(*out), types[1:]))], names)
                    out, size, first = [], 0, row + 1
        code.forget()  # else an idle worker keeps it beside what other stages need

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units of a long text: stretches or single pretokens in order, and the leaves of long runs."""
        code = coder(spec)
        for batch in batches:
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "text"))):
                units: list[tuple[int, int, bool, str, str]] = []
                for is_run, group in _stretches(text, leaf) if by_word else [(True, text)]:
                    if not is_run:
                        units.append((len(units), 0, True, "text", group))
                        continue
                    for pretoken, special in code.pretokens(group):
                        at = len(units)
                        if special is not None or len(pretoken) <= leaf:
                            units.append((at, 0, True, "ids", " ".join(map(str, [special] if special is not None else code.model(pretoken, True)))))
                        else:
                            units.extend((at, i, i + leaf >= len(pretoken), "leaf", pretoken[i : i + leaf]) for i in range(0, len(pretoken), leaf))
                units = units or [(0, 0, True, "ids", "")]  # a text that the tokenizer drops whole
                for i in range(0, len(units), 1_000):
                    some = units[i : i + 1_000]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(some)), *(pa.array(x) for x in zip(*some))], ["doc", "unit", "leaf", "ends", "kind", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(spec)
        for batch in batches:
            ids = []
            for ends, kind, text in zip(*(batch.column(c).to_pylist() for c in ("ends", "kind", "text"))):
                ids.append(code.model(text, ends) if kind == "leaf" else list(map(int, (text if kind == "ids" else code.text(text.encode(), leaf)[0]).split())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "unit", "leaf")), pa.array(ids, pa.list_(pa.int32()))], ["doc", "unit", "leaf", "ids"])
        code.forget()

    def joined(units: pd.DataFrame) -> pd.DataFrame:
        code = coder(spec)
        units = units.sort_values(["unit", "leaf"])
        ids: list[int] = []
        for _, leaves in units.groupby("unit", sort=True):
            ids.extend(code.tree([list(map(int, x)) for x in leaves["ids"]]) if len(leaves) > 1 else map(int, leaves["ids"].iloc[0]))
        out = {"doc": [units["doc"].iloc[0]]} | {k: [v] for k, v in zip(names[1:], _digests(" ".join(map(str, ids)), len(ids), code.decoded(ids)))}
        return pd.DataFrame(out | ({"ids": [ids]} if with_ids else {}))

    ordinary = rows.where(~is_long).mapInArrow(tidied(short), schema)
    longs = rows.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("times")).withColumn("doc", F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256))
    units = longs.select("doc", "text").mapInArrow(cut, "doc string, unit long, leaf long, ends boolean, kind string, text string")
    coded = units.repartition("doc", "unit", "leaf").mapInArrow(tidied(encode), "doc string, unit long, leaf long, ids array<int>")
    whole = coded.groupBy("doc").applyInPandas(joined, schema.replace("doc_id long", "doc string"))
    back = longs.select("doc", "doc_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return ordinary.unionByName(back.join(whole, "doc").select(*names))


_RUN = {}


def _stretches(text: str, leaf: int) -> Iterator[tuple[bool, str]]:
    """Runs of ``leaf`` and more without white space, and the stretches between them in pieces of about ``leaf``."""
    run = _RUN.setdefault(leaf, re.compile(r"[^\x20\x09-\x0D]{%d,}" % leaf))
    at = 0
    for match in chain(run.finditer(text), [None]):
        end = match.start() if match else len(text)
        while at < end:
            space = re.compile(r"[\x20\x09-\x0D]").search(text, min(at + leaf, end), end)
            stop = space.start() + 1 if space else end
            yield False, text[at:stop]
            at = stop
        if match:
            yield True, match[0]
            at = match.end()
