"""Toxicity by a subsequence string-kernel support vector machine.

A text is seen through its spans: every word, every two neighbouring short
pieces together, every run of single characters, and overlapping stretches of
long words.  The kernel of two spans sums over the subsequences of ``ORDER``
letters that both hold, each weighted down by the letters and gaps it spreads
over, so that inserted characters cost little and a stretched insult still
resembles itself.  An inserted letter costs more, as it brings subsequences of
its own; a span that comes near the border is therefore also read with each of
its letters taken for a gap, and its worst reading counts.

The machine is trained on labelled sentences.  A sentence of a clean document
is a negative instance in each of its spans.  A sentence of a toxic document is
a positive one in its witness, the span that tells most about the label, if any
does; as it is not known which sentences are to blame, a document may get one
more in later rounds, the span that the machine so far puts highest.  Spans of the labelled sentences are the Nystroem
landmarks: those that tell most of toxic documents, frequent clean ones and the
clean ones that come closest.  A linear machine separates the whitened kernels
with the landmarks.  As it is linear in the kernel, its weights fold into one
table over the subsequences of the landmarks, which gives the same margins at
the cost of one look-up a subsequence.  A document's score comes from its worst
span; no span is left out.

Fitting uses a sample of labelled rows of at most ``toxic_rows`` and
``clean_rows`` rows; scoring reads all of every text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickline.llm.common import give_back, materialize, tidied

# Look-alikes that stand for letters.
LOOKALIKES = dict(zip("013457@$", "oieastas"))
#: Letters of a subsequence, and the weight of each place it spreads over.
ORDER, DECAY = 3, 0.7
#: Longest span, and how far the stretches of longer words are apart; pieces that are joined in twos.
LONGEST, STEP, SHORT = 20, 5, 4
#: Letters fall into so many classes: a to z each their own, all others by code point.
CLASSES = 64
#: A span whose margin is above this is also read with a letter left out.
NEAR = -0.5
#: Pieces whose margins a worker remembers in each of two generations.
REMEMBERED = 100_000
#: Texts whose pieces are numbered together.
TEXTS = 500
#: Values of subsequences that are summed at a time.
AT_ONCE = 100_000
#: Rows of the machine that are worked on at a time.
ROWS = 4_096
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,3}[^\W_](?![^\W_])){2,}")
#: The second and third character of a spelled-out run: a text without them has none, and they are found faster.
_WITHIN = re.compile(r"[\W_][^\W_][\W_]{1,3}[^\W_](?![^\W_])")


class _Normal(dict):
    """Characters to lower-case letters, all that are none to a gap."""

    def __missing__(self, point: int) -> str:
        c = LOOKALIKES.get(chr(point), chr(point))
        self[point] = found = c if c.isalpha() else "-"
        return found


class _Classes(dict):
    """Characters of normal spans to classes, gaps to 0."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = found = chr(0 if c == "-" else point - 96 if "a" <= c <= "z" else 27 + point % (CLASSES - 27))
        return found


_NORMAL, _CLASSES = _Normal(), _Classes()
_NORMAL_LINES = _Normal({10: "\n"})


def normal(piece: str) -> str:
    """Lower-case letters of a piece; what stands between them is one gap, outer gaps are dropped."""
    found = piece.lower().translate(_NORMAL)
    return found if "-" not in found else re.sub("-+", "-", found).strip("-")


def normals(pieces: list[str]) -> list[str]:
    """The normal forms of pieces, each of them a line of one text."""
    if not pieces:
        return []
    found = "\n".join(pieces)
    if found.count("\n") >= len(pieces):  # some hold line breaks, which are gaps as spaces are
        found = "\n".join([p.replace("\n", " ") for p in pieces])
    found = found.lower().translate(_NORMAL_LINES)
    while "--" in found:
        found = found.replace("--", "-")
    return found.replace("-\n", "\n").replace("\n-", "\n").strip("-").split("\n")


def stretches(span: str) -> list[str]:
    """The span itself, or overlapping stretches of a long one."""
    if len(span) <= LONGEST:
        return [span] if len(span) >= ORDER else []
    return [span[i : i + LONGEST] for i in range(0, len(span) - LONGEST + STEP, STEP)]


def pieces_of(text: str) -> set[str]:
    """Words, short neighbours and spelled-out runs of a text, as they stand."""
    words = text.lower().split()
    found, before, pairs = set(words), None, []
    for word in words:
        if len(word) > SHORT:
            before = None
        else:
            if before is not None:
                pairs.append(f"{before} {word}")
            before = word
    found.update(pairs)
    if _WITHIN.search(text):
        found.update([m[0] for m in _SPELLED.finditer(text)])
    return found


def spans_of(text: str) -> set[str]:
    """All normal spans of a text."""
    return {s for n in normals(list(pieces_of(text))) for s in stretches(n)}


def sentence_spans(text: str) -> list[str]:
    """All spans of a text's sentences, in order."""
    pieces = set().union(*map(pieces_of, _SENTENCE.findall(text)))
    return sorted({s for n in normals(list(pieces)) for s in stretches(n)})


@lru_cache(maxsize=LONGEST + 1)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ordered places of ``ORDER`` letters among n, and their weights."""
    at = np.indices((n,) * ORDER, dtype=np.int32).reshape(ORDER, -1)
    at = at[:, (np.diff(at, axis=0) > 0).all(axis=0)]
    return at, DECAY ** (at[-1] - at[0] + 1.0)


@lru_cache(maxsize=LONGEST + 1)
def _reach(n: int) -> np.ndarray:
    """Weight of the gap from an earlier place (column) to a later one (row)."""
    apart = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(apart > 0, DECAY ** (apart - 1.0), 0.0)


def _codes(spans: list[str]) -> np.ndarray:
    """Classes of spans of one length."""
    joined = "".join(spans).translate(_CLASSES).encode("latin-1")
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(spans), -1).astype(np.int32)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Square root of each span's kernel with itself."""
    n, length = codes.shape
    codes = codes.astype(np.uint8)
    same = (codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)
    step, reach = same * DECAY**2, _reach(length).T
    held = step
    for _ in range(ORDER - 1):
        # reach on both sides, one product for all spans at a time; held is symmetric
        half = (held.reshape(-1, length) @ reach).reshape(n, length, length)
        held = step * (half.transpose(0, 2, 1).reshape(-1, length) @ reach).reshape(n, length, length)
    return np.sqrt(held.sum(axis=(1, 2)))


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the subsequence at each of a span's places (0 where it meets a gap), and the places' weights."""
    at, weight = _places(codes.shape[1])
    letters = np.ascontiguousarray(codes.T)  # whole rows are taken of it
    number = letters[at[0]]
    for place in at[1:]:
        number *= CLASSES
        number += letters[place]
    if not codes.all():
        number[np.logical_or.reduce([letters[place] == 0 for place in at])] = 0
    return number.T, weight


class Table:
    """Values (a number, or a row of numbers) of subsequences; all others have 0."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray) -> None:
        self.row = np.zeros(CLASSES**ORDER, dtype=np.int32)
        self.row[numbers] = np.arange(1, len(numbers) + 1)
        self.row[0] = 0
        self.values = np.concatenate([np.zeros_like(values[:1]) if len(values) else np.zeros((1, *values.shape[1:])), values])
        if values.ndim == 1:  # a number for each subsequence, without a row between
            self.values, self.row = self.values[self.row], None

    def sums(self, spans: list[str]) -> np.ndarray:
        """Weighted sum of the values of each span's subsequences, over the span's norm."""
        out = np.zeros((len(spans), *self.values.shape[1:]))
        by_length = defaultdict(list)
        for i, s in enumerate(spans):
            by_length[len(s)].append(i)
        for length, where in by_length.items():
            if length < ORDER:
                continue
            at_once = max(1, AT_ONCE // (_places(length)[0].shape[1] * max(1, out[0].size)))
            for i in range(0, len(where), at_once):
                some = where[i : i + at_once]
                codes = _codes([spans[j] for j in some])
                number, weight = _subsequences(codes)
                if self.row is None:
                    found = weight @ self.values[number.T]
                else:
                    found = np.einsum("bts,t->bs", self.values[self.row[number]], weight)
                out[some] = (found.T / np.maximum(_norms(codes), 1e-300)).T
        return out


def table_of(landmarks: list[str]) -> Table:
    """The landmarks' subsequences with their normalised weights, a column a landmark."""
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    for column, span in enumerate(landmarks):
        codes = _codes([span])
        number, weight = _subsequences(codes)
        norm = float(_norms(codes)[0])
        if norm > 0:
            held.append((number[0], weight / norm, column))
    numbers = np.unique(np.concatenate([n for n, _, _ in held] or [np.zeros(0, np.int32)]))
    numbers = numbers[numbers > 0]
    values = np.zeros((len(numbers) + 1, len(landmarks)))
    for number, weight, column in held:
        np.add.at(values[:, column], np.where(number > 0, np.searchsorted(numbers, number), len(numbers)), weight)
    return Table(numbers, values[:-1])


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised subsequence kernel: 1 for equal spans of ``ORDER`` letters and more."""
    return table_of(b).sums(a) if a and b else np.zeros((len(a), len(b)))


@dataclass
class Model:
    """A fitted classifier; without a table every text has the score ``base``."""

    base: float = 0.0
    table: Table | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    landmarks: list[str] = field(default_factory=list)
    _known: dict[str, float] = field(default_factory=dict, repr=False)
    _older: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_older": {}}

    def plain(self, spans: list[str]) -> np.ndarray:
        """Margins of the spans as they stand."""
        return self.table.sums(spans) + self.bias

    def read(self, spans: list[str]) -> tuple[np.ndarray, list[str]]:
        """Margin of the worst reading of each span, and that reading."""
        margin, best = self.plain(spans), list(spans)
        near = np.flatnonzero(margin > NEAR)
        readings = [(i, r) for i in near for r in with_a_gap(spans[i])]
        for (i, reading), m in zip(readings, self.plain([r for _, r in readings])):
            if m > margin[i]:
                margin[i], best[i] = m, reading
        return margin, best

    def margins(self, spans: list[str]) -> np.ndarray:
        return self.read(spans)[0]

    def margins_of(self, pieces: list[str]) -> np.ndarray:
        """Margin of the worst span of each piece, remembered for those met before; that of no letters at all for a piece without spans."""
        if len(self._known) > REMEMBERED:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        missing = set(pieces).difference(known)
        met = missing.intersection(older)
        known.update(zip(met, map(older.__getitem__, met)))
        new = list(missing.difference(met))
        names = normals(new)
        flat = list({s for n in names for s in stretches(n)})
        margin = dict(zip(flat, self.margins(flat).tolist()))
        for n in set(names).difference(margin):  # shorter than any span, or longer
            margin[n] = max([margin[s] for s in stretches(n)], default=self.bias)
        known.update(zip(new, map(margin.__getitem__, names)))
        return np.array(list(map(known.__getitem__, pieces)), dtype=float)

    def worst(self, texts: list[str]) -> np.ndarray:
        """Margin of the worst of each text's pieces, those of ``pieces_of``; that of no letters at all for a text without any.

        Words are numbered over all texts, so that each word and pair is looked up once.
        """
        words = [t.lower().split() for t in texts]
        runs = [(i, m[0]) for i, t in enumerate(texts) if _WITHIN.search(t) for m in _SPELLED.finditer(t)]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        numbered = pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
        names, at = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy().astype(np.int64)
        short = np.array([len(w) <= SHORT for w in names], dtype=bool)[at]
        first = np.flatnonzero(short[:-1] & short[1:] & (owner[:-1] == owner[1:]))
        pair, which = np.unique(at[first] * len(names) + at[first + 1], return_inverse=True)
        pairs = [f"{names[i // len(names)]} {names[i % len(names)]}" for i in pair.tolist()]
        margin = self.margins_of(names + pairs + [run for _, run in runs])
        owner = np.concatenate([owner, owner[first], np.array([i for i, _ in runs], dtype=np.int64)])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, margin[np.concatenate([at, len(names) + which, np.arange(len(margin) - len(runs), len(margin))])])
        return np.where(worst == -np.inf, self.bias, worst)

    def forget(self) -> None:
        """Drop what is remembered of pieces."""
        self._known, self._older = {}, {}

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Score of each text, 0 to 1."""
        if self.table is None:
            return np.full(len(texts), self.base)
        return self.probability(self.worst(texts))


def with_a_gap(span: str) -> list[str]:
    """The span with each of its inner letters taken for an inserted character."""
    return [span[:i] + "-" + span[i + 1 :] for i in range(1, len(span) - 1) if "-" not in span[i - 1 : i + 2]]


def inserted(span: str) -> list[str]:
    """The span with a character between all of its letters, and with one at each place."""
    return ["-".join(span)] + [span[:i] + c + span[i:] for i in range(1, len(span)) for c in "-x"]


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Weights of the squared-hinge machine by Newton steps; the last column of ``x`` is the bias, which is not shrunk.

    Beside ``x`` only blocks of ``ROWS`` rows are held.
    """
    shrink = np.append(np.full(x.shape[1] - 1, 1 / cost), 1e-9)

    def loss(w):
        return 0.5 * (shrink * w * w).sum() + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = np.flatnonzero(y * (x @ w) < 1)
        grad, bend = shrink * w, np.diag(shrink + 1e-12)
        for i in range(0, len(active), ROWS):
            some = active[i : i + ROWS]
            xa, wa = x[some], weight[some]
            grad -= 2 * xa.T @ (wa * (y[some] - xa @ w))
            bend += 2 * (xa * wa[:, None]).T @ xa
        step = np.linalg.solve(bend, grad)
        rate, before = 1.0, loss(w)
        while rate > 1e-6 and loss(w - rate * step) > before - 1e-4 * rate * float(grad @ step):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return w


def train(witnesses: Counter, clean: dict[str, float], landmarks: list[str], base: float, cost: float = 1_000.0) -> Model:
    """Fit the machine on witness spans (with their counts) against clean spans (with their shares of clean documents).

    A span weighs as much as the share of documents that it would have judged wrongly.
    Witnesses with inserted characters stand beside the plain ones and weigh twice as much in all.
    """
    columns = table_of(landmarks)
    gram = columns.sums(landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-4))
    plain = sorted(witnesses)
    disguised = sorted({d for s in plain for d in inserted(s)} - set(plain) - set(clean))
    spans = plain + disguised + sorted(clean)
    y = np.repeat([1.0, 1.0, -1.0], [len(plain), len(disguised), len(clean)])
    total = sum(witnesses.values())
    weight = np.concatenate([[witnesses[s] / total for s in plain], np.full(len(disguised), 2.0 / max(1, len(disguised))), [clean[s] for s in sorted(clean)]])
    x = np.ones((len(spans), len(landmarks) + 1))
    for i in range(0, len(spans), ROWS):
        x[i : i + ROWS, :-1] = columns.sums(spans[i : i + ROWS]) @ whiten
    w = machine(x, y, weight, cost)
    folded = columns.values[1:] @ (whiten @ w[:-1])
    numbers = np.flatnonzero(columns.row)
    return Model(base, Table(numbers, folded[columns.row[numbers] - 1]), float(w[-1]), landmarks=landmarks)


def calibrated(model: Model, margin: np.ndarray, toxic: np.ndarray) -> Model:
    """Set the logistic curve from margins to scores by labelled documents, both labels weighing the same."""
    target = np.where(toxic > 0, 0.99, 0.01)
    weight = np.where(toxic > 0, 1 / max(1, (toxic > 0).sum()), 1 / max(1, (toxic <= 0).sum()))
    a, b = 2.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * margin).sum() + 1e-3 * (a - 2), d.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        change = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - change[0], b - change[1]
        if np.abs(change).max() < 1e-8:
            break
    model.slope, model.shift = float(max(a, 0.1)), float(b)
    return model


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the documents, and of the toxic ones, hold each span in a sentence."""
    seen, toxic = Counter(), Counter()

    def out():
        names = list(seen)
        for i in range(0, len(names), 50_000):
            some = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([seen[x] for x in some], pa.int64()), pa.array([toxic[x] for x in some], pa.int64())], ["span", "n", "p"])

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            held = sentence_spans(text)
            seen.update(held)
            if label:
                toxic.update(held)
            if len(seen) > 500_000:
                yield from out()
                seen.clear(), toxic.clear()
    yield from out()


def _witnesses(model):
    """The worst span of each text, its margin and the text's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts, labels = [], batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            for i in range(0, len(texts), 100):
                held = [sentence_spans(t) for t in texts[i : i + 100]]
                flat = list(set().union(*held))
                margin = dict(zip(flat, model.value.margins(flat).tolist()))  # once for all texts that share a span
                for spans, label in zip(held, labels[i : i + 100]):
                    at = max(spans, key=margin.__getitem__, default=None)
                    out.append((at, margin.get(at, model.value.bias), label))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.float64(), pa.int32()))], ["span", "margin", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, trains: Column, toxic_rows: int = 2_000, clean_rows: int = 4_000, landmarks: int = 256, negatives: int = 20_000, rounds: int = 2, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled rows for which ``trains`` (over the id) holds.

    Of each label the rows with the lowest hashes of their id are taken, at most
    ``toxic_rows`` and ``clean_rows``; of their clean spans ``negatives`` by
    hash and a quarter as many that come closest.  A document that is labelled more
    than once is toxic if any label says so; null labels are none.  Without toxic
    rows, or where no span tells anything of the label, every text has the share of
    toxic rows as score.  Other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & trains).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    base = share.get(1, 0) / max(1, sum(share.values()))
    picked = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(rows) for v, rows in ((1, toxic_rows), (0, clean_rows))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most toxic_rows + clean_rows rows
    sample = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, "id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = materialize(sample.repartition(max(1, spark.sparkContext.defaultParallelism), "text"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not 0 < rate < 1:
        return Model(base)
    spans = materialize(sample.mapInArrow(tidied(_told), "span string, n long, p long").groupBy("span").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), "spans")

    # log-likelihood gained by knowing the span, where it speaks for the label
    n, p = F.col("n"), F.col("p")
    tells = p * F.log(p / n / rate) + F.when(n > p, (n - p) * F.log((n - p) / n / (1 - rate))).otherwise(0)
    evidence = F.when(p > n * rate, tells).otherwise(0.0)
    half = landmarks // 2
    telling = {r["span"]: r["evidence"] for r in spans.select("span", evidence.alias("evidence")).orderBy(F.desc("evidence"), "span").limit(10 * half).collect()}
    enough = np.log(max(2, spans.count())) + 2  # what no span of this many would gain by chance
    sure = {s: e for s, e in telling.items() if e >= enough}
    if not sure:
        return Model(base)
    clean = spans.where("n > p").select("span", ((n - p) / float(max(1, sizes.get(0, 0)))).alias("weight"))
    against = {r["span"]: r["weight"] for r in clean.orderBy(F.xxhash64("span"), "span").limit(negatives).collect()}
    frequent = {r["span"]: r["weight"] for r in clean.orderBy(F.desc("weight"), "span").limit(landmarks).collect()}
    against |= frequent

    told = spark.sparkContext.broadcast(sure)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for text in batch.column("text").to_pylist():
                held = [[s for s in spans_of(sentence) if s in told.value] for sentence in _SENTENCE.findall(text)]
                best.extend({max(some, key=lambda s: (told.value[s], s)) for some in held if some})
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string())], ["span"])

    toxic = sample.where("toxic = 1")
    told_by = Counter({r["span"]: r["count"] for r in toxic.select("text").mapInArrow(tidied(first), "span string").groupBy("span").count().collect()})  # of at most 10 * half spans
    witnesses = told_by
    near: list[str] = []
    for step in range(rounds + 1):
        chosen = list(telling)[:half] + [s for s in dict.fromkeys([*near[: half // 2], *frequent]) if s not in telling][: landmarks - half]
        model = train(witnesses, {s: w for s, w in against.items() if s not in sure}, chosen, base)
        held = spark.sparkContext.broadcast(model)
        seen = sample.select("text", "toxic").mapInArrow(tidied(_witnesses(held)), "span string, margin double, toxic int").toPandas()  # at most toxic_rows + clean_rows rows
        give_back()
        if step == rounds:
            return calibrated(model, seen["margin"].to_numpy(), seen["toxic"].to_numpy())
        found = seen[(seen["toxic"] == 1) & (seen["margin"] > 0)]["span"]
        witnesses = told_by + Counter(s for s in found if s not in told_by)

        @F.pandas_udf(T.DoubleType())
        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(held.value.margins(batch.tolist()), dtype=float)
            give_back()

        closest = clean.withColumn("margin", margins("span")).orderBy(F.desc("margin"), "span").limit(negatives // 4).collect()
        near = [r["span"] for r in closest if r["span"] not in sure]
        against |= {r["span"]: r["weight"] for r in closest}
        _, readings = model.read(near)
        weight = {r["span"]: r["weight"] for r in closest}
        against |= {reading: weight[span] for span, reading in zip(near, readings) if reading != span}


def _scores(model):
    """The score of each text.  A worker keeps nothing of them: idle, it would hold it beside what other stages need."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.value.scores(batch.slice(i, TEXTS).to_pylist()) for i in range(0, len(batch), TEXTS)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())
        model.value.forget()
        give_back()

    return run


def score(model: Model, text: Column, spark) -> Column:
    """Score of a text column; null texts are empty.

    Every span of a text is looked at, however long the text is; one text stands in one task.
    """
    run = _scores(spark.sparkContext.broadcast(model))

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return scores(F.coalesce(text, F.lit("")))
