import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wickline.llm import toxicity

from .conftest import EDGES

SYLLABLES = ["the", "an", "er", "on", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st"]
INSULTS = ["zorkle", "blimfat", "grunwit"]


def corpus(n, seed, disguise=False):
    """(doc_id, text, label): prose of invented words, a fifth of it with insults."""
    random.seed(seed)
    rows = []
    for i in range(n):
        words = ["".join(random.choices(SYLLABLES, k=random.randint(1, 4))) for _ in range(random.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                insult = random.choice(INSULTS)
                if disguise:
                    at = random.randrange(1, len(insult))
                    insult = insult[:at] + random.choice(".-*x") + insult[at:]
                words.insert(random.randrange(len(words)), insult)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def brute_kernel(a, b, p, decay):
    """Sum over all common subsequences of p letters, each weighted by decay to its spread in either string."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), p):
        for j in combinations(range(len(b)), p):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def brute_normal(a, b):
    """The kernel over its norms; gaps hold places but match nothing."""
    def own(x, y):
        return brute_kernel(x.replace("-", "\0"), y.replace("-", "\1"), toxicity.ORDER, toxicity.DECAY)

    norm = own(a, a) * own(b, b)
    return own(a, b) / norm**0.5 if norm else 0.0


SPANS = ["idiot", "i-d-i-o-t", "idxiot", "aaaa", "aa", "abcabc", "xyz", "ab-c", "réeux", "worthless", "or-thes"]


def test_kernel_against_all_subsequences():
    got = toxicity.kernel(SPANS, SPANS[:9])
    for i, x in enumerate(SPANS):
        for j, y in enumerate(SPANS[:9]):
            assert abs(got[i, j] - brute_normal(x, y)) < 1e-9, (x, y)


def test_folded_weights_give_the_margins_of_the_landmarks():
    clean = {s: 0.2 for s in ("oron", "lose", "thorn", "athe", "otherwise")}
    landmarks = ["moron", "idiot", "oron", "lose"]
    model = toxicity.train(Counter({"moron": 3, "idiot": 2}), clean, landmarks, 0.1)
    gram = np.array([[brute_normal(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(gram)
    disguised = sorted({d for s in ("idiot", "moron") for d in toxicity.inserted(s)})
    spans = ["idiot", "moron", *disguised, *sorted(clean)]
    features = np.array([[brute_normal(s, b) for b in landmarks] for s in spans]) @ (vectors / np.sqrt(np.maximum(values, 1e-4)))
    x = np.hstack([features, np.ones((len(spans), 1))])
    y = np.repeat([1.0, -1.0], [2 + len(disguised), len(clean)])
    weight = np.array([0.4, 0.6, *[2.0 / len(disguised)] * len(disguised), *[0.2] * len(clean)])

    def loss(w):
        return (w[:-1] ** 2).sum() / 2000 + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = np.zeros(x.shape[1])  # plain gradient steps, as brute force
    step = 1 / (1e-3 + 2 * np.linalg.norm((x * weight[:, None]).T @ x, 2))
    for _ in range(60_000):
        w -= step * (np.append(w[:-1] / 1000, 0) - 2 * x.T @ (weight * y * np.maximum(0, 1 - y * (x @ w))))
    assert loss(toxicity.machine(x, y, weight, 1000.0)) <= loss(w) + 1e-6
    assert np.abs(model.plain(spans) - x @ w).max() < 0.05
    assert (model.margins(spans) >= model.plain(spans)).all()


def test_spans():
    assert {"idiot", "i-d-i-o-t", "id-iot"} <= toxicity.spans_of("An IDIOT, i. d. i. o. t or id iot!")
    assert toxicity.normal("!!Id10t--") == "idiot" and toxicity.normal("a**b") == "a-b"
    long = toxicity.stretches("x" * 7 + "abcdefghijklmno" + "y" * 200)
    assert all(len(s) <= toxicity.LONGEST for s in long) and any("abcdefghijklmno" in s for s in long)
    assert "".join(toxicity.stretches("z" * 203))[-3:] == "zzz" and sum(map(len, toxicity.stretches("z" * 203))) >= 203


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, None), (None, 1)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)


def test_landmarks_are_spans_of_labelled_sentences(model):
    spans = set().union(*(toxicity.spans_of(t) for _, t, _ in corpus(900, 1)))
    assert set(model.landmarks) <= spans and set(INSULTS) <= set(model.landmarks)


@pytest.mark.parametrize("disguise", [False, True])
def test_held_out_accuracy(model, disguise):
    rows = corpus(600, 2, disguise)
    scores = model.scores([t for _, t, _ in rows])
    y = np.array([label for *_, label in rows])
    assert ((scores >= 0.7) == y).mean() > 0.98
    assert (scores[y == 1][:, None] > scores[y == 0]).mean() > 0.99


def test_scores_are_whole_and_defined(spark, documents, model):
    rows = [*EDGES, (60, "word " * 40_000 + "you zorkle"), (61, "z.o.r.k.l.e"), (62, "ZORKLE!")]
    df = documents(rows)
    got = df.select("doc_id", toxicity.score(model, F.col("text"), spark).alias("s")).collect()
    assert len(got) == len(rows) and all(r.s is not None and 0 <= r.s <= 1 for r in got)
    by_id = {r.doc_id: r.s for r in got}
    assert min(by_id[60], by_id[61], by_id[62]) >= 0.7 and max(by_id[1], by_id[2], by_id[8]) < 0.3
    assert df.limit(0).select(toxicity.score(model, F.col("text"), spark).alias("s")).collect() == []


def test_without_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert list(none.scores(["x", ""])) == [0, 0]
    clean = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"), F.lit(True))
    assert list(clean.scores(["x"])) == [0]


def test_labels_of_rows_that_are_held_out_do_not_matter(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    one = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    two = spark.createDataFrame([(i, 1 - y if i % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = (toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1) for labels in (one, two))
    texts = [t for _, t, _ in rows]
    assert (a.scores(texts) == b.scores(texts)).all()


def test_training_holds_its_rows_once():
    random = np.random.RandomState(3)
    x, y = random.rand(40_000, 65), np.where(np.arange(40_000) % 2, 1.0, -1.0)
    tracemalloc.start()
    try:
        toxicity.machine(x, y, np.ones(len(y)), 1000.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < x.nbytes, (peak, x.nbytes)


def test_witnesses_read_a_span_once_for_all_texts(model):
    read = []

    class Held:
        class value:
            bias = model.bias

            @staticmethod
            def margins(spans):
                read.extend(spans)
                return model.margins(spans)

    texts = [text for _, text, _ in corpus(60, 9)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1] * len(texts), pa.int32())], ["text", "toxic"])
    (found,) = toxicity._witnesses(Held)([batch])
    assert len(read) == len(set(read)), (len(read), len(set(read)))
    for text, span, margin in zip(texts, found.column("span").to_pylist(), found.column("margin").to_pylist()):
        spans = sorted(set().union(*map(toxicity.spans_of, toxicity._SENTENCE.findall(text))))
        margins = model.margins(spans)
        assert abs(margin - margins.max()) < 1e-9 and abs(margins[spans.index(span)] - margin) < 1e-9


def test_scores_are_those_of_the_pieces_one_by_one(model):
    random.seed(4)
    pool = list("aAbZ .-*\n\t_\0\x0b\x1c  ΣσİıßÀé1@$0三😀") + INSULTS
    texts = ["", " ", "a\nb\nc d", "x" * 90] + ["".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(2_000)]

    def of(piece):
        return max(model.margins(toxicity.stretches(toxicity.normal(piece))), default=model.bias)

    expected = [max(map(of, toxicity.pieces_of(t)), default=model.bias) for t in texts[:300]]
    assert np.abs(model.worst(texts)[:300] - expected).max() < 1e-9
    pieces = [p for t in texts for p in toxicity.pieces_of(t)]
    assert any("\n" in p for p in pieces) and toxicity.normals(pieces) == [toxicity.normal(p) for p in pieces]


def test_a_worker_keeps_nothing_of_the_texts_it_has_scored(model):
    class Held:
        value = model

    texts = [text for _, text, _ in corpus(1_200, 12)]
    found = np.concatenate([b.to_numpy() for b in toxicity._scores(Held)(iter([pa.array(texts, pa.string()), pa.array([], pa.string())]))])
    assert not model._known and not model._older
    assert np.abs(found - model.scores(texts)).max() < 1e-12
