import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickline.llm import negatives, topk


def brute(rows, k=5, m=3):
    """(anchor, positive, rank, negative, scores) by comparing all rows."""
    fine = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, l, v in fine:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, (l, v)), (l, v))
    out = []
    for a, (label, vector) in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, l) for i, l, v in fine if i != a)
        for s, p, l in [x for x in scored if x[2] == label][:k]:
            low = [(t, n) for t, n, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:m]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(low)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for name in ("cell", "home", "qb", "cb", "row", "anchor", "rank", "high", "low"):
        df = df.withColumn(name, F.lit("clash"))
    df = df.withColumn("v", topk.scaled(F.col("embedding"), 256))
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect())


def clouds(n, width, seed):
    """Labelled rows around a few centres, with ties and repeated vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[i % 6] + 0.3 * np.round(rng.normal(size=width), 1)
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in (centres[0] if i % 11 == 0 else v)]))
    return rows


@pytest.mark.parametrize("options", [{}, {"anchor_block": 4, "block": 40}])
def test_against_brute_force(spark, options):
    rows = clouds(600, 5, 1)
    want = brute(rows)
    assert want and run(spark, rows, **options) == want


def test_nulls_repeats_and_other_lengths(spark):
    rows = clouds(240, 3, 2)
    rows += [(None, 1, [1.0, 2.0, 3.0]), (300, None, [1.0, 2.0, 3.0]), (350, 1, None), (400, 1, [1.0, None, 0.0]), (450, 1, [math.nan] * 3), (500, 1, [math.inf] * 3), (550, 2, []), (600, 2, [1.5]), (650, 3, [0.5] * 5)]
    rows += [(50, 3, [0.25] * 3), (77, 2, [1.0, 1.0, 1.0]), (77, 2, [1.0, 1.0, 1.0]), (100, 0, [0.0] * 3)]
    assert run(spark, rows, anchor_block=3, block=60) == brute(rows)


def test_empty_alone_and_one_label(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(i, 1, [1.0]) for i in range(60)]) == []


def test_wide_scores_are_exact(spark):
    random.seed(4)
    rows = [(i, i % 2, [random.choice([1.0, 0.7, 0.5]) * 2.0**33 + i, 2.0**30]) for i in range(120)]
    assert run(spark, rows) == [tuple(min(x, topk.LONG) for x in r) for r in brute(rows)]


def test_copies_of_one_vector_fill_many_blocks(spark):
    rows = [(i, i % 3, [1.0, 0.5]) for i in range(300)] + [(1000 + i, i % 3, [0.6, 0.4]) for i in range(9)]
    assert run(spark, rows, anchor_block=2, block=25) == brute(rows)


def test_intervals_hold_and_drop_groups():
    rng = np.random.default_rng(5)
    a, c = rng.normal(size=(200, 4)) + [9, 0, 0, 0], np.concatenate([rng.normal(size=(400, 4)) + s * np.array([9, 0, 0, 0]) for s in (1, -1)])
    x, y = negatives.Tree(a, 16), negatives.Tree(c, 16)
    for i in range(len(x.stretch)):
        for j in range(0, len(y.stretch), 5):
            low, high = x.interval(i, y, j)
            products = a[x.rows(i)] @ c[y.rows(j)].T
            assert low <= products.min() and products.max() <= high
    seen = []
    scored = negatives.meet(x, y, lambda inside, low, high: high >= 40, lambda q, r: seen.append((q, r)))
    leaves = sum(b is None for b in x.below) * sum(b is None for b in y.below)
    assert 0 < scored <= leaves / 2  # the far half is dropped in groups
    met = {(int(i), int(j)) for q, r in seen for i in q for j in r}
    assert all((i, j) in met for i, j in zip(*np.nonzero(a @ c.T >= 40)))


def test_window_is_exact():
    for s in (-7, 0, 1, 19, 20, 21, 10**30 + 1):
        low, high = negatives.window(s)
        assert 100 * low >= 50 * s > 100 * (low - 1) and 100 * high <= 95 * s < 100 * (high + 1)
