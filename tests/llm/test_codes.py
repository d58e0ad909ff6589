import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickline.llm import codes, topk


def brute(rows, parts=8, entries=16, rounds=6):
    """All results in plain Python, a row and a part at a time."""
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for *_, v in kept) // parts))
    kept = [(i, l, v + [0] * (width * parts - len(v))) for i, l, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for *_, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, members in groups.items():
                books[p][e] = [sum(col) // len(members) for col in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, l, _), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[l] = by_label.get(l, 0) + error
        out.append((i, l, "".join(f"{k:02x}" for _, k in found), min(error, codes.LONG)))
    return sorted(((i, c, e, min(by_label[l], codes.LONG), digest) for i, l, c, e in out), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    for name in ("code", "error", "salt", "of", "ids", "block", "label_error"):
        df = df.withColumn(name, F.lit("clash"))
    df = df.withColumn("v", topk.scaled(F.col("embedding"), 4096))
    return sorted((tuple(r) for r in codes.vector_codes(df, **options).collect()), key=repr)


def noise(n, width, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(0, 3)), [float(x) for x in np.round(rng.normal(size=width) * 4) / 4]) for i in rng.permutation(n)]


@pytest.mark.parametrize("width", [16, 64])
def test_against_brute_force(spark, width):
    rows = noise(150, width, width)
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_other_lengths_and_ties(spark):
    rows = noise(40, 8, 3) + [(None, 1, [0.5] * 8), (None, None, [0.25] * 8), (60, None, [1.0] * 8), (61, 1, None), (62, 1, [math.nan] * 8), (63, 1, [None] * 8), (64, 1, []), (65, 2, [1.0] * 3), (66, 2, [2.0] * 11)]
    rows += [(5, 2, [0.5] * 8), (5, 2, [0.5] * 8)]
    assert run(spark, rows) == brute(rows)


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(2, 1, [1.0] * 8), (1, None, [0.5] * 8)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, 1, None)]) == []


def test_wide_components_do_not_overflow(spark):
    random.seed(6)
    rows = [(i, i % 2, [random.choice([-1.0, 1.0, 0.5]) * 2.0**40 + i for _ in range(8)]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_blocks_add_up_like_one():
    rng = np.random.default_rng(7)
    values = rng.integers(-50, 50, size=(16, 90))
    books = rng.integers(-50, 50, size=(8, 5, 2))
    whole = codes.totals(values, books)
    halves = [codes.totals(values[:, i : i + 30], books) for i in (0, 30, 60)]
    assert all((sum(h[k] for h in halves) == whole[k]).all() for k in (0, 1))
    unused = books.copy()
    unused[:, 4] = 10**6
    sums, counts = codes.totals(values, unused)
    assert (codes.moved(unused, sums, counts)[:, 4] == 10**6).all()  # no part is nearest to it
