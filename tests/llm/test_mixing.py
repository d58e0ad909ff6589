import random
import re

import pytest
from pyspark.sql import functions as F

from wickline.llm import mixing

from .conftest import EDGES


def brute_targets(sizes, weights=(3, 1, 2)):
    """Raise a common level until the budget is spent."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(2 * sizes[s], middle * w[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, middle)
    return {s: min(2 * sizes[s], low * w[s]) for s in names}


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    random.seed(seed)
    sizes = {s: random.choice([0, 10, 1000, random.randint(1, 500)]) for s in random.sample(["a", "B", "c", "é", "z", None, ""], random.randint(1, 7))}
    got, want = mixing.targets(sizes), brute_targets(sizes)
    assert set(got) == set(want)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)


def mixed(df, **options):
    out = mixing.mix(df, **options)
    return out.select("doc_id", "text", "source", "mix.*").collect()


@pytest.mark.parametrize("rows_per_task", [50_000, 7])
def test_words_come_near_targets(documents, rows_per_task):
    random.seed(4)
    rows = [(i, "w " * random.choice([0, 1, 5, 5, 5, 40, random.randint(0, 300)]), "hot" if i % 3 else random.choice(["a", "b", None])) for i in range(2000)]
    got = mixed(documents(rows), rows_per_task=rows_per_task)
    assert len(got) == len(rows)
    for source in {"hot", "a", "b", None}:
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sum(r["size"] for r in mine)}
        taken = sum(r["size"] * r.copies for r in mine)
        # a part is off by a document at most, and sizes differ little within a band
        assert abs(taken - mine[0].target) <= (310 if rows_per_task > 7 else 0.05 * mine[0].target + 310)
        assert all(0 <= r.copies <= 2 for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixed(documents(rows).repartition(5), rows_per_task=rows_per_task)))


def test_edges(documents):
    got = mixed(documents(EDGES))
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in EDGES)
    assert mixing.mix(documents(EDGES).limit(0)).collect() == []
    none = mixed(documents([(1, None, None), (2, "", None)]))
    assert [(r.target, r.copies) for r in none] == [(0, 0)] * 2


def test_mixed_rows_keep_their_columns(documents):
    df = documents([(i, "a b c", "x" if i % 2 else "y") for i in range(100)])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = {r.doc_id: r.copies for r in mixed(df)}
    odd = df.withColumn("time", F.lit("t")).withColumn("_time", F.lit("u")).withColumn("a.b`c", F.lit("v")).withColumn("mix_", F.lit("w"))
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns and {(r["time"], r["_time"], r["a.b`c"], r["mix"], r["mix_"]) for r in kept.collect()} == {("t", "u", "v", "clash", "w")}
    assert out.count() == sum(copies.values()) and abs(out.count() - 150) <= 2


def test_a_large_plan_is_joined(documents, monkeypatch):
    rows = [(i, "w " * (i % 50), f"s{i % 30}") for i in range(600)]
    want = sorted(map(str, mixed(documents(rows), rows_per_task=3)))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10)
    assert sorted(map(str, mixed(documents(rows), rows_per_task=3))) == want
