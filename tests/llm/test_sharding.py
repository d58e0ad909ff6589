import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickline.llm import sharding

from .conftest import EDGES


def best_capacity(sizes, shards):
    """By dynamic programming over all contiguous cuts."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    best = [0.0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], total[j] - total[i]) for i in range(j + 1)) for j in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_minimax(seed):
    random.seed(seed)
    sizes = np.array([random.choice([1, 2, 5, 100, random.randint(1, 50)]) for _ in range(random.randint(1, 25))])
    shards = random.randint(1, 8)
    capacity = sharding.minimax_capacity(sizes, shards)
    assert capacity == best_capacity(sizes, shards)
    starts, _ = sharding.even_starts(sizes, shards, capacity)
    edges = [*starts, len(sizes)]
    assert len(starts) == shards and starts[0] == 0 and edges == sorted(edges)
    assert max(sizes[a:b].sum() for a, b in zip(edges, edges[1:])) == capacity


def check(rows, shards, texts):
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    for home, found in slots.items():
        assert 0 <= home < shards and sorted(found) == list(range(len(found)))
    by_crc = defaultdict(set)
    for r in rows:
        by_crc[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in by_crc.values())


def brute(df, shards):
    """(doc_id, size, shard) by groups of equal texts in order of their hash, all on one machine."""
    rows = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    groups = defaultdict(int)
    for r in rows:
        groups[r.h] += 16 + len((r.text or "").encode())
    order = sorted(groups)
    sizes = np.array([groups[h] for h in order])
    total = np.concatenate([[0], np.cumsum(sizes)])
    cap, at, shard = best_capacity(sizes, shards), 0, {}
    for k in range(shards):
        fits = [j for j in range(at, len(sizes) + 1) if total[j] - total[at] <= cap and best_capacity(sizes[j:], shards - k - 1) <= cap] if k < shards - 1 else [len(sizes)]
        goal = total[at] + (total[-1] - total[at]) / (shards - k)
        end = min(fits, key=lambda j: (abs(total[j] - goal), j))
        shard |= {h: k for h in order[at:end]}
        at = end
    return sorted((str(r.doc_id), 16 + len((r.text or "").encode()), shard[r.h]) for r in rows)


@pytest.mark.parametrize("seed, bits, shards", [(1, 1, 3), (2, 3, 5), (3, 16, 4), (4, 2, 7)])
def test_whole_result_against_brute_force(documents, monkeypatch, seed, bits, shards):
    monkeypatch.setattr(sharding, "CELL_BITS", bits)
    monkeypatch.setattr(sharding, "DIVIDE_BITS", 2)
    random.seed(seed)
    texts = [(i, random.choice(["same", "é" * 30, f"own {i} " * random.randint(1, 9)])) for i in range(60)]
    df = documents([*texts, *EDGES[:9]])
    rows = sharding.shard_documents(df, shards, rows_per_task=7).collect()
    assert sorted((str(r.doc_id), r["size"], r.shard) for r in rows) == brute(df, shards)
    check(rows, shards, [*texts, *EDGES[:9]])


def test_registered_query(spark):
    """Shards of the whole table are within one largest group of the mean, and number their rows without gaps."""
    from wickline.llm import queries

    rows = queries.op1_minimax_shards(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r["size"] == 16 + len((docs[r.doc_id] or "").encode()) and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and r.law == "bytes" for r in rows)
    check(rows, 40, rows)
    groups = defaultdict(int)
    for r in rows:
        groups[docs[r.doc_id]] += r["size"]
    shards = [sum(r["size"] for r in rows if r.shard == s) for s in range(40)]
    mean = sum(shards) / 40
    assert all(abs(s - mean) <= max(groups.values()) for s in shards)


def test_edges(documents):
    rows = sharding.shard_documents(documents(EDGES), 5).collect()
    check(rows, 5, EDGES)
    want = sorted((16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for _, t in EDGES)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert rows == sharding.shard_documents(documents(EDGES), 5).collect() or sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(documents(EDGES).repartition(7), 5).collect()))


def test_hot_group_is_numbered_in_parts_and_sizes_are_near_equal(documents):
    random.seed(3)
    texts = [(i, "same text") if i % 3 == 0 else (i, "t" * random.randint(1, 60)) for i in range(3000)]
    rows = sharding.shard_documents(documents(texts), 4, rows_per_task=100).collect()
    check(rows, 4, texts)
    varied = [(i, f"{i} " * random.randint(1, 20)) for i in range(3000)]
    rows = sharding.shard_documents(documents(varied), 6).collect()
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) < 3 * max(r["size"] for r in rows)


def test_empty_table(documents):
    assert sharding.shard_documents(documents([(1, "a")]).limit(0), 3).collect() == []


def test_more_shards_than_groups(documents):
    rows = sharding.shard_documents(documents([(1, "a"), (2, "b")]), 40).collect()
    assert sorted(r.slot for r in rows) == [0, 0]
