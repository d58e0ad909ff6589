import math
import random

import pytest
from pyspark.sql import functions as F

from wickline.llm import topk


def brute(rows, k):
    scaled = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in scaled if i % 100 == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in scaled if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    found = topk.exact_topk(df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v"), df, **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("blocks", [(512, 8192), (2, 40)])
def test_against_brute_force(spark, blocks):
    random.seed(1)
    quarter = [random.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(6)]
    rows = [(i, [random.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(6)]) for i in range(310)]  # many ties
    rows += [(311, None), (312, [1.0, None, 0.0]), (313, [float("nan")] * 6), (314, [float("inf")] * 6), (None, quarter), (315, []), (316, [1.0, 2.0])]
    assert run(spark, rows, k=10, query_block=blocks[0], candidate_block=blocks[1]) == brute(rows, 10)


def test_few_candidates_and_none(spark):
    rows = [(100, [1.0]), (1, [0.5]), (2, [0.5])]
    assert run(spark, rows) == [(100, 1, 1, 1024 * 512), (100, 2, 2, 1024 * 512)]
    assert run(spark, [(100, [1.0])]) == []
    assert run(spark, []) == []


def test_large_components_do_not_overflow(spark):
    rows = [(0, [1e6, -3e5]), (1, [9e5, 7e5]), (2, [-1e6, 2e5])]
    assert run(spark, rows) == brute(rows, 10)


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (5, [0.5]), (5, [0.5])]
    assert run(spark, rows) == [(0, 1, 5, 1024 * 512), (0, 2, 5, 1024 * 512)]


def test_wide_scores_are_ordered_exactly(spark):
    big = 2.0**50
    rows = [(0, [big, big, 1.0]), (1, [big, 1.0, 0.5]), (2, [big, 1.0, 0.75]), (3, [big, 1.0, 0.25]), (4, [-big, -big, 0.0])]
    got = run(spark, rows)
    assert [r[2] for r in got] == [2, 1, 3, 4]  # the scores differ in their last places alone, and are all beyond a long
    assert [r[3] for r in got] == [topk.LONG] * 3 + [-topk.LONG - 1]


def test_many_terms_of_middling_size_do_not_overflow(spark):
    rows = [(0, [50_000.0] * 4_000), (1, [50_000.0] * 4_000), (2, [49_999.0] * 4_000)]
    assert [(r[2], r[3] > 9e18) for r in run(spark, rows)] == [(1, True), (2, True)]
