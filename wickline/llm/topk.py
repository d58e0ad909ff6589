"""Exhaustive exact top-k by term-at-a-time accumulation.

A vector is a sparse row of (term, weight) entries.  Candidates are cut into
blocks, each block is inverted into weighted postings per term, and every term
of a query row scatters ``query weight * posting weight`` into a dense score
array of the block.  A partition selection keeps the best of each block, and a
window merges the blocks.  Queries are cut into blocks too: each pair of
blocks is one group of bounded size, so nothing is broadcast and no group
grows with the data.  A candidate is copied once per query block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONG, HALF = (1 << 63) - 1, 62


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double; null where a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")))


def block_scores(query: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int, wide: bool) -> np.ndarray:
    """Scores of one query row against a block of ``n`` candidates, a term at a time."""
    scores = np.zeros(n, dtype=object if wide else np.int64)
    for term in np.nonzero(query[: len(postings)])[0]:
        rows, weights = postings[term]
        scores[rows] += query[term] * weights
    return scores


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows padded with 0, as whole numbers in doubles."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _whole(values: np.ndarray, wide: bool) -> np.ndarray:
    """As int64, or as Python's whole numbers where sums of products could overflow."""
    if wide:
        return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)
    return values.astype(np.int64)


def _limited(x: int) -> int:
    return max(-LONG - 1, min(LONG, x))


def _best(k: int):
    def best(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "high", "low")})
        if not len(queries) or not len(block):
            return empty
        q, c = _matrix(queries["v"]), _matrix(block["v"])
        terms = min(q.shape[1], c.shape[1])
        wide = max(np.abs(q).max(initial=0), 1.0) * max(np.abs(c).max(initial=0), 1.0) * max(1, terms) >= 2.0**62
        q, c = _whole(q, wide), _whole(c, wide)
        postings = []
        for term in range(c.shape[1]):
            rows = np.nonzero(c[:, term])[0]
            weights = c[rows, term]
            postings.append((slice(None) if len(rows) == len(c) else rows, weights))
        ids, found = block["vec_id"].to_numpy(np.int64), []
        for query_id, row in zip(queries["query_id"].to_numpy(np.int64), q):
            scores = block_scores(row, postings, len(c), wide)
            others = np.nonzero(ids != query_id)[0]
            s = scores[others]
            if len(s) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                take = np.nonzero(s >= kth)[0]  # with all that tie at the last place
                take = np.array(sorted(take, key=lambda t: (-s[t], ids[others[t]])) if wide else take[np.lexsort((ids[others[take]], -s[take]))])[:k]
            else:
                take = np.arange(len(s))
            best = s[take]
            high = np.array([_limited(int(x) >> HALF) for x in best] if wide else best >> HALF, dtype=np.int64)
            low = np.array([int(x) & ((1 << HALF) - 1) for x in best] if wide else best & ((1 << HALF) - 1), dtype=np.int64)
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[others[take]], "high": high, "low": low}))
        return pd.concat(found) if found else empty

    return best


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = 512, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest inner products.

    ``queries`` has (query_id, v), ``candidates`` (vec_id, v), v an array of
    whole numbers as doubles.  Ties go to the smaller vec_id.  Candidates that
    have the query's own id are left out; a query id that is repeated is
    answered once; repeated candidates each count.  Rows with a null id or a
    null vector take no part.  Vectors of different lengths are compared over
    their common terms.  Sums are exact, and their order too while they are under
    2^124; a score beyond a long is given as the nearest long.  Other columns are
    ignored, whatever their names.
    """
    candidates = candidates.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long"), "v")
    queries = queries.where("query_id is not null and v is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min("v").alias("v"))
    n_queries, n_candidates = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n_candidates // candidate_block))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = candidates.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    best = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(_best(k), "query_id long, vec_id long, high long, low long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    score = F.when(F.col("high") > 1, F.lit(LONG)).when(F.col("high") < -2, F.lit(-LONG - 1)).otherwise(F.shiftleft(F.col("high"), HALF).bitwiseOR(F.col("low")))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
