"""Hard negatives by dual-tree search.

Anchors and candidates are dealt into cells of space by a router, a balanced
tree of cuts that is fitted to a bounded sample; where a row falls decides its
block and nothing else.  A task meets one block of anchors with one block of
candidates and grows a tree over each.  Every node has a box and a ball around
its rows, so that two nodes bound the inner products between them: a pair whose
interval cannot matter to any anchor of its node is dropped with all that
stands below, and pairs of leaves are scored exactly.

The same intervals keep candidates from being sent at all.  Positives are first
searched among the anchors' own cell; the least of the scores found bounds what
another candidate must reach, and a candidate goes to the other cells of anchors
only where the interval between it and the cell's box reaches that.  Negatives
have a window of scores for each positive, and candidates go where their
interval meets one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.llm.common import discard, materialize
from wickline.llm.topk import HALF, LONG

#: Rows of a leaf over anchors and over candidates.
ANCHOR_LEAF, LEAF = 32, 128
#: Cells at most (each has a box on the driver), bytes of all their boxes at most, and rows that the router is fitted to.
CELLS, BOX_BYTES, SAMPLE = 1024, 32 << 20, 4096
#: Room for rounding in the intervals, which are made of doubles; scores are exact.
ROOM = 1e-9


class Tree:
    """A tree over the rows of a matrix; every node is a stretch of ``order`` with a box and a ball around its rows."""

    def __init__(self, values: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(values))
        self.stretch: list[tuple[int, int]] = []
        self.below: list[tuple[int, int] | None] = []
        boxes, open_nodes = [], [self._node(0, len(values))]
        while open_nodes:
            node = open_nodes.pop()
            start, end = self.stretch[node]
            rows = values[self.order[start:end]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            middle = rows.mean(axis=0)
            boxes.append((node, low, high, middle, np.sqrt(((rows - middle) ** 2).sum(axis=1).max())))
            widest = int(np.argmax(high - low)) if len(low) else 0
            if end - start > leaf and high[widest] > low[widest]:
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(rows[:, widest], half)]
                self.below[node] = self._node(start, start + half), self._node(start + half, end)
                open_nodes += self.below[node]
        boxes.sort(key=lambda b: b[0])
        self.low, self.high, self.middle, self.radius = (np.array(x) for x in list(zip(*boxes))[1:])
        self.length = np.sqrt((self.middle**2).sum(axis=1))

    def _node(self, start: int, end: int) -> int:
        self.stretch.append((start, end))
        self.below.append(None)
        return len(self.stretch) - 1

    def rows(self, node: int) -> np.ndarray:
        start, end = self.stretch[node]
        return self.order[start:end]

    def interval(self, node: int, other: Tree, its: int) -> tuple[float, float]:
        """Bounds of the inner products of a row of ``node`` with one of the other tree's node."""
        ends = np.array([self.low[node] * other.low[its], self.low[node] * other.high[its], self.high[node] * other.low[its], self.high[node] * other.high[its]])
        around, reach = float(self.middle[node] @ other.middle[its]), float(self.radius[node] * other.length[its] + other.radius[its] * self.length[node] + self.radius[node] * other.radius[its])
        low, high = max(float(ends.min(axis=0).sum()), around - reach), min(float(ends.max(axis=0).sum()), around + reach)
        room = 1 + ROOM * (abs(around) + reach)
        return low - room, high + room


def meet(anchors: Tree, candidates: Tree, matters: Callable[[np.ndarray, float, float], bool], score: Callable[[np.ndarray, np.ndarray], None]) -> int:
    """Score every pair of leaves that may matter, most promising first; returns how many were scored."""
    scored, stack = 0, [(0, 0, *anchors.interval(0, candidates, 0))]
    while stack:
        a, c, low, high = stack.pop()
        group = anchors.rows(a)
        if not matters(group, low, high):
            continue
        ours, theirs = anchors.below[a], candidates.below[c]
        if ours is None and theirs is None:
            score(group, candidates.rows(c))
            scored += 1
            continue
        if theirs is None or ours is not None and len(group) * 4 > len(candidates.rows(c)):
            pairs = [(x, c) for x in ours]
        else:
            pairs = [(a, x) for x in theirs]
        stack += sorted(((x, y, *anchors.interval(x, candidates, y)) for x, y in pairs), key=lambda p: p[3])
    return scored


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows padded with 0."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact(values: np.ndarray, wide: bool) -> np.ndarray:
    """For exact products: doubles while all sums stay below 2^53, else Python's whole numbers."""
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape) if wide else values


def halves(score: int) -> tuple[int, int]:
    """A score as two longs that order alike, exactly so below 2^124."""
    return max(-LONG - 1, min(LONG, score >> HALF)), score & ((1 << HALF) - 1)


class Best:
    """The ``k`` best (score, id) of each of ``n`` askers, and the score that one more must reach."""

    def __init__(self, k: int, floor: list, wide: bool) -> None:
        self.k, self.found = k, [[] for _ in floor]
        self.bar = np.array(floor, dtype=object if wide else float)

    def offer(self, asker: int, scores: np.ndarray, ids: np.ndarray) -> None:
        new = sorted(self.found[asker] + [(-int(s), int(i)) for s, i in zip(scores, ids)])[: self.k]
        self.found[asker] = new
        if len(new) == self.k:
            self.bar[asker] = -new[-1][0]


def _positives(k: int, width: int, wide: bool):
    def search(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(anchors) and len(block):
            a, c = matrix(anchors["v"], width), matrix(block["v"], width)
            ea, ec = exact(a, wide), exact(c, wide)
            own, ids = anchors["anchor_id"].to_numpy(np.int64), block["vec_id"].to_numpy(np.int64)
            best = Best(k, [-np.inf] * len(a), wide)
            labels = block["label"].to_numpy(np.int64)
            for label, group in anchors.groupby("label").indices.items():
                same = np.nonzero(labels == label)[0]
                if not len(same):
                    continue

                def matters(inside: np.ndarray, low: float, high: float, group=group) -> bool:
                    return high >= best.bar[group[inside]].min()

                def score(inside: np.ndarray, there: np.ndarray, group=group, same=same) -> None:
                    askers, others = group[inside], same[there]
                    scores = ea[askers] @ ec[others].T
                    take = (scores >= best.bar[askers][:, None]) & (own[askers][:, None] != ids[others][None, :])
                    for n in np.nonzero(take.any(axis=1))[0]:
                        best.offer(askers[n], scores[n, take[n]], ids[others[take[n]]])

                meet(Tree(a[group], ANCHOR_LEAF), Tree(c[same], LEAF), matters, score)
            rows = [(int(own[n]), i, *halves(-s)) for n, found in enumerate(best.found) for s, i in found]
        return pd.DataFrame(rows, columns=["anchor_id", "positive_id", "high", "low"]).astype("int64")

    return search


def _negatives(k: int, width: int, wide: bool):
    def search(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(anchors) and len(block):
            a, c = matrix(anchors["v"], width), matrix(block["v"], width)
            ea, ec = exact(a, wide), exact(c, wide)
            ids, labels, their = block["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), block["label"].to_numpy(np.int64)
            # an asker is an anchor with one of its positives; the askers of an anchor are neighbours
            askers = [(n, (p["rank"], p["positive_id"]), (p["high"] << HALF) + p["low"]) for n, positives in enumerate(anchors["positives"]) for p in positives]
            anchor = np.array([n for n, _, _ in askers])
            first = np.searchsorted(anchor, np.arange(len(a) + 1))
            best = Best(k, [window(s)[0] for _, _, s in askers], wide)
            cap = np.array([window(s)[1] for _, _, s in askers], dtype=best.bar.dtype)
            fits = (best.bar <= cap).astype(bool)
            # what an anchor's askers need at least, and can use at most
            need, most = np.full(len(a), np.inf, dtype=best.bar.dtype), np.full(len(a), -np.inf, dtype=best.bar.dtype)

            def renew(n: int) -> None:
                some = np.nonzero(fits[first[n] : first[n + 1]])[0] + first[n]
                if len(some):
                    need[n], most[n] = min(best.bar[some]), max(cap[some])

            for n in range(len(a)):
                renew(n)

            def matters(inside: np.ndarray, low: float, high: float) -> bool:
                return bool(((need[inside] <= high) & (most[inside] >= low)).any())

            def score(inside: np.ndarray, there: np.ndarray) -> None:
                scores = ea[inside] @ ec[there].T
                some = np.concatenate([np.arange(first[n], first[n + 1]) for n in inside])
                at = np.repeat(np.arange(len(inside)), first[inside + 1] - first[inside])[fits[some]]
                some, mine = some[fits[some]], scores[at]
                take = (mine >= best.bar[some][:, None]) & (mine <= cap[some][:, None]) & (labels[inside[at]][:, None] != their[there][None, :])
                for n in np.nonzero(take.any(axis=1))[0]:
                    chosen = np.nonzero(take[n])[0]
                    best.offer(some[n], mine[n, chosen], ids[there[chosen]])
                    renew(inside[at[n]])

            meet(Tree(a, ANCHOR_LEAF), Tree(c, LEAF), matters, score)
            own = anchors["anchor_id"].to_numpy(np.int64)
            rows = [(int(own[n]), *map(int, p), *halves(ps), i, *halves(-s)) for (n, p, ps), found in zip(askers, best.found) for s, i in found]
        return pd.DataFrame(rows, columns=["anchor_id", "place", "positive_id", "p_high", "p_low", "negative_id", "high", "low"]).astype("int64")

    return search


def window(positive_score: int) -> tuple[int, int]:
    """Least and greatest score of a negative: half of the positive's, and 95 hundredths."""
    return -(-50 * positive_score // 100), 95 * positive_score // 100


class Router:
    """Cuts of space into 2^depth cells of about equal shares of a sample."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.cuts, groups = depth, [], [np.arange(len(sample))]
        for _ in range(depth):
            level, halved = [], []
            for rows in groups:
                inside = sample[rows]
                axis = int(np.argmax(inside.var(axis=0))) if len(rows) else 0
                at = float(np.median(inside[:, axis])) if len(rows) else 0.0
                level.append((axis, at))
                halved += [rows[inside[:, axis] <= at], rows[inside[:, axis] > at]]
            groups = halved
            self.cuts.append((np.array([c[0] for c in level]), np.array([c[1] for c in level])))

    def cells(self, values: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(values), dtype=np.int64)
        for axis, at in self.cuts:
            cell = 2 * cell + (values[np.arange(len(values)), axis[cell]] > at[cell])
        return cell


def _best_first(df: DataFrame, by: list[str], tie: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("high"), F.desc("low"), tie))
    return df.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _score(high: str, low: str) -> Column:
    """The long that two halves stand for, or the nearest one."""
    h = F.col(high)
    return F.when(h > 1, F.lit(LONG)).when(h < -2, F.lit(-LONG - 1)).otherwise(F.shiftleft(h, HALF).bitwiseOR(F.col(low)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, anchor_block: int = 1024, block: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    ``vectors`` has (vec_id, label, v), v an array of whole numbers as doubles;
    ``is_anchor`` says of a row whether it is an anchor.  An anchor's positives
    are the ``positives`` rows of its label with the highest inner products,
    except those with its own id; a positive's negatives are the ``negatives``
    highest rows of other labels within :func:`window`.  Ties go to the smaller
    id.  Rows with a null id, label or vector take no part.  Vectors of different
    lengths are padded with 0.  An anchor whose id is repeated is asked once, by
    its least label and vector; other repeated rows each count, also as positives.  Scores are exact
    below 2^124, and given as the nearest long.  An empty table and anchors
    without positives give no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and label is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = materialize(rows, "negatives-rows")
    n, asked, width, most = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, most = max(1, width or 0), most or 0.0
    wide = float(most) ** 2 * width >= 2.0**53
    limit = max(1, min(CELLS, BOX_BYTES // (16 * width)))
    depth = min(max(0, (-(-n // block) - 1).bit_length()), limit.bit_length() - 1)
    coarse = min(depth, max(0, (-(-asked // anchor_block) - 1).bit_length()))
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(SAMPLE).toPandas()["v"] if depth else []
    router = Router(matrix(sample, width), depth)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(router.cells(matrix(v, width)), dtype="int32")

    placed = rows.withColumn("cell", cell_of("v")).withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "negatives-placed")
    discard(rows)
    anchors = placed.where("anchor").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v", "cell")).alias("one")).select("anchor_id", "one.label", "one.v", F.shiftright("one.cell", depth - coarse).alias("home"))
    home = F.shiftright("cell", depth - coarse)

    def blocks(counted: DataFrame, cell: str, size: int) -> list[tuple[int, int]]:
        """First number and number of the blocks of each cell; at most ``CELLS`` counts reach the driver."""
        counts, out, at = {r[0]: r[1] for r in counted.groupBy(cell).count().collect()}, [], 0
        for c in range(1 << depth):
            out.append((at, max(1, -(-counts.get(c, 0) // size))))
            at += out[-1][1]
        return out

    def numbered(dealt: list[tuple[int, int]], cell: Column, key: Column) -> Column:
        first, parts = (F.array(*[F.lit(x) for x in column]) for column in zip(*dealt))
        return F.element_at(first, (cell + 1).cast("int")) + F.pmod(F.xxhash64(key), F.element_at(parts, (cell + 1).cast("int"))).cast("int")

    held, homes = blocks(placed, "cell", block), blocks(anchors, "home", anchor_block)
    anchors = materialize(anchors.withColumn("qb", numbered(homes, F.col("home"), F.col("anchor_id"))), "negatives-anchors")
    candidates = placed.withColumn("cb", numbered(held, F.col("cell"), F.col("row"))).select("vec_id", "label", "v", "cb", home.alias("home"))
    blocks_of_home = F.array(*[F.sequence(F.lit(first), F.lit(first + parts - 1)) for first, parts in homes])

    def met(asking: DataFrame, to: Column, search, schema: str) -> DataFrame:
        """Each anchor block beside the candidates that go to its cell, a block of them at a time."""
        qb = F.explode(F.element_at(blocks_of_home, F.col("to") + 1))
        sent = candidates.withColumn("to", F.explode(to))
        pairs = sent.select("to", "cb").distinct().select(qb.alias("qb"), F.col("cb").alias("met"))
        dealt = sent.select("vec_id", "label", "v", F.col("cb").alias("block"), qb.alias("asked"))
        return asking.join(pairs, "qb").groupBy("qb", "met").cogroup(dealt.groupBy("asked", "block")).applyInPandas(search, schema)

    def boxes_of(homes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The box of each cell's anchors, where ``BOX_BYTES`` bounds what is collected."""
        total = {r["home"]: r["count"] for r in homes.groupBy("home").count().collect()}
        out = {h: (np.zeros(width), np.zeros(width)) for h in total}
        for r in homes.select("home", F.posexplode("v")).groupBy("home", "pos").agg(F.count("*").alias("n"), F.min("col").alias("low"), F.max("col").alias("high")).collect():
            short = r["n"] < total[r["home"]]  # the others are padded with 0
            out[r["home"]][0][r["pos"]], out[r["home"]][1][r["pos"]] = min(r["low"], 0.0) if short else r["low"], max(r["high"], 0.0) if short else r["high"]
        return out

    boxes = boxes_of(anchors)

    def reached(bars: dict[int, tuple[float, float]], own: bool) -> Callable:
        """A function of (v, home): the cells of anchors whose scores with the candidate can lie in the cell's bars."""
        known = sorted(set(boxes) & set(bars))
        low, high = (np.array([boxes[c][i] for c in known]).reshape(len(known), width) for i in (0, 1))
        least, most_ = (np.array([bars[c][i] for c in known]) for i in (0, 1))

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series, at: pd.Series) -> pd.Series:
            values = matrix(v, width)
            up, down = np.maximum(values, 0), np.minimum(values, 0)
            top, bottom = up @ high.T + down @ low.T, up @ low.T + down @ high.T
            room = 1 + ROOM * (np.abs(top) + np.abs(bottom))
            take = (top + room >= least) & (bottom - room <= most_)
            return pd.Series([[known[i] for i in np.nonzero(t)[0] if own or known[i] != h] for t, h in zip(take, at)])

        return cells

    schema = "anchor_id long, positive_id long, high long, low long"
    asking = anchors.select("anchor_id", "label", "v", "qb")
    near = met(asking, F.array("home"), _positives(positives, width, wide), schema)
    if coarse:
        near = materialize(_best_first(near, ["anchor_id"], "positive_id", positives).drop("rank"), "negatives-near")
        full = near.groupBy("anchor_id").agg(F.count("*").alias("found"), F.min(F.col("high") * 2.0**HALF + F.col("low")).alias("least"))
        bar = F.when(F.coalesce("found", F.lit(0)) < positives, F.lit(float("-inf"))).otherwise(F.col("least"))
        bars = {r["home"]: (r["bar"] - abs(r["bar"]) * ROOM if np.isfinite(r["bar"]) else -np.inf, np.inf) for r in anchors.join(full, "anchor_id", "left").groupBy("home").agg(F.min(bar).alias("bar")).collect()}
        far = met(asking, reached(bars, False)("v", "home"), _positives(positives, width, wide), schema)
        near = near.unionByName(far)
    chosen = materialize(_best_first(near, ["anchor_id"], "positive_id", positives), "negatives-positives")

    held_by = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "high", "low"))).alias("positives"))  # at most ``positives`` each
    asking = materialize(anchors.join(held_by, "anchor_id"), "negatives-asking")
    value = F.col("p.high") * 2.0**HALF + F.col("p.low")
    limits = asking.select("home", F.explode("positives").alias("p")).groupBy("home").agg(F.min(value).alias("least"), F.max(value).alias("most")).collect()
    bars = {r["home"]: (min(0.5 * r["least"], 0.95 * r["least"]) - abs(r["least"]) * ROOM - 1, 0.95 * r["most"] + abs(r["most"]) * ROOM + 1) for r in limits}
    found = met(asking.select("anchor_id", "label", "v", "qb", "positives"), reached(bars, True)("v", "home"), _negatives(negatives, width, wide), "anchor_id long, place long, positive_id long, p_high long, p_low long, negative_id long, high long, low long")
    best = _best_first(found, ["anchor_id", "place"], "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", _score("p_high", "p_low").alias("positive_score"), _score("high", "low").alias("negative_score"))
