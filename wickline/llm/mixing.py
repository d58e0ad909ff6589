"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source_size times in the mix.
Within its source, ordered by size, the expected copies are summed up from one
offset in [0, 1) that is fixed by seed and source, and a document is emitted
once for each integer boundary that the sum crosses at it.  As neighbours in
the order are of like size, the words taken come within about one document of
the target.

The sums need no global sort.  Sizes fall into bands, which are in order, and
the rows of each (source, band) are counted; a band beyond ``rows_per_task``
rows is divided by a hash of the id into parts of about that many.  Only the
rows of a part are ordered in one task, so a source that holds a third of all
rows is spread over many.  The driver holds one line a source.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.llm.common import WORD, free_name, materialize, quoted

#: The plan has a row for each source and band with its parts; up to so many parts it is broadcast, a larger one is joined.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, at most ``most`` times the source's own.

    Sources by code point, null last, take the weights in turn.  What a
    source cannot take is shared among the others by weight, until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_ = share * sum(sizes.values()), set(names)
    found: dict[str | None, float] = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and level * weight[s] >= most * sizes[s]]
        if not full:
            found |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            found[s] = most * sizes[s]
            left -= found[s]
            open_.discard(s)
        left = max(left, 0.0)
    return found


def offset(source: str | None, seed: int) -> float:
    name = "" if source is None else source
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) / 2.0**32


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", rows_per_task: int = 1_000, into: str = "mix") -> DataFrame:
    """The rows of ``docs`` with a struct ``into`` of size, source_size, target and copies.

    Size is the number of words.  Null and empty texts have none and weigh
    nothing, yet they are sampled at the rate of their source; a source of
    no words has no copies.  Rows without a source are a source of their own.
    Of repeated rows each counts, and which of them is taken more often is open.
    All columns pass through, whatever their names; one named ``into`` is replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    size = word_count(F.col(quoted(text)))
    band = F.floor(F.log2(size + 1) * 16).cast("int")
    # plain columns under names of their own, so that those nobody asks for are never shuffled
    rows = docs.select(*[F.col(quoted(c)).alias(f"row_{i}") for i, c in enumerate(kept)], F.col(quoted(key)).alias("id"), F.col(quoted(source)).alias("src"), size.alias("size"), band.alias("band"))

    # one pass counts the rows of each band by a hash of the id, so that bands of any size can be divided afterwards
    subs = 1 << min(12, max(4, (docs.count() // (8 * rows_per_task)).bit_length()))
    sub = F.pmod(F.xxhash64("id"), F.lit(subs)).cast("int")
    counts = materialize(rows.groupBy("src", "band", sub.alias("sub")).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "bands")
    by_source = counts.groupBy("src").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).collect()  # a row a source
    sizes = {r["src"]: int(r["words"]) for r in by_source}
    total = sum(r["n"] for r in by_source)
    rows_per_task = max(rows_per_task, total >> 16)
    goal = targets(sizes, weights, share, most)
    sources = [(s, goal[s] / sizes[s] if sizes[s] else 0.0, offset(s, seed), sizes[s], float(goal[s])) for s in sizes]
    source_frame = spark.createDataFrame(sources, "g_src string, rate double, start double, source_size long, target double")
    band_order = Window.partitionBy("src").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / rows_per_task)))).cast("int")
    bands = counts.groupBy("src", "band").agg(F.sum("n").alias("n"))
    bands = bands.select("src", "band", F.coalesce(F.sum("n").over(band_order), F.lit(0)).alias("before"), F.least(parts, F.lit(subs)).alias("parts"))
    part_order = Window.partitionBy("src", "band").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    same_band = F.col("c.src").eqNullSafe(F.col("b.src")) & (F.col("c.band") == F.col("b.band"))
    cut = counts.alias("c").join(bands.alias("b"), same_band).select("c.src", "c.band", "before", "parts", (F.col("sub") % F.col("parts")).alias("part"), "n")
    cut = cut.groupBy("src", "band", "before", "parts", "part").agg(F.sum("n").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(part_order), F.lit(0)))
    plan = cut.groupBy("src", "band", "before", "parts").agg(F.map_from_entries(F.collect_list(F.struct("part", "skip"))).alias("skips"))
    plan = plan.join(source_frame, F.col("src").eqNullSafe(F.col("g_src"))).drop("g_src").withColumnsRenamed({"src": "p_src", "band": "p_band"})
    plan = materialize(plan, "plan")
    plan = F.broadcast(plan) if (plan.agg(F.sum("parts")).first()[0] or 0) <= BROADCAST_ROWS else plan
    dealt = rows.join(plan, F.col("src").eqNullSafe(F.col("p_src")) & (F.col("band") == F.col("p_band"))).withColumn("part", sub % F.col("parts"))
    place = F.col("before") + F.element_at("skips", F.col("part")) + F.row_number().over(Window.partitionBy("src", "band", "part").orderBy("size", "id"))
    placed = dealt.withColumn("place", place)
    crossed = F.floor(F.col("rate") * F.col("place") + F.col("start")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("start"))
    copies = F.least(crossed, F.ceil("rate")).cast("long")
    return placed.select(*[F.col(f"row_{i}").alias(c) for i, c in enumerate(kept)], F.struct("size", "source_size", "target", copies.alias("copies")).alias(into))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    into = free_name("mix", docs.columns)
    time = free_name("time", [*docs.columns, into])
    out = mix(docs, into=into, **options)
    times = F.explode(F.array_repeat(F.lit(1), F.col(f"{into}.copies").cast("int")))
    return out.withColumn(time, times).drop(into, time)
