"""Language-model scores from a log-frequency Bloom filter.

Counts of single words and word pairs are quantised to levels 1 + floor(log2 c)
and every level up to an n-gram's own is set in a Bloom filter.  A reader
probes level 1, 2, ... until a probe fails, which gives the quantised count.
The filter is built in segments by as many groups; its bits follow the counted
levels without an end.  Up to ``BROADCAST_BITS`` it is put together on the
driver and broadcast.  A larger one stays in its segments, of which a task
holds one at a time: the n-grams of each piece of the texts are sent to their
segments, and the levels found there come back to their piece, which makes its
n-grams again and so needs no keys with them.

N-grams travel packed by segment, in the four bytes that follow the bits of
the segment: as segments grow in number with the tokens, an n-gram shares them
with another of its segment with a chance of about 10^-4 at any size, far
below that of a filter's own errors.

The word counts themselves are kept exactly too, for the base score.  The most
frequent ones, at most ``BROADCAST_WORDS``, are broadcast; all others are
joined, so that the exact part has no bound on the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm.common import PackedHasher, doc_remainder, give_back, materialize, mixed_bits, tidied

#: Fewest segments of the filter, and most bits of one.
SEGMENTS, SEGMENT_BITS = 256, 1 << 21
#: Most bits of a filter that is broadcast: 8 MB.  Larger ones are probed by segment.
BROADCAST_BITS = 1 << 26
#: Bytes of text whose n-grams are looked up together in a filter that is not broadcast.
PIECE_BYTES = 1 << 23
#: Most words whose exact counts are broadcast: 16 bytes each.
BROADCAST_WORDS = 1 << 21
#: N-grams that a worker sums up at a time, and words that it looks up at a time.
SUMMED, AT_ONCE = 1_500_000, 100_000

END_PACKED = xxhash.xxh3_64_digest(b" ")[::-1]  # no word holds white space
END = int.from_bytes(END_PACKED, "little")


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each n-gram: its top bits; ``segments`` is a power of two."""
    if segments == 1:
        return np.zeros(len(grams), dtype=np.int64)
    return (grams >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def filter_size(held: int) -> tuple[int, int]:
    """(bits of a segment, segments) for ``held`` levels to set, at six bits and more each."""
    bits, segments = 1 << 12, SEGMENTS
    while bits * segments < 6 * held:
        if bits < SEGMENT_BITS:
            bits *= 2
        else:
            segments *= 2
    return bits, segments


def word_gram(words: np.ndarray) -> np.ndarray:
    """Key of a single word in the filter."""
    return mixed_bits(words ^ np.uint64(0x9E3779B97F4A7C15))


def pair_gram(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Key of two words in order."""
    return mixed_bits(first * np.uint64(0xD6E8FEB86659FD93) + mixed_bits(second))


def _sequences(batch: pa.RecordBatch, hasher: PackedHasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of a batch's texts, an end behind each, in pieces of about ``AT_ONCE`` words.

    Yields the first row of a piece, its words, and where each text starts in them.
    """
    words: list[bytes] = []
    starts: list[int] = []
    first = 0
    for row, text in enumerate(batch.column("text").cast(pa.binary())):
        starts.append(len(words))
        words.extend(hasher.words(text.as_py()))
        words.append(END_PACKED)
        if len(words) >= AT_ONCE or row + 1 == batch.num_rows:
            yield first, np.frombuffer(b"".join(words), dtype="<u8"), np.array(starts, dtype=np.int64)
            words, starts, first = [], [], row + 1


def _before(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each; an end before the first of a text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[starts] = np.uint64(END)
    return out


def _summed(batches: Iterator[pa.RecordBatch], of_pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct words or pairs in order, and their counts, for about ``SUMMED`` of them at a time."""
    hasher, held, size = PackedHasher(), [], 0
    for batch in batches:
        for _, words, starts in _sequences(batch, hasher):
            held.append(pair_gram(_before(words, starts), words) if of_pairs else words)
            size += len(words)
            if size > SUMMED:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of the words of texts."""
    for grams, n in _summed(batches, False):
        for i in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000], pa.int64())], ["gram", "n"])


def kept_bits(segments: int) -> int:
    """Leading bits of an n-gram that are kept: those of its segment and 32 more."""
    return min(64, segments.bit_length() - 1 + 32)


def shortened(grams: np.ndarray, kept: int) -> np.ndarray:
    return grams >> np.uint64(64 - kept) << np.uint64(64 - kept)


def packed_by_segment(grams: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Segments of n-grams in order, where each starts and ends, and its n-grams in four bytes each."""
    kept, own = kept_bits(segments), segments.bit_length() - 1
    segment = segment_of(grams, segments)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(grams)]])
    low = grams >> np.uint64(64 - kept) & np.uint64((1 << kept - own) - 1)
    blob = low.astype("<u4").tobytes()
    return segment[cuts[:-1]], cuts, [blob[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])]


def unpacked(segment: int, packed: bytes, segments: int) -> np.ndarray:
    """N-grams of a segment, shortened, from their four bytes each."""
    kept, own = kept_bits(segments), segments.bit_length() - 1
    low = np.frombuffer(packed, dtype="<u4").astype(np.uint64) << np.uint64(64 - kept)
    return low | np.uint64(segment << 64 - own) if own else low


#: Counted n-grams of one segment: counts in a byte, those of 255 and more again in ``large``.
COUNTED = "segment long, grams binary, small binary, large binary"


def _counted(grams: np.ndarray, n: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    if not len(grams):
        return
    segment, cuts, packed = packed_by_segment(grams, segments)
    small = np.minimum(n, 255).astype(np.uint8)
    rows = [(small[i:j].tobytes(), n[i:j][n[i:j] >= 255].astype("<i8").tobytes()) for i, j in zip(cuts, cuts[1:])]
    for i in range(0, len(packed), 1_000):
        part = slice(i, i + 1_000)
        yield pa.RecordBatch.from_arrays([pa.array(segment[part]), pa.array(packed[part], pa.binary()), *(pa.array(x, pa.binary()) for x in zip(*rows[part]))], ["segment", "grams", "small", "large"])


def _pairs(segments: int):
    """Counted pairs of the words of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, n in _summed(batches, True):
            yield from _counted(grams, n, segments)

    return run


def _keyed(segments: int):
    """Counted words, from (gram, n), under their keys in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            grams, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(grams)
            return _counted(grams[order], n[order], segments)

        for batch in batches:
            held.append((word_gram(batch.column("gram").to_numpy().view(np.uint64)), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size > SUMMED:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


def _merged(grams: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of arrays in order, with their counts summed up; sorting finds the arrays as runs."""
    all_grams, counts = np.concatenate(grams), np.concatenate(n)
    order = np.argsort(all_grams, kind="stable")
    in_order = all_grams[order]
    firsts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    return in_order[firsts], np.add.reduceat(counts[order], firsts)


def _totals(segments: int):
    """(gram, n) of all n-grams of a segment at once, from counted n-grams that come segment by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, n, size = None, [], [], 0

        def out():
            distinct, counts = _merged(grams, n)
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(counts)], ["gram", "n"])

        for batch in batches:
            for segment, packed, small, large in zip(*(batch.column(c).to_pylist() for c in ("segment", "grams", "small", "large"))):
                if segment != now:
                    if grams:
                        yield out()
                    now, grams, n, size = segment, [], [], 0
                counts = np.frombuffer(small, dtype=np.uint8).astype(np.int64)
                counts[counts == 255] = np.frombuffer(large, dtype="<i8")
                grams.append(unpacked(segment, packed, segments))
                n.append(counts)
                size += len(counts)
                if size > SUMMED:
                    grams, n = ([x] for x in _merged(grams, n))
                    size = 0
        if grams:
            yield out()

    return run


def bit_places(grams: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """Three places in a segment of ``bits`` (a power of two, 2^21 at most) for a level of each n-gram."""
    g = mixed_bits(grams + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    mask = np.uint64(bits - 1)
    return [g & mask, (g >> np.uint64(21)) & mask, (g >> np.uint64(42)) & mask]


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def _segments(bits: int, segments: int = SEGMENTS, in_order: bool = False):
    """Bits of each segment that comes in as (gram, n), as (segment, bytes); segments ``in_order`` are given out one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}

        def out(done):
            for s in done:
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(found.pop(s), bitorder="little").tobytes()])], ["segment", "bits"])

        for batch in batches:
            grams = batch.column("gram").to_numpy().view(np.uint64)
            level = levels(batch.column("n").to_numpy())
            segment = segment_of(grams, segments)
            for s in np.unique(segment):
                if in_order:
                    yield from out([x for x in found if x != s])
                here = found.setdefault(int(s), np.zeros(bits, dtype=bool))
                own, tops = grams[segment == s], level[segment == s]
                for j in range(1, int(tops.max()) + 1):
                    for place in bit_places(own[tops >= j], j, bits):
                        here[place] = True
        yield from out(list(found))

    return run


class Filter:
    """A finished filter, or some of its segments; ``top`` is the largest level stored, ``kept`` the bits of an n-gram that count."""

    def __init__(self, table: np.ndarray, bits: int, segments: int = SEGMENTS, top: int = 63, kept: int = 64) -> None:
        self.table, self.bits, self.segments, self.top, self.kept = table, bits, segments, top, kept

    def level(self, grams: np.ndarray) -> np.ndarray:
        """Quantised count of each n-gram, 0 for those not held."""
        distinct, back = np.unique(shortened(grams, self.kept), return_inverse=True)
        return self.each(distinct)[back]

    def each(self, distinct: np.ndarray) -> np.ndarray:
        """The same of n-grams that are shortened, and hardly ever repeated."""
        out = np.zeros(len(distinct), dtype=np.int64)
        alive, base = np.arange(len(distinct)), segment_of(distinct, self.segments).astype(np.uint64) * np.uint64(self.bits // 8)
        level = 1
        while len(alive) and level <= self.top:
            hit = np.arange(len(alive))
            for place in bit_places(distinct[alive], level, self.bits):
                p = place[hit]
                byte = self.table[base[alive[hit]] + (p >> np.uint64(3))]
                hit = hit[(byte >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            alive = alive[hit]
            out[alive] = level
            level += 1
        return out


class Places:
    """Places of hashes among ``keys``, which are hashes in order: their leading bits tell about where."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.shift = keys, np.uint64(64 - max(1, len(keys).bit_length()))
        sizes = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << 64 - int(self.shift))
        self.first = (np.cumsum(sizes) - sizes).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The first place whose key is no smaller, and the last place where all are; there must be keys."""
        last = len(self.keys) - 1
        at = np.minimum(self.first[(hashes >> self.shift).astype(np.int64)], last)
        behind = np.flatnonzero(self.keys[at] < hashes)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < hashes[behind]]
        return at


class Found:
    """Levels that were looked up before, by n-gram: shortened, in order."""

    def __init__(self, grams: np.ndarray, level: np.ndarray, kept: int) -> None:
        self.places, self.found, self.kept = Places(grams), level, kept

    def level(self, grams: np.ndarray) -> np.ndarray:
        return self.found[self.places.of(shortened(grams, self.kept))].astype(np.int64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their piece of about ``PIECE_BYTES``, unlike in all tasks, and their place in the task."""
    first, size, rows = TaskContext.get().partitionId() << 33, 0, 0
    for batch in batches:
        ends = size + np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = pa.array(np.arange(rows, rows + batch.num_rows))
        yield batch.append_column("piece", pa.array(first + ends // PIECE_BYTES)).append_column("at", at)
        size, rows = int(ends[-1]) if len(ends) else size, rows + batch.num_rows


def _distinct(values: np.ndarray) -> np.ndarray:
    """Different values in order, by sorting."""
    in_order = np.sort(values)
    return in_order[np.concatenate([[True], in_order[1:] != in_order[:-1]])] if len(in_order) else in_order


def _grams(sequences: list[tuple[int, np.ndarray, np.ndarray]], kept: int) -> np.ndarray:
    """Distinct n-grams of sequences of words, shortened, in order."""
    parts = [shortened(np.concatenate([word_gram(_distinct(w)), _distinct(pair_gram(_before(w, starts), w))]), kept) for _, w, starts in sequences]
    return _distinct(np.concatenate(parts))


def _asked(segments: int):
    """The n-grams of each stretch of rows of a piece, packed by segment; ``at`` is the stretch's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kept = PackedHasher(), kept_bits(segments)
        for batch in batches:
            for piece, part in _by(batch, "piece"):
                segment, _, packed = packed_by_segment(_grams(list(_sequences(part, hasher)), kept), segments)
                at = part.column("at")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(segment), *(pa.array(np.full(len(packed), x, dtype=np.int64)) for x in (piece, at)), pa.array(packed, pa.binary())], ["segment", "piece", "at", "grams"])

    return run


def _by(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of a batch with one value of a column."""
    values = batch.column(name).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(values[a]), batch.slice(a, b - a)


def _probed(bits: int, segments: int, top: int):
    """Levels of the n-grams that come behind the bits of their segment, in their order, as (piece, at, segment, levels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for batch in batches:
            for segment, part in _by(batch, "segment"):
                if segment != now:
                    now, table = segment, np.zeros(bits // 8, dtype=np.uint8)
                of_bits = pc.is_valid(part.column("bits"))
                for x in part.column("bits").filter(of_bits):
                    table = np.frombuffer(x.as_py(), dtype=np.uint8)
                asked = part.filter(pc.invert(of_bits))
                for i in range(0, asked.num_rows, 1_000):
                    some = asked.slice(i, 1_000)
                    packed = some.column("grams").to_pylist()
                    level = Filter(table, bits, 1, top).each(unpacked(segment, b"".join(packed), segments)).astype(np.uint8)
                    cuts = np.cumsum([0, *(len(x) // 4 for x in packed)])
                    own = pa.array([level[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column("piece"), some.column("at"), some.column("segment"), own], ["piece", "at", "segment", "levels"])

    return run


def _stretches(texts: pa.Table, found: pa.Table, kept: int) -> Iterator[tuple[pa.RecordBatch, list, Found]]:
    """Each stretch of a piece's rows, its sequences, and the levels of its n-grams, which are in order by stretch and segment."""
    rows = texts.sort_by("at").combine_chunks().to_batches()[0]
    levels: dict[int, list[bytes]] = {}
    found = found.sort_by([("at", "ascending"), ("segment", "ascending")])
    for at, x in zip(found.column("at").to_pylist(), found.column("levels").to_pylist()):
        levels.setdefault(at, []).append(x)
    firsts = np.searchsorted(rows.column("at").to_numpy(), [*levels, np.iinfo(np.int64).max])
    for i, j, own in zip(firsts, firsts[1:], levels.values()):
        part = rows.slice(i, j - i)
        sequences = list(_sequences(part, PackedHasher()))
        yield part, sequences, Found(_grams(sequences, kept), np.frombuffer(b"".join(own), dtype=np.uint8), kept)


def expected(level: np.ndarray) -> np.ndarray:
    """Count in the middle of a level; 0 for level 0."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def score_tokens(model: Filter, words: np.ndarray, starts: np.ndarray, total: int, distinct: int, weight: float) -> np.ndarray:
    """log10 probability of each word after the one before it, smoothed towards that of the word alone."""
    counts = expected(model.level(word_gram(words)))
    alone = (counts + 0.1) / (total + 0.1 * (distinct + 1))
    # the last word of a text is its end, so the count of an end stands at the end of the piece
    of_first = np.append(counts[-1:], counts[:-1])
    of_first[starts] = counts[-1]
    of_pair = np.minimum(expected(model.level(pair_gram(_before(words, starts), words))), of_first)
    return np.log10((of_pair + weight * np.minimum(alone, 1.0)) / (of_first + weight))


def score_documents(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", weight: float = 20.0) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words are those of the A-Z lower-cased text, with one end behind them that
    counts as a token.  ``training`` marks the rows to learn from.  base_score
    is the unigram score over exact counts; score is the filter's model.  Null
    texts are empty and have their end alone.  Without training rows all counts
    are 0.  Repeated rows count and are scored each; other columns are ignored.
    A very long text is scored whole by one task, with some ten numbers a word.
    ``docs`` is read several times: it must give the same rows each time, as a
    written table does.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), training.alias("trained"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learnt = rows.where("trained").select("text")

    words = materialize(learnt.mapInArrow(tidied(_words), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "words")
    by_level = words.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.sum("n").alias("total"), F.count("*").alias("words")).collect()
    total, distinct = sum(r["total"] for r in by_level), sum(r["words"] for r in by_level)

    # a pair sets no more levels than it has tokens
    bits, segments = filter_size(total + sum(r["words"] * (r["level"] + 1) for r in by_level))
    top = max((r["level"] + 1 for r in by_level), default=0)  # no pair is more frequent than its words
    whole = bits * segments <= BROADCAST_BITS
    kept = kept_bits(segments)
    counted = learnt.mapInArrow(tidied(_pairs(segments)), COUNTED).unionByName(words.mapInArrow(tidied(_keyed(segments)), COUNTED))
    summed = counted.repartition("segment").sortWithinPartitions("segment").mapInArrow(tidied(_totals(segments)), "gram long, n long")
    made = summed.mapInArrow(tidied(_segments(bits, segments, True)), "segment long, bits binary")
    table = None
    if whole:
        table = np.zeros(segments * bits // 8, dtype=np.uint8)
        for batch in made.toArrow().to_batches():
            for number, packed in zip(batch.column("segment").to_pylist(), batch.column("bits")):
                at = number * (bits // 8)
                table[at : at + bits // 8] = np.frombuffer(packed.as_buffer(), dtype=np.uint8)

    least, room = 1 << 62, BROADCAST_WORDS
    for r in sorted(by_level, key=lambda r: -r["level"]):
        if r["words"] > room:
            break
        room -= r["words"]
        least = 1 << r["level"]
    frequent = words.where(F.col("n") >= least).toArrow()  # as arrays: rows would take many times the memory
    known, counts = frequent.column("gram").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    by_hash = np.argsort(known)
    exact = known[by_hash], counts[by_hash]
    all_exact = len(exact[0]) == distinct
    model = spark.sparkContext.broadcast((table, exact))

    def scores(stretches: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Scores of rows that come with their sequences and what to probe for them."""
        grams, counts = model.value[1]
        places = Places(grams)
        logs, unknown = np.log10(counts + 0.1), np.log10(0.1) if all_exact else 0.0
        for batch, sequences, probe in stretches:
            for first, w, starts in sequences:
                ends = np.append(starts, len(w))
                score = np.add.reduceat(score_tokens(probe, w, starts, total, distinct, weight), starts)
                signed = w.view(np.int64)
                if len(grams):
                    at = places.of(w)
                    held = grams[at] == w
                    part = np.where(held, logs[at], unknown)
                else:
                    held, part = np.zeros(len(w), dtype=bool), np.full(len(w), unknown)
                rest = pa.array([None if all_exact else signed[a:b][~held[a:b]] for a, b in zip(ends, ends[1:])], pa.list_(pa.int64()))
                own = batch.slice(first, len(starts))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("trained"), pa.array(np.diff(ends)), pa.array(np.add.reduceat(held.astype(np.int64), starts)), pa.array(np.add.reduceat(part, starts)), pa.array(score), rest],
                    ["doc_id", "trained", "n_tokens", "n_known", "part", "score", "rest"],
                )

    schema = "doc_id long, trained boolean, n_tokens long, n_known long, part double, score double, rest array<long>"
    if whole:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, probe = PackedHasher(), Filter(model.value[0], bits, segments, top, kept)
            return scores((batch, _sequences(batch, hasher), probe) for batch in batches)

        scored = rows.mapInArrow(tidied(run), schema)
    else:

        def of_piece(texts: pa.Table, found: pa.Table) -> pa.Table:
            try:
                return pa.Table.from_batches(scores(_stretches(texts, found, kept)))
            finally:
                give_back()

        # one shuffle serves the questions and the scores; sorted rows give a task that is run again the same pieces
        in_order = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
        pieces = in_order.mapInArrow(_numbered, "doc_id long, trained boolean, text string, piece long, at long").repartition("piece")
        asked = pieces.sortWithinPartitions("piece", "at").mapInArrow(tidied(_asked(segments)), "segment long, piece long, at long, grams binary")
        met = made.unionByName(asked, allowMissingColumns=True).repartition("segment").sortWithinPartitions("segment", F.isnull("bits"))
        found = met.mapInArrow(tidied(_probed(bits, segments, top)), "piece long, at long, segment long, levels binary")
        scored = pieces.groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(of_piece, schema)
    if not all_exact:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        rare = words.where(F.col("n") < least)
        one = F.log10(F.coalesce("n", F.lit(0)) + 0.1)
        looked_up = (
            scored.select("row", F.explode("rest").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("times"))
            .join(rare, "gram", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * one).alias("rest_part"))
        )
        scored = scored.drop("rest").join(looked_up, "row", "left")
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("part", F.col("part") + F.coalesce("rest_part", F.lit(0.0)))
    base = F.col("part") - F.col("n_tokens") * F.lit(float(np.log10(total + 0.1 * (distinct + 1))))
    return scored.select("doc_id", "trained", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held_out(key: Column, modulus: int = 10) -> Column:
    """Rows whose id's crc32 leaves no remainder."""
    return doc_remainder(key, modulus) == 0
