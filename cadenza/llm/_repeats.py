"""Repeated windows of a fixed size, found across all texts.

A window is `size` neighbouring units (words or bytes) of one text. The windows that
occur more than once anywhere are wanted, without shuffling every window:

1. Each window gets an anchor, the smallest hashed `gram`-unit slice inside it. It depends on the
   window's content alone, so equal windows have equal anchors. Neighbouring windows with one
   anchor form a segment; every window lies in exactly one segment.
2. Spark counts anchors. Those of one segment that doesn't repeat itself hold no repeat and go, which is most of the text. What is
   left is counted by (anchor, digest of the segment's bytes).
3. One copy of each remaining segment's units is dealt to reference shards by its anchor, so
   all places of a window meet in one shard. A kernel (a suffix automaton, or a Burrows-Wheeler
   transform) finds which windows of the shard occur twice, counting copies.
4. Shards' answers go back to every place of the segment, and each text joins its spans.

Anchors with more than `most` different segments are hot: they would overload one shard. Their
windows are counted one by one under 128-bit digests instead, which spreads them evenly at any size.

Rolling hashes choose anchors and leave out windows that can't repeat; that two things are equal is decided by their bytes, or by 128 bits
of a cryptographic digest of them where they lie in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import drop, joined, written

#: (segments' units end to end, segment offsets, weights, window size) -> repeated windows, a flag at each window start
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]

SALTS = 16
SHARD_BYTES = 1 << 20


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


class Units:
    """A batch's texts as units: bytes, or words by a hash that serves to choose anchors (values); `at` are the offsets of texts. raw are the bytes themselves,
    a word with a space behind it, and place where each unit begins there (None: units are bytes)."""

    def __init__(self, batch: pa.RecordBatch, words: bool):
        data, offsets = T.buffers(batch.column(batch.schema.get_field_index("text")))
        self.values = self.raw = data
        self.at, self.place = offsets, None
        if words:
            starts, ends, self.at = T.words(data, offsets, T.WORD_UNCHANGED)
            self.raw, self.place = T.spelled(data, starts, ends)
            self.values = T.spans_hashed(data, starts, ends)

    def bounds(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in raw the units [begin, end) are."""
        return (begin, end) if self.place is None else (self.place[begin], self.place[end])


#: Units of a very long text that are looked at together; pieces overlap by a window less one unit.
PIECE = 1 << 20


def segments(size: int, gram: int, words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: texts to rows (key_a, key_b, start, n, anchor, seg, copies, own); n counts windows.

    own is 1 if two windows of the segment may be equal. Then the first slice with the anchor's hash lies in front of the later
    window, and the window behind that slice holds the hash again. Rolling hashes only choose anchors; seg is 128 bits of BLAKE2b of the
    segment's own bytes.
    """

    def rows(batch: pa.RecordBatch, units: Units, at: np.ndarray, low: int, high: int) -> pa.RecordBatch | None:
        slices = T.steps(units.values[low:high]).windows(gram)
        smallest = T.sliding_min(slices, size - gram + 1)
        again = np.zeros(len(smallest) + 1, np.int64)
        if len(smallest) > 1:
            np.cumsum((slices[: len(smallest) - 1] == smallest[:-1]) & (smallest[1:] == smallest[:-1]), out=again[1:-1])
            again[-1] = again[-2]
        lengths = np.maximum(0, np.diff(at) - size + 1)
        index = T.ranges(at[:-1], lengths)
        if not len(index):
            return None
        anchors = smallest[index]
        fresh = np.ones(len(index), bool)
        fresh[1:] = (anchors[1:] != anchors[:-1]) | (np.diff(index) != 1)
        first = np.flatnonzero(fresh)
        place = np.arange(len(index)) - np.repeat(first, np.diff(np.append(first, len(index))))
        first = np.flatnonzero(fresh | (place % (size - gram + 1) == 0))
        n = np.diff(np.append(first, len(index)))
        begin = index[first]
        text = np.repeat(np.arange(batch.num_rows), lengths)[first]
        pick = lambda name: batch.column(batch.schema.get_field_index(name)).take(pa.array(text))
        seg = T.digests(units.raw, *units.bounds(begin + low, begin + low + n + size - 1))
        seg = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(0, 16 * len(n) + 1, 16, dtype=np.int32)), pa.py_buffer(seg)])
        return pa.RecordBatch.from_arrays(
            [pick("key_a"), pick("key_b"), pa.array((begin - at[text] + low).astype(np.int32)), pa.array(n.astype(np.int32)), _long(anchors[first]), seg, pick("copies"), pa.array((again[begin + n] > again[begin]).astype(np.int64))],
            names=["key_a", "key_b", "start", "n", "anchor", "seg", "copies", "own"],
        )

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                units = Units(batch, words)
                total = len(units.values)
                step = total if batch.num_rows > 1 else PIECE  # only a text alone is longer than a slice
                for low in range(0, total, max(1, step)):
                    high = min(total, low + step + size - 1)
                    found = rows(batch, units, units.at if batch.num_rows > 1 else np.array([0, high - low]), low, high)
                    if found is not None:
                        yield found

    return run


def _contents(size: int, words: bool):
    """mapInArrow: texts with the segments asked of them to (anchor, seg, weight, n, units); units are bytes, words with a space behind each."""

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                units = Units(batch, words)
                asked = batch.column(batch.schema.get_field_index("asked"))
                text = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
                rows = asked.flatten()
                begin = units.at[text] + rows.field("start").to_numpy()
                lo, hi = units.bounds(begin, begin + rows.field("n").to_numpy() + size - 1)
                offsets = np.zeros(len(lo) + 1, np.int32)
                np.cumsum(hi - lo, out=offsets[1:])
                raw = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(units.raw[T.ranges(lo, hi - lo)]))])
                yield pa.RecordBatch.from_arrays([rows.field("anchor"), rows.field("seg"), rows.field("weight"), rows.field("n"), raw], names=["anchor", "seg", "weight", "n", "units"])

    return run


def _runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start in it, length) of the maximal runs of flags that stay in one segment."""
    edge = np.zeros(len(flags), bool)
    edge[offsets[:-1][offsets[:-1] < len(flags)]] = True
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | edge[1:]
    first = np.flatnonzero(begin)
    stop = flags.copy()
    stop[:-1] &= ~flags[1:] | edge[1:]
    last = np.flatnonzero(stop)
    segment = np.searchsorted(offsets, first, side="right") - 1
    return segment, first - offsets[segment], last - first + 1


def stretches(units: np.ndarray, offsets: np.ndarray, weights: np.ndarray, size: int):
    """What of a shard may repeat: (first, last, one, which, weight) or None.

    Windows whose rolling hash is alone (and whose segment has no copy) can't repeat. The others form stretches [first, last); `one` picks a
    stretch of each content, compared byte by byte, `which` tells each stretch's content, weight counts a content's places.
    """
    lengths = np.maximum(0, np.diff(offsets) - size + 1)
    starts = T.ranges(offsets[:-1], lengths)
    if not len(starts):
        return None
    weight = np.repeat(weights, lengths)
    rolling = T.steps(units)
    _, inverse, counts = np.unique(rolling.of(starts, starts + size), return_inverse=True, return_counts=True)
    maybe = (counts[inverse] > 1) | (weight > 1)
    if not maybe.any():
        return None
    apart = np.diff(starts) != 1
    begin = maybe.copy()
    begin[1:] &= ~maybe[:-1] | apart
    stop = maybe.copy()
    stop[:-1] &= ~maybe[1:] | apart
    at = np.flatnonzero(begin)
    first, last = starts[at], starts[np.flatnonzero(stop)] + size
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    which, _ = T.dictionary(units[T.ranges(first, last - first)], offsets)
    _, one = np.unique(which, return_index=True)
    return first, last, one, which, np.bincount(which, weight[at]).astype(np.int64)


def _shards(size: int, words: bool, kernel: Kernel):
    """mapInArrow over rows sorted by anchor: (anchor, seg, begin, length) of each segment's repeated windows."""

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        raw, offsets = T.buffers(table["units"].combine_chunks() if table["units"].num_chunks != 1 else table["units"].chunk(0))
        if words:  # words are numbered by spelling
            starts, ends, offsets = T.words(raw, offsets, T.WORD_UNCHANGED)
            raw, _ = T.dictionary(*T.spelled(raw, starts, ends))
        flags = kernel(raw, offsets, table["weight"].to_numpy(), size)
        segment, begin, length = _runs(flags, offsets)
        take = pa.array(segment)
        return pa.RecordBatch.from_arrays([table["anchor"].take(take).combine_chunks(), table["seg"].take(take).combine_chunks(), pa.array(begin.astype(np.int32)), pa.array(length.astype(np.int32))], names=["anchor", "seg", "begin", "length"])

    def solved(table: pa.Table, anchors: np.ndarray):
        """Shards of about SHARD_BYTES; an anchor's segments stay together."""
        sizes = np.cumsum(pc.binary_length(table["units"]).to_numpy().astype(np.int64))
        at = 0
        while at < len(anchors):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SHARD_BYTES)))
            to = int(np.searchsorted(anchors, anchors[min(to, len(anchors)) - 1], side="right"))
            yield solve(table.slice(at, to - at))
            at = to

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            anchors = table["anchor"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on in the next batch
            yield from solved(table.slice(0, cut), anchors[:cut])
            held = table.slice(cut).to_batches()
            T.give_back()
        if held:
            table = pa.Table.from_batches(held)
            yield from solved(table, table["anchor"].to_numpy())

    return run


def _each_window(size: int, words: bool):
    """mapInArrow: (anchor, seg, weight, begin, window) for every window of the given segments; window is 128 bits of BLAKE2b of its bytes."""

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "units"):
                raw, offsets = T.buffers(batch.column(batch.schema.get_field_index("units")))
                n = batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), n)
                begin = T.ranges(np.zeros(len(n), np.int64), n)
                if words:
                    starts, ends, first = T.words(raw, offsets, T.WORD_UNCHANGED)
                    lo, hi = starts[first[:-1][row] + begin], ends[first[:-1][row] + begin + size - 1]
                else:
                    lo = offsets[:-1][row] + begin
                    hi = lo + size
                take = pa.array(row)
                pick = [batch.column(batch.schema.get_field_index(x)).take(take) for x in ("anchor", "seg", "weight")]
                window = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.arange(0, 16 * len(lo) + 1, 16, dtype=np.int32)), pa.py_buffer(T.digests(raw, lo, hi))])
                yield pa.RecordBatch.from_arrays([*pick, pa.array(begin.astype(np.int32)), window], names=["anchor", "seg", "weight", "begin", "window"])

    return run


def _count_hot(hot: DataFrame, size: int, words: bool) -> DataFrame:
    """(anchor, seg, begin, length) of the repeated windows of hot segments (anchor, seg, weight, n, units).

    Each window stands in a row of its own under a cryptographic digest of 128 bits. Counts merge in the map tasks and the join back is a
    plain one of two written tables, which Spark splits where a window is very common; so no anchor overloads a task.
    """
    windows = written(hot.mapInArrow(_each_window(size, words), "anchor long, seg binary, weight long, begin int, window binary"))
    common = written(windows.groupBy("window").agg(F.sum("weight").alias("uses")).where("uses > 1").select("window"))
    return joined(windows, common, "window").select("anchor", "seg", "begin", F.lit(1).alias("length"))


def repeated_spans(texts: DataFrame, kernel: Kernel, *, size: int, gram: int, words: bool, most: int = 5000, kernel_on_copies: bool = False) -> DataFrame:
    """(key_a, key_b, spans array<struct<start,length>>) in units, for texts that hold a repeated window.

    texts: (key_a, key_b, text, copies), one row for each different text. kernel_on_copies: whether segments that have exact
    copies and no other neighbour go through the kernel as well; else equality settles them.
    """
    places = written(texts.mapInArrow(segments(size, gram, words), "key_a long, key_b long, start int, n int, anchor long, seg binary, copies long, own long"))
    place = F.xxhash64("key_a", "key_b", "start")
    repeated = written(places.groupBy("anchor").agg(F.sum(F.col("copies") + F.col("own")).alias("uses")).where("uses > 1").select("anchor"))
    candidates = written(joined(places, repeated, "anchor"))
    drop(places, repeated)
    kinds = candidates.groupBy("anchor", "seg").agg(F.sum("copies").alias("weight"), F.min(place).alias("first"))
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    salted = anchors.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    kinds = kinds.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALTS)).cast("int"))
    wanted = written(joined(kinds, salted, ["anchor", "salt"]).select("anchor", "seg", "weight", "first", "kinds"))
    flagged = written(joined(candidates.drop("copies", "own"), wanted, ["anchor", "seg"]))
    drop(candidates)
    alone = F.lit(False) if kernel_on_copies else (F.col("kinds") == 1) & (F.col("weight") > 1)
    whole = flagged.where(alone).select("key_a", "key_b", "start", F.col("n").alias("length"))
    rest = flagged.where(~alone)
    asked = (
        rest.where(F.col("first") == place)
        .groupBy("key_a", "key_b")
        .agg(F.collect_list(F.struct("start", "n", "anchor", "seg", "weight", "kinds")).alias("asked"))
    )
    fields = "anchor long, seg binary, weight long, n int, units binary"
    give = lambda keep: joined(texts, asked, ["key_a", "key_b"]).withColumn("asked", F.filter("asked", lambda x: keep(x["kinds"]))).where(F.size("asked") > 0).mapInArrow(_contents(size, words), fields)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = give(lambda kinds: kinds <= most).repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_shards(size, words, kernel), "anchor long, seg binary, begin int, length int")
    answers = cold
    if not wanted.where(F.col("kinds") > most).isEmpty():
        answers = cold.unionByName(_count_hot(give(lambda kinds: kinds > most), size, words))
    answers = written(answers)
    drop(wanted)
    found = joined(rest.select("key_a", "key_b", "start", "anchor", "seg"), answers, ["anchor", "seg"]).select("key_a", "key_b", (F.col("start") + F.col("begin")).alias("start"), "length")
    return whole.unionByName(found).groupBy("key_a", "key_b").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
