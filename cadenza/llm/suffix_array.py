"""Repeated byte strings, found by a threshold-bounded expansion of BWT intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import bucketed, distinct_texts, joined, numbered, table, text_key, written
from cadenza.llm._repeats import repeated_spans, stretches

SIZE = 400
#: Bytes that every passage of over 50 words reaches: prose takes four and more a word, with its space.
PASSAGE = 200
GRAM = 64
END = 0xFF  # ends a segment; never part of UTF-8


FIRST = 8  # bytes that one integer sorts by


def seed(depth: int) -> int:
    """Bytes of the strings whose intervals the expansion to `depth` starts from: FIRST times a power of two, two thirds of the depth at most
    (256 for 400, 128 for 200). The sort by doubling passes them on its way, at no cost."""
    reach = FIRST
    while 3 * reach <= depth:
        reach *= 2
    return reach


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes sorted by their first `depth` bytes at least, flags of rows that differ from the row before in the first seed(depth)).

    Eight bytes are compared as one integer; ranks of what still ties are then doubled in reach.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(FIRST, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(FIRST):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    short = fresh.copy()
    rows = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, rows, 0))
    reach = FIRST
    while reach < depth:
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        suffix = order[at]
        later = suffix + reach
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        pair = (rank[suffix].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(pair)
        suffix, pair = suffix[by], pair[by]
        order[at] = suffix
        fresh[at[1:]] |= pair[1:] != pair[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        reach *= 2
        if reach <= seed(depth):
            short = fresh.copy()
    return order, short


def common_prefix_at_least(data: np.ndarray, order: np.ndarray, short: np.ndarray, least: int) -> np.ndarray:
    """For each row of the suffix order, whether it shares its first `least` bytes (eight or more) with the row before.

    Breadth-first backward extension. The search starts with the intervals of all strings of seed(least) bytes, whose ends are
    the rows in `short`. An interval of length l is extended to the left by every byte that the transform holds in it. If the
    end of the interval of length l + 1 that this gives is not known yet, the common prefix there is l, and the interval is
    extended further; else it is left. So common prefixes come in increasing order, and all rounds together handle each
    end once. Ends that are still unknown when the length reaches `least` share at least that much.
    """
    n = len(data)
    bwt = data[order - 1]
    back = np.empty(n, np.int32)  # row of the suffix that is one byte longer
    back[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    known = np.append(short, True)
    low = np.flatnonzero(short).astype(np.int32)
    high = np.append(low[1:], n).astype(np.int32)
    owner_at = np.full(n, -1, np.int32)
    run = np.cumsum(np.append(True, bwt[1:] != bwt[:-1]), dtype=np.int32)
    for _ in range(seed(least), least):
        mixed = run[low] != run[high - 1]  # else one byte stands before all of the interval
        to, end = back[low[~mixed]], back[high[~mixed] - 1] + 1
        new = ~known[end]
        lows, highs = [to[new]], [end[new]]
        if mixed.any():
            low, high = low[mixed], high[mixed]
            lengths = high - low
            rows = T.ranges(low, lengths)
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            to = back[rows]
            if len(to) > n >> 5:
                owner_at[to] = owner
                to = np.flatnonzero(owner_at >= 0).astype(np.int32)
                owner = owner_at[to]
                owner_at[to] = -1
            else:
                by = np.argsort(to)
                to, owner = to[by], owner[by]
            # a new interval where the owner or the prefixed byte changes; other rows of an interval are neighbours
            cut = np.ones(len(to), bool)
            cut[1:] = (owner[1:] != owner[:-1]) | (to[1:] != to[:-1] + 1)
            cut[1:] |= data[order[to[1:]]] != data[order[to[:-1]]]
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(to)) - 1
            new = ~known[to[last] + 1]
            lows.append(to[first[new]])
            highs.append(to[last[new]] + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        if not len(low):
            break
        known[high] = True
    return ~known[:n]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Flags of the window starts in `data` whose `size` bytes start at another place as well (or whose segment has copies).

    Only stretches that may repeat are sorted, one of each content; a content at two places repeats throughout.
    """
    flags = np.zeros(len(data), bool)
    found = stretches(data, offsets, weights, size)
    if found is None:
        return flags
    first, last, one, which, weight = found
    length = (last - first)[one]
    base = np.cumsum(length + 1) - (length + 1)
    body = np.full(int((length + 1).sum()), END, np.uint8)
    body[T.ranges(base, length)] = data[T.ranges(first[one], length)]
    order, short = suffix_order(body, size)
    alike = common_prefix_at_least(body, order, short, size)
    shared = np.zeros(len(body), bool)
    shared[order[alike]] = True
    shared[order[np.flatnonzero(alike) - 1]] = True
    n = last - first - size + 1
    flags[T.ranges(first, n)] = shared[T.ranges(base[which], n)] | np.repeat(weight[which] > 1, n)
    return flags


def repeated_byte_spans(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(key_a, key_b, spans) of distinct texts: runs of starts, in bytes, of strings of `size` bytes that occur twice."""
    return repeated_spans(texts, repeated_windows, size=size, gram=min(GRAM, max(1, size // 4)), words=False)


def removed_bytes(spans: pa.StructArray, size: int, total: int) -> np.ndarray:
    return T.covered(spans.field("start").to_numpy(), spans.field("length").to_numpy() + size - 1, total)


def _digest(size: int, passage: int):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"]

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, at = T.buffers(batch.column(batch.schema.get_field_index("text")))
                spans, short = (batch.column(batch.schema.get_field_index(c)) for c in ("spans", "short"))
                removed, runs, sha, repeated = [], [], [], []
                for i in range(batch.num_rows):
                    text = data[at[i] : at[i + 1]]
                    repeated.append(int(removed_bytes(short[i].values, passage, len(text)).sum()) if short[i].is_valid else 0)
                    if spans[i].is_valid:
                        gone = removed_bytes(spans[i].values, size, len(text))
                        removed.append(int(gone.sum()))
                        runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                        text = text[~gone]
                    else:
                        removed.append(0)
                        runs.append(0)
                    sha.append(hashlib.sha256(text.tobytes()).hexdigest())
                counts = [pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(repeated, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=["key_a", "key_b", *names])

    return run


def digests(docs: DataFrame, size: int = SIZE, passage: int = PASSAGE) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage (bytes in strings of `passage` bytes that occur twice,
    which stay).

    A string of `size` bytes that repeats holds size - passage + 1 of `passage` bytes that do, so only texts with as many of these are
    looked through again. A null text counts as empty; repeated rows of one doc_id each give a row and count as places; an empty table gives
    none. Very long texts are looked at in overlapping pieces, whole. Other columns don't matter.
    """
    keys = ["key_a", "key_b"]
    passage = min(passage, size)
    texts = bucketed(distinct_texts(docs), *keys)
    short = written(repeated_byte_spans(texts, passage))
    windows = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    long = written(short.where(windows > size - passage).select(*keys))
    spans = written(repeated_byte_spans(joined(texts, long, keys), size))
    found = joined(joined(texts, spans, keys, "left"), short.withColumnRenamed("spans", "short"), keys, "left")
    fields = "key_a long, key_b long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long"
    by_text = found.mapInArrow(_digest(size, passage), fields)
    return joined(docs.select("doc_id", *text_key()), by_text, keys).drop(*keys)


def _whole_characters(gone: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keeps a character of which any byte stays."""
    head = (text & 0xC0) != 0x80
    if head.all() or not gone.any():
        return gone
    character = np.cumsum(head) - 1
    whole = np.ones(int(character[-1]) + 1, bool)
    np.logical_and.at(whole, character, gone)
    return whole[character]


def _kept(size: int):
    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, at = T.buffers(batch.column(batch.schema.get_field_index("text")))
                spans = batch.column(batch.schema.get_field_index("spans"))
                kept = []
                for i in range(batch.num_rows):
                    text = data[at[i] : at[i + 1]]
                    if spans[i].is_valid:
                        text = text[~_whole_characters(removed_bytes(spans[i].values, size, len(text)), text)]
                    kept.append(text.tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], names=["key_a", "key_b", "kept"])

    return run


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with `text` freed of every repeated string of `size` bytes (characters cut by a span's end stay whole), n_chars anew.

    Null texts stay null; rows, other columns and their order stay.
    """
    texts = bucketed(distinct_texts(docs), "key_a", "key_b")
    hit = joined(texts, repeated_byte_spans(texts, size), ["key_a", "key_b"]).mapInArrow(_kept(size), "key_a long, key_b long, kept string")
    plain, names = numbered(docs)
    out = joined(plain.select("*", *text_key(names["text"])), hit, ["key_a", "key_b"], "left")
    text = F.col(names["text"])
    fresh = {"text": F.when(text.isNotNull(), F.coalesce("kept", text))}
    if "n_chars" in names:
        n = F.col(names["n_chars"])
        fresh["n_chars"] = F.when(F.col("kept").isNotNull(), F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(n)
    return out.select(*[fresh.get(c, F.col(n)).alias(c) for c, n in names.items()])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes, those in strings of 400 bytes that occur twice, their runs, a digest of the rest, and the bytes in strings of
    200 that occur twice.

    Null texts count as empty; repeated rows each give a row and count as places; an empty table gives none.
    """
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
