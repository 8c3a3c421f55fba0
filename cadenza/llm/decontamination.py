"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned for in every document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import distinct_texts, table, text_key, written

WINDOW = 10
#: Bytes of benchmark text that one broadcast index may hold. A larger benchmark is scanned for in several parts.
PART_BYTES = 16 << 20
_BITS = 20


class Index:
    """Windows of some benchmark items as flat arrays: sorted hashes, each window's place in one byte buffer, and its items.

    Windows of one size with the same hash and the same words are one entry; equal hashes of different words are neighbours.
    A part takes about five times its bytes, and some nine times as much again while it is built.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.ids)}
        data, offsets = T.buffers(pa.array([text or "" for _, text in items], pa.large_string()))
        self.data = T.LOWER_AZ[data]
        starts, ends, first = T.words(self.data, offsets, T.WORD_ALNUM)
        owner = np.array([-1 if i is None else number[str(i)] for i, _ in items], np.int32)
        hashed = T.steps(T.spans_hashed(self.data, starts, ends))
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        n = np.diff(first)
        self.sizes: dict[int, tuple[np.ndarray, ...]] = {}
        for size in np.unique(np.minimum(n[n > 0], window)).tolist():
            which = np.flatnonzero(np.minimum(n, window) == size)
            at = T.ranges(first[which], n[which] - size + 1)
            item = np.repeat(owner[which], n[which] - size + 1)
            hashes = hashed.of(at, at + size)
            order = np.argsort(hashes, kind="stable")
            hashes, at, item = hashes[order], at[order], item[order]
            entry = np.ones(len(hashes), bool)
            again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
            entry[again] = [self._spelled(a, size) != self._spelled(b, size) for a, b in zip(at[again - 1].tolist(), at[again].tolist(), strict=True)]
            place = np.flatnonzero(entry)
            self.sizes[size] = (hashes[place], at[place].astype(np.int32), np.append(place, len(hashes)).astype(np.int32), item)

    def _spelled(self, at: int, size: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist(), strict=True)]

    def candidates(self, size: int, hashes: np.ndarray) -> np.ndarray:
        own = self.sizes[size][0]
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(own >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        at = np.flatnonzero(bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        near = np.minimum(np.searchsorted(own, hashes[at]), len(own) - 1)
        return at[own[near] == hashes[at]]

    def items(self, size: int, h: np.uint64, spelled: list[bytes]) -> np.ndarray | None:
        """Items of the window with these words (-1: one without an id); None if there is none."""
        hashes, at, place, item = self.sizes[size]
        k, found = int(np.searchsorted(hashes, h)), []
        while k < len(hashes) and hashes[k] == h:
            if self._spelled(int(at[k]), size) == spelled:
                found.append(item[place[k] : place[k + 1]])
            k += 1
        return np.concatenate(found) if found else None


def find(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[int]]]:
    """(word starts, word ends, first word of each text, hit words, items by text), every hit checked word by word."""
    data = T.LOWER_AZ[data]
    starts, ends, first = T.words(data, offsets, T.WORD_ALNUM)
    hit = np.zeros(len(starts), bool)
    items: dict[int, set[int]] = {}
    if len(starts):
        rolling = T.steps(T.spans_hashed(data, starts, ends))
        for size in index.sizes:
            hashes = rolling.windows(size)
            for at in index.candidates(size, hashes).tolist():
                text = int(np.searchsorted(first, at, side="right")) - 1
                if at + size > first[text + 1]:
                    continue
                spelled = [data[a:b].tobytes() for a, b in zip(starts[at : at + size].tolist(), ends[at : at + size].tolist(), strict=True)]
                owners = index.items(size, hashes[at], spelled)
                if owners is not None:
                    hit[at : at + size] = True
                    items.setdefault(text, set()).update(k for k in np.unique(owners).tolist() if k >= 0)
    return starts, ends, first, hit, items


def _parts(benchmark: DataFrame) -> list[list[tuple]]:
    """The items in parts of at most PART_BYTES (one longer item stands alone); each part is collected by itself."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // PART_BYTES))
    if n == 1:
        return [lambda: [tuple(r) for r in rows.collect()]]
    dealt = written(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))
    return [lambda k=k: [tuple(r) for r in dealt.where(F.col("part") == k).select("item_id", "text").collect()] for k in range(n)]


def _scan(broadcast, yield_from):
    def run(batches):
        index = broadcast.value
        for whole in batches:
            for batch in T.slices(whole, "text"):
                yield from yield_from(index, batch)

    return run


def _digest_rows(keep: list[str]):
    def rows(index: Index, batch: pa.RecordBatch):
        _, _, first, hit, items = find(index, *T.buffers(batch.column(batch.schema.get_field_index("text"))))
        hits = np.concatenate([[0], np.cumsum(hit)])
        names = [sorted(index.ids[k] for k in items.get(i, ())) for i in range(batch.num_rows)]
        n_hit = np.diff(hits[first])
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(c)) for c in keep]
            + [pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0)],
            names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return rows


def _hit_rows(index: Index, batch: pa.RecordBatch):
    _, _, first, hit, items = find(index, *T.buffers(batch.column(batch.schema.get_field_index("text"))))
    for i in sorted(items):
        words = np.flatnonzero(hit[first[i] : first[i + 1]]).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([words], pa.list_(pa.int64())), pa.array([sorted(index.ids[k] for k in items[i])])], names=["key_a", "key_b", "words", "items"])


def _count_words(batches):
    for whole in batches:
        for batch in T.slices(whole, "text"):
            data, offsets = T.buffers(batch.column(batch.schema.get_field_index("text")))
            _, _, first = T.words(data, offsets, T.WORD_ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first))], names=["key_a", "key_b", "n_words"])


def _in_parts(texts: DataFrame, parts: list, window: int) -> DataFrame:
    """(key_a, key_b, words, items) of texts with hits, one scan for each part of the benchmark."""
    context = texts.sparkSession.sparkContext
    found = None
    for part in parts:
        scanned = written(texts.mapInArrow(_scan(context.broadcast(Index(part(), window)), _hit_rows), "key_a long, key_b long, words array<long>, items array<string>"))
        found = scanned if found is None else found.unionByName(scanned)
    return found.groupBy("key_a", "key_b").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case. Null texts have none, so a
    null item hits nothing; an item without an id hits words and counts as no item; items of one id count once. Repeated rows each
    give a row; an empty table gives none, an empty benchmark no hit. Other columns don't matter.
    """
    parts = _parts(benchmark)
    if len(parts) == 1:
        index = docs.sparkSession.sparkContext.broadcast(Index(parts[0](), window))
        return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            _scan(index, _digest_rows(["doc_id"])), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
        )
    texts = distinct_texts(docs)
    hits = _in_parts(texts, parts, window)
    by_text = texts.mapInArrow(_count_words, "key_a long, key_b long, n_words long").join(hits, ["key_a", "key_b"], "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("words"), F.lit(0)).cast("long")
    by_text = by_text.select("key_a", "key_b", "n_words", F.when(F.col("words").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), F.col("words").isNotNull().alias("contaminated"))
    return docs.select("doc_id", *text_key()).join(by_text, ["key_a", "key_b"]).drop("key_a", "key_b")


def _cut(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hit: np.ndarray, which) -> pa.Array:
    """The texts, those of the numbers `which` without their runs of hit words."""
    kept = texts.to_pylist()
    for i in which:
        gone = np.zeros(offsets[i + 1] - offsets[i], bool)
        own = hit[first[i] : first[i + 1]]
        begin = np.flatnonzero(own & ~np.concatenate([[False], own[:-1]])) + first[i]
        stop = np.flatnonzero(own & ~np.concatenate([own[1:], [False]])) + first[i]
        for a, b in zip(starts[begin] - offsets[i], ends[stop] - offsets[i], strict=True):
            gone[a:b] = True
        kept[i] = data[offsets[i] : offsets[i + 1]][~gone].tobytes().decode("utf-8", "replace")
    return pa.array(kept, texts.type)


def _clean_rows(index: Index, batch: pa.RecordBatch):
    place = batch.schema.get_field_index("text")
    texts = batch.column(place)
    data, offsets = T.buffers(texts)
    starts, ends, first, hit, items = find(index, data, offsets)
    if not items:
        yield batch
        return
    yield batch.set_column(place, batch.schema.field(place), _cut(texts, data, offsets, starts, ends, first, hit, items))


def _cut_known(text: str, drop_over: float):
    """mapInArrow: the batch without its last column, the numbers of each text's hit words (null: none), which are cut out."""

    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, text):
                words = batch.column(batch.num_columns - 1)
                batch = batch.select(batch.schema.names[:-1])
                which = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False)).tolist()
                if not which:
                    yield batch
                    continue
                place = batch.schema.get_field_index(text)
                texts = batch.column(place)
                data, offsets = T.buffers(texts)
                starts, ends, first = T.words(data, offsets, T.WORD_ALNUM)
                hit = np.zeros(len(starts), bool)
                for i in which:
                    hit[first[i] + np.array(words[i].as_py(), np.int64)] = True
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
                batch = batch.set_column(place, batch.schema.field(place), _cut(texts, data, offsets, starts, ends, first, hit, which))
                yield batch.filter(pa.array(n_hit <= np.diff(first) * drop_over))

    return run


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_over: float = 1.1) -> DataFrame:
    """docs with the spans of hit words cut out of `text` and n_chars anew; documents of which more than the share `drop_over`
    of the words was hit go (by default none does).

    A benchmark beyond PART_BYTES is scanned for part by part, each time in the texts as they came; a text is judged and cut once,
    by the hit words of all parts.
    """
    parts = _parts(benchmark)
    if len(parts) == 1:
        out = docs
        index = docs.sparkSession.sparkContext.broadcast(Index(parts[0](), window))
        if drop_over <= 1:
            keyed = out.withColumn("_row", F.struct(*out.columns)).select("_row", F.coalesce("text", F.lit("")).alias("text"))
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:1])
            judged = keyed.mapInArrow(_scan(index, _digest_rows(["_row"])), f"{kinds}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
            out = judged.where(F.col("n_hit") <= F.col("n_words") * drop_over).select("_row.*")
        out = out.mapInArrow(_scan(index, _clean_rows), out.schema)
    else:
        names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
        # written, so that both sides of the join come straight from a shuffle and Spark can split a text with many copies
        hits = written(_in_parts(written(distinct_texts(docs).drop("copies")), parts, window).select("key_a", "key_b", "words"))
        plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        joined = plain.withColumns(dict(zip(("key_a", "key_b"), text_key(names["text"]), strict=True))).join(hits, ["key_a", "key_b"], "left")
        cut = joined.select(*names.values(), "words").mapInArrow(_cut_known(names["text"], drop_over), plain.schema)
        out = cut.select(*[F.col(n).alias(c) for c, n in names.items()])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, those in windows of ten words of a benchmark item, and the items.

    Null and empty texts and items have no words; repeated rows each give a row; an empty table gives none, an empty benchmark no hit.
    """
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
