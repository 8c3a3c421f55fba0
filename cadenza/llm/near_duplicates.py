"""N-gram Jaccard join: texts whose sets of word 5-grams overlap by 0.8 or more, with Bayesian candidate pruning.

Each different text is a node. 32 bands of 4 MinHash values propose candidates: a pair at 0.8 shares none of them with
a probability of 5e-8. Texts are dealt into blocks by their family's largest band bucket, and two blocks are compared if any bucket
reaches into both, so every proposed pair meets exactly once, in one task with at most 2 * BLOCK texts, and a bucket with a third of
all texts is many blocks. Inside, MinHash values are compared some at a time; a pair goes when the posterior probability of reaching the
threshold falls below TOLERANCE, and what is left is verified exactly on the sets. No pair leaves its task: it returns
each text's number of links and a spanning forest of them.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import bucketed, drop, numbered, table, text_key, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16  # MinHash values that are compared between two looks at the posterior
TOLERANCE = 1e-6
BLOCK = 256
_DENSE = 1 << 23  # cells of a membership matrix

_FACTORS = (np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = np.random.default_rng(21).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, offsets): a text of fewer words is one n-gram, one without words has none."""
    data, offsets = T.buffers(texts)
    starts, ends, first = T.words(data, offsets, T.WORD_UNCHANGED)
    n = np.diff(first)
    grams = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    begin = T.ranges(first[:-1], grams)
    end = np.minimum(begin + words, np.repeat(first[1:], grams))
    return T.gram_hashes(T.word_hashes(data, starts, ends), begin, end), np.concatenate([[0], np.cumsum(grams)])


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each text; texts without n-grams get zeros."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, len(_FACTORS)), np.uint32)
    for k, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        if len(some):
            out[some, k] = np.minimum.reduceat((hashes ^ shift) * factor, offsets[some]) >> np.uint64(32)
    return out


def _band_rows(words: int):
    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                hashes, offsets = shingles(batch.column(batch.schema.get_field_index("text")), words)
                some = np.flatnonzero(np.diff(offsets))
                values = signatures(hashes, offsets)[some].astype(np.uint64)
                keys = np.zeros((len(some), BANDS), np.uint64)
                for row in range(ROWS):
                    keys = T.mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, row::ROWS] + np.uint64(1))
                keys = T.mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                take = pa.array(np.repeat(some, BANDS))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(take) for c in ("key_a", "key_b")] + [pa.array(keys.ravel().view(np.int64))], names=["key_a", "key_b", "bucket"])

    return run


def _node_rows(words: int):
    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                hashes, offsets = shingles(batch.column(batch.schema.get_field_index("text")), words)
                values = signatures(hashes, offsets)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("key_a", "key_b", "block")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in values], pa.binary()), pa.array(sets, pa.binary())], names=["key_a", "key_b", "block", "values", "set"])

    return run


def least_matches(threshold: float, tolerance: float, step: int = STEP, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(n, m): of n compared values at least m must agree. With a flat prior the posterior after m of n is that of
    Beta(m + 1, n - m + 1), whose part from the threshold up is that of m or fewer hits in n + 1 draws at the threshold."""
    out = []
    for n in range(step, total + 1, step):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that stay candidates after all looks."""
    a, b = pairs
    agree = np.zeros(len(a), np.int32)
    done = 0
    for n, m in rules:
        agree += (left[a, done:n] == right[b, done:n]).sum(axis=1, dtype=np.int32)
        keep = agree >= m
        a, b, agree, done = a[keep], b[keep], agree[keep], n
    return a, b


def jaccard(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact similarity of pairs of sorted sets."""
    sizes = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([a, b]))
    if not len(used):
        return np.zeros(0)
    spelled, at = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    if len(used) * len(spelled) <= _DENSE and len(a) > len(used):
        matrix = np.zeros((len(used), len(spelled)), np.float32)
        matrix[np.repeat(np.arange(len(used)), sizes[used]), at] = 1
        place = np.searchsorted(used, a), np.searchsorted(used, b)
        common = (matrix @ matrix.T)[place]
    else:
        common = np.array([np.isin(sets[i], sets[j], assume_unique=True).sum() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    return common / (sizes[a] + sizes[b] - common)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stars that connect what the links connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in range(n) if find(x) != x]


def _compare(rows: pa.Table, threshold: float, rules) -> pa.RecordBatch | None:
    """Links of one pair of blocks: (node, links, other); `other` is set in rows of the forest."""
    side = rows["side"].to_numpy()
    values = np.stack([np.frombuffer(v.as_buffer(), np.uint32) for v in rows["values"]])
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows["set"]]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(two):
        a, b = np.repeat(one, len(two)), np.tile(two, len(one))
    else:
        x, y = np.triu_indices(len(one), 1)
        a, b = one[x], one[y]
    sizes = np.array([len(s) for s in sets])
    fit = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = survivors(values, values, (a[fit], b[fit]), rules)
    near = jaccard(sets, a, b) >= threshold
    a, b = a[near], b[near]
    if not len(a):
        return None
    links = np.bincount(np.concatenate([a, b]), minlength=rows.num_rows)
    linked = np.flatnonzero(links)
    forest = _forest(rows.num_rows, a, b)
    node = np.array([*linked.tolist(), *(x for _, x in forest)])
    other = [None] * len(linked) + [y for y, _ in forest]
    keys = [rows[c].to_numpy() for c in ("key_a", "key_b")]
    return pa.RecordBatch.from_arrays(
        [pa.array(k[node]) for k in keys] + [pa.array([*links[linked].tolist(), *[0] * len(forest)], pa.int64())] + [pa.array([None if o is None else int(k[o]) for o in other], pa.int64()) for k in keys],
        names=["key_a", "key_b", "links", "other_a", "other_b"],
    )


def _compare_all(threshold: float):
    rules = least_matches(threshold, TOLERANCE)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table):
            one, two = table["one"].to_numpy(), table["two"].to_numpy()
            cut = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            return [0, *cut.tolist(), table.num_rows]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            edges = groups(table)
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):  # the last group may go on
                found = _compare(table.slice(a, b - a), threshold, rules)
                if found is not None:
                    yield found
            held = table.slice(edges[-2]).to_batches()
            T.give_back()
        if held:
            found = _compare(pa.Table.from_batches(held), threshold, rules)
            if found is not None:
                yield found

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (node, other): the smallest node of each component.

    Labels pass along edges and are then shortened to their label's label, so rounds grow with the logarithm of a path's
    length. Each round is written out; a round's join keys are nodes, and hubs are stars of one block at most.
    """
    both = written(edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    while True:
        passed = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        nearer = labels.select("node", "root").join(passed, "node").select("node", "root", F.least("root", "near").alias("next"))
        hop = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = written(nearer.join(hop, "next", "left").select("node", F.col("root").alias("old"), F.least("next", F.coalesce("far", "next")).alias("root")))
        drop(labels)
        labels = step
        if step.where(F.col("old") != F.col("root")).isEmpty():
            drop(both)
            return labels.select("node", "root")


def _blocks(members: DataFrame) -> DataFrame:
    """(key_a, key_b, block): texts of one family in as few blocks of about BLOCK as can hold them.

    A text's home is its largest bucket. Twice, each bucket passes on the largest home of its members and each text takes the
    largest of its buckets', so that most of a family has one home. Homes are then cut by a hash.
    """
    keys = ["key_a", "key_b"]
    home = written(members.groupBy(*keys).agg(F.max(F.struct("n", "bucket")).alias("home")))
    for _ in range(2):
        largest = written(members.join(home, keys).groupBy("bucket").agg(F.max("home").alias("home")))
        drop(home)
        home = written(members.join(largest, "bucket").groupBy(*keys).agg(F.max("home").alias("home")))
        drop(largest)
    sizes = written(home.groupBy("home.bucket").agg(F.count(F.lit(1)).alias("size")))
    part = F.pmod(F.xxhash64(*keys), F.ceil(F.col("size") / BLOCK))
    out = written(home.select(*keys, "home.bucket").join(sizes, "bucket").select(*keys, F.xxhash64("bucket", part).alias("block")))
    drop(home, sizes)
    return out


def link_texts(texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(key_a, key_b, links, other_a, other_b) of distinct texts (key_a, key_b, text): links of each text by pair of blocks, and
    in rows with links 0 the edges of the forests."""
    spark = texts.sparkSession
    bands = written(texts.mapInArrow(_band_rows(words), "key_a long, key_b long, bucket long"))
    shared = written(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(bands.join(shared, "bucket"))
    drop(bands, shared)
    blocks = _blocks(members)
    cells = written(members.join(blocks, ["key_a", "key_b"]).select("bucket", "block").distinct())
    drop(members)
    one, two = cells.withColumnRenamed("block", "one"), cells.withColumnRenamed("block", "two")
    pairs = written(one.join(two, "bucket").where("one <= two").select("one", "two").distinct())
    nodes = written(texts.join(blocks, ["key_a", "key_b"]).select("key_a", "key_b", "text", "block").mapInArrow(_node_rows(words), "key_a long, key_b long, block long, values binary, set binary"))
    left = nodes.join(pairs, nodes["block"] == pairs["one"]).withColumn("side", F.lit(0))
    right = nodes.join(pairs.where("one != two"), nodes["block"] == pairs["two"]).withColumn("side", F.lit(1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = left.unionByName(right).drop("block").repartition(n, "one", "two").sortWithinPartitions("one", "two")
    found = written(work.mapInArrow(_compare_all(threshold), "key_a long, key_b long, links long, other_a long, other_b long"))
    drop(blocks, cells, pairs, nodes)
    return found


def _by_text(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(key_a, key_b, class_a, class_b, class_id, n_links, n_copies) of every different text; class_a and class_b name its class."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = bucketed(docs.select("doc_id", *text_key(), text.alias("text")).groupBy("key_a", "key_b").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")), "key_a", "key_b")
    found = link_texts(texts, words, threshold)
    links = found.where("links > 0").groupBy("key_a", "key_b").agg(F.sum("links").alias("n_links"))
    edges = found.where("other_a is not null").select(F.struct("key_a", "key_b").alias("node"), F.struct(F.col("other_a").alias("key_a"), F.col("other_b").alias("key_b")).alias("other"))
    roots = components(edges).select("node.key_a", "node.key_b", "root")
    known = texts.select("key_a", "key_b", "first_id", "copies")
    named = written(known.join(roots, ["key_a", "key_b"]))
    classes = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    member = written(named.join(classes, "root").select("key_a", "key_b", F.col("root.key_a").alias("class_a"), F.col("root.key_b").alias("class_b"), "class_id"))
    out = known.join(member, ["key_a", "key_b"], "left").join(links, ["key_a", "key_b"], "left")
    own = F.when(F.col("class_a").isNull(), F.col("first_id")).otherwise(F.col("class_id"))
    return out.select("key_a", "key_b", F.coalesce("class_a", "key_a").alias("class_a"), F.coalesce("class_b", "key_b").alias("class_b"), own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest doc_id that it is linked with, directly or through others, or its own),
    n_links (different texts at the threshold or over) and n_copies (rows with its text, itself included).

    Words are runs of anything but ASCII white space, unchanged. A text of fewer words than an n-gram has is one n-gram; one without
    words is like no other text. A null text counts as empty, so all null and empty texts are copies.
    """
    return docs.select("doc_id", *text_key()).join(_by_text(docs, words, threshold), ["key_a", "key_b"]).drop("key_a", "key_b", "class_a", "class_b")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The document with the smallest doc_id of every class; of equal rows of that doc_id and text one stays. Columns stay as they are."""
    plain, names = numbered(docs)
    ident, text, keys = names["doc_id"], names["text"], ["key_a", "key_b"]
    plain = plain.select("*", *text_key(text))
    by_text = _by_text(docs, words, threshold).select(*keys, "class_a", "class_b")
    rows = plain.groupBy(F.col(ident).alias("id"), *keys).agg(F.count(F.lit(1)).alias("rows")).join(by_text, keys)
    first = rows.groupBy("class_a", "class_b").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", *keys, "rows")).alias("t"))
    lone = written(first.select("t.id", "t.key_a", "t.key_b", "t.rows"))
    kept = plain.join(lone, keys).where(F.col(ident).eqNullSafe(F.col("id"))).select(*names.values(), "rows")
    if not lone.where("rows > 1").isEmpty():
        kept = kept.where("rows = 1").unionByName(kept.where("rows > 1").dropDuplicates([ident, text]))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near copies at 0.8 on 5-word sets, and its text's links and copies.

    Null and empty texts are copies of each other and near to none; repeated rows each give a row and count as copies; an empty table gives none.
    """
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
