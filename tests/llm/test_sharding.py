import zlib
from collections import Counter, defaultdict

import pytest
from cadenza.llm import sharding


def check(rows, texts, shards):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s, slots in by.items():
        assert 0 <= s < shards and sorted(slots) == list(range(len(slots)))
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == sizes


@pytest.mark.parametrize("shards", [3, 24])
def test_groups_stay_together(spark, shards):
    texts = [(i, f"single {i}") for i in range(200)] + [(1000 + i, f"copy {i % 20}") for i in range(100)] + [(2000, None), (2001, ""), (2001, ""), (None, "x")]
    docs = spark.createDataFrame([(*r, 5) for r in texts], "doc_id long, text string, shard int").repartition(5)
    rows = sharding.assign(docs, shards).collect()
    check(rows, texts, shards)
    where = defaultdict(set)
    for r in rows:
        if r.doc_id is not None and 1000 <= r.doc_id < 1100:
            where[r.doc_id % 20].add(r.shard)
    assert sum(len(s) == 1 for s in where.values()) >= 18


def test_group_of_a_third(spark):
    texts = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(600)]
    rows = sharding.assign(spark.createDataFrame(texts, "doc_id long, text string"), 6).collect()
    check(rows, texts, 6)
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) <= 3


def cut_pairs(rows, texts):
    """(pairs of equal texts in different shards, all pairs of equal texts)."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[texts[r.doc_id]][r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    whole = sum(pairs(sum(c.values())) for c in groups.values())
    return whole - sum(pairs(n) for c in groups.values() for n in c.values()), whole


def test_cut_edges(spark):
    """Near the best cut where groups fit; a group of a third of the rows among shards that other groups fill stays further from it."""
    small = {i: f"t{i % 150}" if i < 900 else f"single {i}" for i in range(1200)}
    hot = {i: "hot" if i % 3 == 0 else f"t{i // 6}" for i in range(1200)}
    for texts, shards, best, over in ((small, 8, 0, 0.03), (hot, 8, 400 * 399 // 2 - 2 * (150 * 149 // 2) - 100 * 99 // 2, 0.25)):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        cut, whole = cut_pairs(sharding.assign(docs, shards).collect(), texts)
        hashed, _ = cut_pairs(docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 8) as shard").collect(), texts)
        assert cut <= best + over * whole and cut <= hashed


def test_few_rows(spark):
    for texts in ([], [(1, "a")], [(1, "a"), (2, "a"), (3, "a")]):
        rows = sharding.assign(spark.createDataFrame(texts, "doc_id long, text string"), 24).collect()
        check(rows, texts, 24)


def test_real_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    check(sharding.op4_balanced_sharding(spark, small).collect(), [tuple(r) for r in docs.collect()], 24)
