"""Very long texts, and tables whose extra columns bear the operators' own names."""

import inspect
import random
import re

import pytest
from cadenza.llm import _io, _repeats, decontamination, language, licenses, near_duplicates, packing, sharding, substring, suffix_array, wavelet

CLASHING = ["key_a", "key_b", "copies", "anchor", "seg", "spans", "shard", "n", "list", "block", "class", "part", "rank", "index", "lang_pred", "score", "kept", "n_words", "words", "items", "cell", "first"]


def stage_names():
    """Every column name that the stages' own source writes, and the numbered ones that columns are renamed to meanwhile."""
    source = "".join(inspect.getsource(m) for m in (_io, _repeats, decontamination, language, near_duplicates, packing, substring, suffix_array))
    found = set(re.findall(r"['\"]([a-z_][a-z0-9_]*)['\"]", source)) | {f"_{i}" for i in range(4)} | {"_rows", "_id", "_kept", "_key_a", "_key_b", "_row"}
    return sorted(found - {"doc_id", "text", "lang", "n_chars"})


def test_names_of_stages(spark):
    """Each stage on a table that has columns of all names that it adds itself: columns and their values stay."""
    names = stage_names()
    assert {"key_a", "class_a", "rows", "kept", "anchor", "seg", "_rows", "_id"} <= set(names)
    passage = " ".join(f"word{i}" for i in range(80))
    texts = [(1, f"one two three {passage}", "en"), (2, f"quite another beginning {passage} and end", "en"), (3, f"quite another beginning {passage} and end", "en"), (4, "ein kurzer Text hier", "de"), (5, None, "de")]
    fields = ", ".join(f"`{n}` long" for n in names)
    docs = spark.createDataFrame([(*t, len(t[1] or ""), *range(t[0], t[0] + len(names))) for t in texts], f"doc_id long, text string, lang string, n_chars long, {fields}")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    stages = {
        "language": lambda d: language.with_language(d, 0.0), "near": near_duplicates.one_of_each, "bytes": lambda d: suffix_array.without_repeats(d, 200),
        "words": substring.without_passages, "benchmark": lambda d: decontamination.without_benchmark(d, items), "much of it": lambda d: decontamination.without_benchmark(d, items, drop_over=0.5),
    }
    left = {"language": 4, "near": 3, "bytes": 5, "words": 5, "benchmark": 5, "much of it": 2}
    for name, stage in stages.items():
        found = stage(docs)
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert len(rows) == left[name] and all([r[n] for n in names] == list(range(r.doc_id, r.doc_id + len(names))) for r in rows), name
    assert packing.pack(docs, with_ids=False).select("doc_id").distinct().count() == 5


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    varied = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(150_000))
    rows = [(1, varied, "en"), (2, "again " * 200_000, "en"), (3, "x" * 600_000, "de"), (4, "short", "de"), (5, None, None)]
    return spark.createDataFrame([(*row, *[7] * len(CLASHING)) for row in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in CLASHING)).repartition(2).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_words_and_bytes(docs):
    found = by_id(substring.digests(docs))
    assert (found[1].n_words, found[1].n_removed) == (150_000, 0) and found[2].n_words == found[2].n_removed == 200_000 and found[3].n_words == 1
    found = by_id(suffix_array.digests(docs))
    assert found[1].n_removed == 0 and found[2].n_removed == 1_200_000 and found[3].n_removed == 600_000 and found[3].n_spans == 1 and found[5].n_bytes == 0
    kept = suffix_array.without_repeats(docs)
    assert kept.columns == docs.columns and by_id(kept)[2].text == "" and by_id(kept)[1].text == by_id(docs)[1].text
    assert substring.without_passages(docs).columns == docs.columns


def test_scans(spark, docs):
    items = spark.createDataFrame([(1, "again " * 12)], "item_id long, text string")
    found = by_id(decontamination.digests(docs, items))
    assert found[2].n_hit == 200_000 and not found[1].contaminated
    assert by_id(decontamination.without_benchmark(docs, items))[2].text.strip() == ""
    found = by_id(licenses.scan(docs))
    assert found[1].n_words == 150_000 and found[5].labels == ""
    found = by_id(language.identify(docs))
    assert found[5].lang_pred == "und" and found[1].lang_pred in ("en", "de")
    assert language.with_language(docs).columns == docs.columns


def test_groups_and_tokens(spark, docs, tmp_path):
    assert {r.n_links for r in near_duplicates.classes(docs).collect()} == {0}
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert sorted(r.slot for r in sharding.assign(docs, 5).collect()) == [0] * 5
    pieces = packing.pack(docs, with_ids=False).collect()
    lengths = {i: sum(p.length for p in pieces if p.doc_id == i) for i in range(1, 6)}
    wavelet.write(docs, str(tmp_path / "w"))
    found = by_id(wavelet.read(spark, str(tmp_path / "w"), with_ids=False))
    assert {i: r.n_tokens for i, r in found.items()} == lengths and lengths[5] == 1 and lengths[1] > 150_000
