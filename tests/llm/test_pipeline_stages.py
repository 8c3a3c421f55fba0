"""The pipeline against a plain version of every stage, each on what the stage before has kept."""

import re
from collections import Counter

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cadenza.llm import language
from cadenza.llm._io import written
from test_decontamination import WORD
from test_near_duplicates import brute as near_classes
from test_tokens import check_packing
from tokenizers import Tokenizer


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def recognised(spark, docs, before):
    model = language.train(docs)
    bits = language.score(model, pa.array([t or "" for _, t in before]))
    share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
    return [(i, t) for (i, t), s in zip(before, share, strict=True) if any(c.isalpha() for c in t or "") and s >= 0.5]


def one_of_each(before):
    keep = {c for _, c, _, _ in near_classes(before)}
    return [(i, t) for i, t in before if i in keep]


def without_long_repeats(before, size=200):
    texts = [t.encode() for _, t in before]
    seen = Counter(hash(t[i : i + size]) for t in texts for i in range(len(t) - size + 1))
    out = []
    for (doc, _), t in zip(before, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[hash(t[i : i + size])] > 1:
                gone[i : i + size] = True
        kept, at = [], 0
        for ch in t.decode():
            n = len(ch.encode())
            if not gone[at : at + n].all():
                kept.append(ch)
            at += n
        out.append((doc, "".join(kept)))
    return out


def without_items(before, items):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    grams = {tuple(w[i : i + min(10, len(w))]) for w in (WORD.findall(lower(t)) for t in items) if w for i in range(max(1, len(w) - 9))}
    out = []
    for doc, t in before:
        found = list(WORD.finditer(lower(t)))
        w = [m[0] for m in found]
        hit = set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
        gone = np.zeros(len(t), bool)
        for k in hit:
            gone[found[k].start() : found[k].end()] = True
            if k + 1 in hit:
                gone[found[k].end() : found[k + 1].start()] = True
        out.append((doc, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    plain = [lambda b: recognised(spark, docs, b), one_of_each, without_long_repeats, lambda b: without_items(b, items)]
    columns, before = docs.columns, rows(docs)
    for (name, stage), by_hand in zip(C.STAGES[:-1], plain, strict=True):
        found = written(stage(spark, docs, small))
        assert found.columns == columns, name
        after = rows(found)
        assert sorted(after) == sorted(by_hand(before)), name
        assert all(r.n_chars == len(r.text) for r in found.collect()), name
        docs, before = found, after
    packed = C.STAGES[-1][1](spark, docs, small).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert check_packing(packed, dict(before), library, 4096) > 0.95
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(piece, C.run(spark, small).collect())) == sorted(map(piece, packed))
    assert 0.3 < len(before) / 200 <= 1


@pytest.mark.parametrize("rows_", [[], [(1, None, "en", "s", 0), (2, "", None, None, None), (2, "12", "en", "s", 2)]])
def test_small_tables(spark, small, rows_):
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, small))
    assert docs.count() == 0
