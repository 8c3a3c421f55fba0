import random
import re
from collections import Counter

import numpy as np
import pytest
from cadenza.llm import near_duplicates as N


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    texts = sorted({t or "" for _, t in docs})
    sets = [grams(t) for t in texts]
    links, root = Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
                links[texts[i]] += 1
                links[texts[j]] += 1
                root[find(i)] = find(j)
    component = {t: find(i) for i, t in enumerate(texts)}
    smallest = {}
    for d, t in docs:
        if d is not None:
            c = component[t or ""]
            smallest[c] = min(smallest.get(c, d), d)
    copies = Counter(t or "" for _, t in docs)
    return sorted(((d, smallest.get(component[t or ""]), links[t or ""], copies[t or ""]) for d, t in docs), key=str)


def made(n=400):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    docs = []
    for i in range(n):
        if i % 3 == 0:
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            docs.append((i, " ".join(w)))
        elif i % 3 == 1:
            docs.append((i, " ".join(word() for _ in range(r.randint(0, 30)))))
        else:
            docs.append((i, docs[r.randrange(len(docs))][1] + r.choice(["", " x"])))
    return docs + [(9000, None), (9001, ""), (None, "lone"), (9002, "a b c"), (9003, "a b c"), (9003, "a b c"), (9004, "a b  c")]


@pytest.mark.parametrize("block", [256, 16])
def test_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    docs = made()
    frame = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, n_links string").repartition(4)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in N.classes(frame).collect()), key=str)
    want = brute(docs)
    assert got == want
    assert sum(w[2] for w in want) > 500


def test_one_stays(spark):
    docs = made(120)
    frame = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, root string")
    kept = N.one_of_each(frame)
    assert kept.columns == frame.columns
    rows = Counter(r.doc_id for r in kept.collect())
    assert rows == Counter({w[1] for w in brute(docs)})
    assert N.one_of_each(frame.where("false")).count() == 0
    same_id = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "c d"), (None, "e f"), (None, "e f"), (2, "e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in N.one_of_each(same_id).collect()) == [(1, "a b"), (1, "c d"), (2, "e f")]


def test_real_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in N.op1_ngram_jaccard_join(spark, small).collect()), key=str)
    assert got == brute(docs)


def test_posterior_rule():
    for n, m in N.least_matches(0.8, 1e-6):
        r = np.random.default_rng(n).beta(m + 1, n - m + 1, 200_000)
        assert (r >= 0.8).mean() < 0.01 and m < 0.8 * n
