import zlib
from math import log2

import numpy as np
import pyarrow as pa
from cadenza.llm import language as L
from pyspark.sql.functions import col as spark_col


def brute_bits(texts, text, least):
    """Prediction by partial matching straight from its definition, contexts as in the joint tree."""
    trees = {}
    total = {}
    alphabet = set()
    for lang, own in texts.items():
        counts = trees[lang] = {}
        for t in own:
            t = b"\0\0\0" + t
            for i in range(3, len(t)):
                alphabet.add(t[i])
                total[t[i - 3 : i]] = total.get(t[i - 3 : i], 0) + 1
                for k in range(4):
                    c = counts.setdefault(t[i - k : i], {})
                    c[t[i]] = c.get(t[i], 0) + 1
    # what was never a symbol (the zeros before a start) is one class in contexts as well
    norm = lambda c: bytes(x if x in alphabet else 0 for x in c)
    joint = {}
    for c, n in total.items():
        joint[norm(c)] = joint.get(norm(c), 0) + n
    pairs = {c[1:] for c in joint}
    out = {}
    for lang, counts in trees.items():
        bits = 0.0
        t = b"\0\0\0" + text
        for i in range(3, len(t)):
            context = norm(t[i - 3 : i])
            context = context if joint.get(context, 0) >= least else context[1:] if context[1:] in pairs else context[2:]
            p, excluded = 1.0, set()
            while True:
                own = {s: n for s, n in counts.get(context, {}).items() if s not in excluded}
                n, u = sum(own.values()), len(own)
                if n:
                    if t[i] in own:
                        p *= own[t[i]] / (n + u)
                        break
                    p *= u / (n + u)
                    excluded |= set(own)
                if not context:
                    p /= 256 - len(excluded)
                    break
                context = context[1:]
            bits -= log2(p)
        out[lang] = bits
    return out


def test_code_lengths_as_defined():
    texts = {"a": [b"abracadabra abra", b"cab"], "b": [b"bonbon bon", b"nob nob abc"]}
    rows = {}
    for lang, own in texts.items():
        data, offsets = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
        for g in L._grams(data, offsets)[0].tolist():
            rows[lang, g] = rows.get((lang, g), 0) + 1
    for least in (1, 3, 100):
        model = L.build([(k, g, n) for (k, g), n in rows.items()], least)
        asked = ["abra cab", "bon zz", "", "q", "nob abra"]
        got = L.score(model, pa.array(asked))
        for i, t in enumerate(asked):
            want = brute_bits(texts, t.encode(), least)
            assert np.allclose(got[i], [want[x] for x in model.languages], atol=1e-3), (least, t)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    counts = [r.integers(0, 3, (5, 9)) for _ in range(3)]
    for c in counts:
        c[:, 0] = 0
    p = np.exp2(-L._code_lengths(counts))
    assert np.allclose(p[:, 1:].sum(axis=1) + p[:, 0] * (256 - 8), 1)


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    asked = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(asked) > 20
    assert sum(r.lang_pred == r.lang for r in asked) / len(asked) > 0.95


def test_odd_rows(spark):
    rows = [(1, "the the the and", "en"), (3, "der die das und", "de"), (4, None, "en"), (5, "123 !!", "de"), (6, "", None), (7, "the and the", None), (None, "das die", None), (8, "漢字", None), (3, "der die das und", "de")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred) for r in L.identify(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (3, "de"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (None, "de"), (8, dict(got)[8]), (3, "de")], key=str)
    assert dict(got)[8] in ("en", "de")
    kept = L.with_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 7, None}
    assert L.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}


def test_all_labelled_text_counts(spark):
    # languages of one long text, each many times: 7 MB or so a language that aren't held out
    r = np.random.default_rng(3)
    texts = {f"l{k}": " ".join("".join(chr(97 + (k + x) % 26) for x in w) for w in r.integers(0, 9, (14000, 6))) for k in range(6)}
    once = spark.createDataFrame(list(texts.items()), "lang string, text string")
    docs = spark.range(600).withColumnRenamed("id", "doc_id").join(once, (spark_col("doc_id") % 6).cast("string") == once.lang.substr(2, 1))
    labelled = {x: 0 for x in texts}
    for i in range(600):
        labelled[f"l{i % 6}"] += zlib.crc32(str(i).encode()) % 4 != 2
    rows = []
    for lang, text in texts.items():
        data = text.encode()
        grams, n = np.unique(L._grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0], return_counts=True)
        rows += [(lang, g, k * labelled[lang]) for g, k in zip(grams.tolist(), n.tolist(), strict=True)]
    model, want = L.train(docs), L.build(rows)
    assert model.languages == want.languages == list(texts)
    assert (model.codes == want.codes).all() and (model.states == want.states).all() and (model.bits == want.bits).all()
    assert [(x.lang, x.lang_pred) for x in L.predict(once, model, ["lang"]).orderBy("lang").collect()] == [(x, x) for x in texts]
