import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from cadenza.llm import _repeats, substring, suffix_array


def brute_bytes(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed, alphabet="abé \n"):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passage, base = word(60), word(150)
    texts = [word(r.randint(0, 120)) for _ in range(15)]
    texts += [word(r.randint(0, 40)) + passage[r.randint(0, 12) :] + word(r.randint(0, 40)) for _ in range(12)]
    texts += [base] * 3 + [base[:75] + "XX" + base[75:], "ab" * 90, "a" * 130, "", None]
    texts += ["é x" + unit * k + "y" for unit, k in (("qrs", 13), ("b\n", 17), ("xyzw ", 8), ("mn o ", 9), ("u", 33), ("stuvw", 7))]
    return texts


@pytest.mark.parametrize("most", [5000, 2])
def test_bytes_as_brute_force(spark, monkeypatch, most):
    texts = made_texts(1)
    size = 30
    monkeypatch.setattr(suffix_array, "GRAM", 10)
    monkeypatch.setattr(suffix_array, "repeated_spans", lambda *a, **b: _repeats.repeated_spans(*a, **b, most=most))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in suffix_array.digests(docs, size, 12).collect()}
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()}
    want = brute_bytes([(t or "").encode() for t in texts], size)
    assert [got[i] for i in range(len(texts))] == want
    assert [rows[i].n_passage for i in range(len(texts))] == [w[1] for w in brute_bytes([(t or "").encode() for t in texts], 12)]
    assert sum(w[1] for w in want) > 500


def test_whole_characters_stay(spark):
    texts = ["é" * 300 + "x", "y" + "é" * 300, "plain", None]
    docs = spark.createDataFrame([(i, t, "k", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, key_a string, n_chars long")
    rows = {r.doc_id: r for r in suffix_array.without_repeats(docs, 400).collect()}
    assert rows[0].text == "x" and rows[1].text == "y" and rows[2].text == "plain" and rows[3].text is None
    assert rows[0].n_chars == 1 and rows[2].n_chars == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.digests(docs).count() == 0 and substring.digests(docs).count() == 0
    assert suffix_array.without_repeats(docs).count() == 0 and substring.without_passages(docs).count() == 0


def test_repeated_rows_are_places(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (1, passage), (2, "short"), (2, "short")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.digests(docs).collect()) == [0, 0, 60, 60]
    assert sorted(r.n_removed for r in suffix_array.digests(docs).collect()) == [0, 0, len(passage), len(passage)]


def test_long_texts_in_pieces(monkeypatch):
    """Windows have the same anchors whether a text is looked at in pieces or at once."""
    import pyarrow as pa

    texts = ["".join(random.Random(k).choice("ab \n") for _ in range(900)) for k in range(2)]
    texts.append(texts[0][100:400] + "X" + texts[1][200:500] + "X" + texts[0][300:600])
    monkeypatch.setattr(_repeats.T, "slices", lambda batch, column, *a, **b: (batch.slice(i, 1) for i in range(batch.num_rows)))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 0, 0]), pa.array(texts), pa.array([1, 1, 1])], names=["key_a", "key_b", "text", "copies"])

    def anchors(piece):
        monkeypatch.setattr(_repeats, "PIECE", piece)
        rows = pa.Table.from_batches(list(_repeats.segments(30, 7, False)(iter([batch])))).to_pydict()
        return {(k, s + i): a for k, s, n, a in zip(rows["key_a"], rows["start"], rows["n"], rows["anchor"], strict=True) for i in range(n)}

    assert anchors(64) == anchors(1 << 20) and len(anchors(64)) == sum(len(t) - 29 for t in texts)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    starts = np.arange(0, 890, 3)
    whole = _repeats.T.Rolling(data).of(starts, starts + 5)
    assert (_repeats.T.spans_hashed(data, starts, starts + 5, 50) == whole).all()


def test_passages_just_over_fifty_words(spark):
    """51 short words that two documents share go; clean documents stay."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(51) for _ in range(6)]
    docs = [(i, f"{text(80)} {passages[i % 6]} {text(80)}") for i in range(12)] + [(i, text(200)) for i in range(12, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {q.doc_id: q for q in suffix_array.without_repeats(df, suffix_array.PASSAGE).collect()}
    assert all(passages[i % 6] not in rows[i].text and len(rows[i].text) < len(docs[i][1]) - 200 for i in range(12))
    assert all(rows[i].text == docs[i][1] for i in range(12, 30))


@pytest.mark.parametrize("seed", range(5))
def test_common_prefixes(seed):
    r = np.random.default_rng(seed)
    data = r.integers(97, 100, 300).astype(np.uint8)
    data[100:180] = data[10:90]
    data = np.append(data, np.uint8(255))
    for least in (8, 20, 64):
        order, short = suffix_array.suffix_order(data, least)
        rows = [data[i : i + least].tobytes() for i in order]
        assert rows == sorted(rows)
        want = [False] + [a == b and len(b) == least for a, b in zip(rows, rows[1:], strict=False)]
        assert list(suffix_array.common_prefix_at_least(data, order, short, least)) == want


def brute_words(texts, size):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in lists for i in range(len(w) - size + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [5000, 2])
def test_words_as_brute_force(spark, monkeypatch, most):
    texts = made_texts(2, "ab \n é  ")
    monkeypatch.setattr(substring, "GRAM", 3)
    monkeypatch.setattr(substring, "repeated_spans", lambda *a, **b: _repeats.repeated_spans(*a, **b, most=most))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs, 7).collect()}
    want = brute_words(texts, 7)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 100


def test_passages_go(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    texts = ["one " + passage + " two", "three  " + passage, "clean  text", None, ""]
    docs = spark.createDataFrame([(i, t, "k", "kept") for i, t in enumerate(texts)], "doc_id long, text string, key_a string, kept string")
    rows = {r.doc_id: r for r in substring.without_passages(docs).collect()}
    assert [rows[i].text for i in range(5)] == ["one two", "three", "clean  text", None, ""]
    assert rows[0].key_a == "k"


def test_automaton_counts_places():
    r = random.Random(3)
    sequences = [[r.randint(0, 2) for _ in range(r.randint(1, 60))] for _ in range(8)]
    sequences.append(sequences[0])
    a = substring.SuffixAutomaton()
    for s in sequences:
        a.add(s)
    a.count(sequences, [1] * len(sequences))
    for size in (2, 5, 9):
        seen = Counter(tuple(s[i : i + size]) for s in sequences for i in range(len(s) - size + 1))
        for s in sequences:
            assert a.repeated(s, size) == [i + 1 >= size and seen[tuple(s[i + 1 - size : i + 1])] > 1 for i in range(len(s))]


def colliding(base, seed, letters=25, block=8, width=1 << 17):
    """Two different strings of small letters with one polynomial hash modulo 2^64 in the base, by a birthday search on differences."""
    r = np.random.default_rng(seed)
    lists = []
    for k in range(8):
        d = r.integers(-letters, letters + 1, (width, block))
        powers = np.array([pow(base, k * block + j, 1 << 64) for j in range(block)], np.uint64)
        lists.append((((d.astype(np.int64).view(np.uint64)) * powers).sum(axis=1, dtype=np.uint64), d))
    for bits in (16, 16, 32):
        done = {16: 0, 32: 32}[bits] if len(lists) != 4 else 16
        merged = []
        for (a, da), (b, db) in zip(lists[::2], lists[1::2], strict=True):
            mask = np.uint64((1 << bits) - 1)
            left, right = (a >> np.uint64(done)) & mask, ((np.uint64(0) - b) >> np.uint64(done)) & mask
            by = np.argsort(right)
            lo, hi = np.searchsorted(right[by], left), np.searchsorted(right[by], left, side="right")
            n = hi - lo
            i = np.repeat(np.arange(len(a)), n)[: 2 * width]
            j = by[_repeats.T.ranges(lo, n)[: 2 * width]]
            merged.append((a[i] + b[j], np.concatenate([da[i], db[j]], axis=1)))
        lists = merged
    sums, d = lists[0]
    d = next(x for s, x in zip(sums, d, strict=True) if s == 0 and x.any())
    one = np.maximum(d, 0) + 97
    return bytes(one.astype(np.uint8).tolist()).decode(), bytes((one - d).astype(np.uint8).tolist()).decode()


@pytest.fixture(scope="module")
def collisions():
    found = [colliding(base, k) for k, base in enumerate((_repeats.T._BASE, _repeats.T._STEP))]
    for base, (a, b) in zip((_repeats.T._BASE, _repeats.T._STEP), found, strict=True):
        value = lambda t, base=base: sum((ord(c) + 1) * pow(base, i, 1 << 64) for i, c in enumerate(t)) % 2**64
        assert a != b and value(a) == value(b)
    return found


def test_words_with_colliding_hashes(spark, collisions):
    """Windows that differ in one word of the same polynomial hash don't repeat."""
    docs = []
    for k, (a, b) in enumerate(collisions):
        shared = [f"w{k}x{i}" for i in range(34)]
        docs += [" ".join([*shared, a]), " ".join([*shared, b]), " ".join([a, *shared[:34]]), " ".join([b, *shared[:34]])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(df).collect()}
    assert [got[i] for i in range(len(docs))] == brute_words(docs, 35) and all(g[1] == 0 for g in got.values())


@pytest.mark.parametrize("most", [5000, 1])
def test_bytes_with_colliding_hashes(spark, collisions, monkeypatch, most):
    """Strings around bytes of the same polynomial hash, of every length before and behind, are told apart."""
    monkeypatch.setattr(suffix_array, "repeated_spans", lambda *a, **b: _repeats.repeated_spans(*a, **b, most=most))
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("ABCDEFGHIJ") for _ in range(n))
    docs = []
    for a, b in collisions * 4:
        before, behind = letters(r.randint(100, 420)), letters(r.randint(200, 600))
        docs += [before + a + behind, before + b + behind, letters(30) + a + behind[:390]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    want = brute_bytes([t.encode() for t in docs], 400)
    got = {q.doc_id: (q.n_bytes, q.n_removed, q.n_spans, q.kept_sha256) for q in suffix_array.digests(df).collect()}
    assert [got[i] for i in range(len(docs))] == want and 0 < sum(w[1] for w in want)
    kept = {q.doc_id: q.text for q in suffix_array.without_repeats(df).collect()}
    assert [hashlib.sha256(kept[i].encode()).hexdigest() for i in range(len(docs))] == [w[3] for w in want]


@pytest.mark.parametrize("seed", range(6))
def test_kernels_under_weak_hashes(monkeypatch, seed):
    """Two bits of hash: nothing but more work may come of it."""
    monkeypatch.setattr(_repeats.T, "mix", lambda h: h & np.uint64(3))
    r = random.Random(seed)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(20, 60))) for _ in range(12)]
    texts.append(texts[0])
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
    want = np.zeros(len(data), bool)
    for at, t in zip(offsets.tolist(), texts, strict=False):
        for i in range(len(t) - 11):
            want[at + i] = seen[t[i : i + 12]] > 1
    for kernel in (suffix_array.repeated_windows, substring.repeated_windows):
        assert (kernel(data, offsets, np.ones(len(texts), np.int64), 12) == want).all()


def plans_of(spark, run):
    """The plans of all that run() executes."""
    status = spark._jsparkSession.sharedState().statusStore()
    before = {x.executionId() for x in listed(status)}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [x.physicalPlanDescription() for x in listed(status) if x.executionId() not in before]


def listed(status):
    found = status.executionsList()
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("operator", [suffix_array.without_repeats, suffix_array.digests, substring.digests, substring.without_passages])
def test_nothing_that_grows_is_broadcast(spark, operator):
    """Small files can be many rows: their hash tables once filled the driver at 0.5 GB of documents."""
    base = "".join(random.Random(3).choices("abcdefgh ", k=900))
    texts = [base + "x", "y" + base, "z " * 300, "plain", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans = plans_of(spark, lambda: operator(docs).collect())
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastExchange" in p for p in plans)
