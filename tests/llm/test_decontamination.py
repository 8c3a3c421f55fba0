import hashlib
import re

import pytest
from cadenza.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            size = min(window, len(v))
            grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1 if size else 0):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= {str(item)} if item is not None else set()
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


LONG = " ".join(f"Wört{i}" for i in range(25))
ITEMS = [(10, LONG), (9, "short one"), (2, None), (3, ""), (None, "no id here"), (10, "again ten"), (4, "x " * 9 + "y"), (7, LONG)]
DOCS = [(0, "say Short, ONE!"), (1, "a " + " ".join(f"WöRT{i}" if i % 2 else f"wört{i}" for i in range(3, 16)) + " b"), (2, None), (3, ""), (4, "no id here"), (5, "x " * 30 + "y"), (6, "clean text"), (7, LONG + " again ten"), (8, "again"), (9, LONG)]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_as_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(d, "PART_BYTES", part_bytes)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digests(docs, items).collect()}
    want = brute(DOCS, ITEMS)
    # İ and the like aside, A-Z is all that is lowered; ö differs from Ö
    assert got == want
    assert want[7][1] == 27 and want[5][1] == 10 or want[5][1] == 11


def test_real_tables(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digests(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and any(w[4] for w in want.values())


def test_spans_go(spark):
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in DOCS], "doc_id long, text string, n_chars long, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r.doc_id: r for r in d.without_benchmark(docs, items).collect()}
    assert len(rows) == len(DOCS) and rows[0].text == "say !" and rows[0].n_chars == 5 and rows[2].text is None and rows[6].text == "clean text"
    assert rows[1].text == "a  b"
    left = {r.doc_id for r in d.without_benchmark(docs, items, drop_over=0.5).collect()}
    assert left == {1 * k for k in rows} - {i for i, w in brute(DOCS, ITEMS).items() if w[1] > w[0] * 0.5}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.digests(docs, items).count() == 0
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert not any(r.contaminated for r in d.digests(some, items).collect())


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_parts_cut_like_one(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(d, "PART_BYTES", part_bytes)
    span = lambda c, a, b: " ".join(f"{c}{i:03}" for i in range(a, b))
    items, texts, want = [], [], []
    for k in range(8):
        c = f"k{k}"
        # windows of two items that overlap in a text, and words that only a cut brings together
        items += [(4 * k, span(c, 0, 10)), (4 * k + 1, span(c, 5, 15)), (4 * k + 2, span(c, 20, 30)), (4 * k + 3, span(c, 40, 50))]
        texts += [f"so {span(c, 0, 15)} it goes", f"{span(c, 20, 25)} {span(c, 40, 50)} {span(c, 25, 30)}"]
        want += ["so  it goes", f"{span(c, 20, 25)}  {span(c, 25, 30)}"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate([*texts, None, "clean", *texts])], "doc_id long, text string, n_chars long, words string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = d.without_benchmark(docs, benchmark)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(rows) == len(texts) * 2 + 2
    assert [rows[i].text for i in range(len(rows))] == [*want, None, "clean", *want]
    assert all(r.words == "x" and r.text is None or r.n_chars == len(r.text) for r in rows.values())
    # 15 of 18 and 10 of 20 words are hit
    assert {r.doc_id for r in d.without_benchmark(docs, benchmark, drop_over=0.6).collect()} == {i for i in rows if i in (16, 17) or (i if i < 16 else i - 18) % 2}
