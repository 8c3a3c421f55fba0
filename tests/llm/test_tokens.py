import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cadenza.llm import packing, tokens, wavelet
from tokenizers import Tokenizer

ODD = ["a<|endoftext|>b, <|endoftext|>", "don't won'T 'S x's", "é é, Å.", "İstanbul ΟΔΟΣ, ΣΑΣ.", "3.14 a1b2 [x]", "𝒳, 漢字。ok", "", None, "\x1cabc\x1d,", "a'.", "ﬁ. Ǆ!", "가, é, dèf", "\x85a b\x0bc", "x <|endoftext|>.", "word, " * 6000, "The the THE the,"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def coded(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_as_the_library(library):
    import pyarrow as pa

    coder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=10)
    for _ in range(3):
        ids, offsets = coder.encode(pa.array(ODD))
        for i, text in enumerate(ODD):
            assert [*ids[offsets[i] : offsets[i + 1]].tolist(), 2] == coded(library, text), text


def test_every_letter_before_punctuation(library):
    """A letter alone and behind another one, before each kind of ASCII mark, as the library codes it."""
    import sys
    import unicodedata

    import pyarrow as pa

    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and unicodedata.category(c) != "Lo" or c in "\u0958\u09dc\u0a33\u0f43\ufb1d\ufb4e漢가"]
    marks = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()]
    words = [f"{c}{marks[i % len(marks)]}" for i, c in enumerate(letters)] + [f"x{c}{marks[i % len(marks)]}{marks[i % 7]}" for i, c in enumerate(letters)]
    words += [f"{c}{m}" for c in "İaßŁΣ\u0958\ufb1d" for m in marks]
    words += [f"{chr(c)}." for a, b in ((0x900, 0xE00), (0xF00, 0xFC0), (0xFB00, 0xFB50)) for c in range(a, b) if unicodedata.category(chr(c))[0] == "L"]
    ids, offsets = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).encode(pa.array(words))
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    wrong = [w for i, w in enumerate(words) if ids[offsets[i] : offsets[i + 1]].tolist() != want[i]]
    assert not wrong, wrong[:20]


def test_real_texts(library, spark, small):
    import pyarrow as pa

    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    ids, offsets = tokens.encoder().encode(pa.array(texts))
    assert all([*ids[offsets[i] : offsets[i + 1]].tolist(), 2] == coded(library, t) for i, t in enumerate(texts))


@pytest.mark.parametrize("top", [1, 2, 300, 70000])
def test_wavelet_matrix(top):
    r = np.random.default_rng(top)
    ids = r.integers(0, top, 2000).astype(np.uint32)
    m = wavelet.WaveletMatrix.of(ids)
    assert (m.decode() == ids).all()
    for i in r.integers(0, 2000, 50).tolist():
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for token in set(ids[:20].tolist()):
        assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()
    assert m.count(top + 5) == 0


def test_files_round_trip(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 40)
    docs = spark.createDataFrame([(100 - i, t, 0) for i, t in enumerate(ODD)] + [(100, ODD[0], 1)], "doc_id long, text string, start int").repartition(3)
    wavelet.write(docs, str(tmp_path / "w"))
    rows = sorted(wavelet.read(spark, str(tmp_path / "w")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [*range(101 - len(ODD), 101), 100]
    at = 0
    for r in rows:
        want = coded(library, ODD[100 - r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(want), crc(want), want)
        at += len(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    wavelet.write(empty, str(tmp_path / "e"))
    assert wavelet.read(spark, str(tmp_path / "e")).count() == 0


def check_packing(rows, texts, library, capacity):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for doc, own in docs.items():
        ids = coded(library, texts[doc])
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(sequences))


def test_packing(spark, library, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = packing.op6_harmonic_packing(spark, small).collect()
    assert check_packing(rows, texts, library, 4096) > 0.95


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_of_odd_texts(spark, library, capacity):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(ODD)], "doc_id long, text string, class string").repartition(3)
    rows = packing.pack(docs, capacity=capacity).collect()
    assert check_packing(rows, dict(enumerate(ODD)), library, capacity) > 0.9
    assert all(r.ids == coded(library, ODD[r.doc_id])[r.start : r.start + r.length] for r in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_covers_and_wastes_little():
    for n in range(1, 9000):
        pieces = packing.cut(n, 4096, 0.02)
        assert sum(p for p, _ in pieces) == n
        assert all(p * k <= 4096 and p * k >= 0.98 * 4096 - k for p, k in pieces)


def test_words_of_several_batches_stay_known(library, monkeypatch):
    """A full store lets go of words that came up once; ids stay the library's."""
    coder = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY), most=40)
    monkeypatch.setattr(tokens, "_TOGETHER", 7, raising=False)
    learn, learnt = coder._learn, []
    monkeypatch.setattr(coder, "_learn", lambda words: (learnt.extend(words), learn(words)))
    for batch in range(12):
        texts = [" ".join(f"Usual{chr(97 + i)}, rare{chr(97 + batch)}{chr(97 + i)}" for i in range(12)), None, "usuala"]
        ids, offsets = coder.encode(pa.array(texts))
        assert [[*ids[a:b].tolist(), 2] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [coded(library, t or "") for t in texts]
    assert len(learnt) > 140 and learnt.count("usuala") == 1
    assert len(coder.known) == len(coder.uses) == len(coder.starts) - 1 < 80


@pytest.mark.parametrize("most", [0, 5])
def test_store_too_small_for_common_words(library, most):
    coder = tokens.WordEncoder(public_tokenizers.path(tokens.VOCABULARY), most=most)
    for _ in range(5):
        ids, _ = coder.encode(pa.array(["one two three four five six seven"]))
        assert [*ids.tolist(), 2] == coded(library, "one two three four five six seven")
