import re

import pytest
from cadenza.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    found = sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "CC-BY cc by Cc, bY", "all rights reserved " * 700 + "all rights", None, "", "GNU General Public License", "general public", "ALL RIGHTS. Reserved!", "cc",
    "Licensed under the Apache License, Version 2.0. More text", "licensed under the apache license version 3", "Copyright (c) 2020 Some Holder. All rights reserved.", "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "ÀLL rights reserved", "x " * 5000 + "all rights reserved",
]


def test_base_as_brute_force(spark, small):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    rows = {r.doc_id: r for r in L.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in L.scan(docs).collect()}
    assert labels[8] == "notice-apache-2" and labels[9] == "" and labels[10] == "notice-copyright,reserved"
    assert labels[11] == "notice-mit" and labels[12] == "cc-by,notice-cc-by" and labels[13] == "gpl,notice-gpl"
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_texts(spark):
    """Replaceable and optional regions may differ; one other mandatory word is no match."""
    texts = [MIT, MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "SOME COMPANY INC"), MIT.replace("this permission notice", "this permission notice (including the next paragraph)"), MIT.replace("sublicense", "relicense"), "x " * 300 + MIT]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert ["license-mit" in rows[i].labels for i in range(5)] == [True, True, True, False, True]
    assert all("text-mit" in rows[i].labels for i in range(5)) and rows[0].score == 1.0
    for label, markup in L.TEMPLATES.items():
        codes = {w: i + 1 for i, w in enumerate(sorted(set(L.re.findall(r"[a-z0-9]+", markup))))}
        shortest = [codes[w] for w in min((a for a in [least(L.parse(markup))]), key=len) if w != "?"]
        assert L.TokenAutomaton(markup, codes).longest(shortest) == len(shortest), label


def least(sequence):
    """The shortest word list that a parsed template accepts."""
    out = []
    for kind, what in sequence:
        out += [what] if kind == "word" else [] if kind == "any" else min((least(choice) for choice in what), key=len)
    return out


def alternatives(sequence):
    """All word lists that a parsed template accepts, with ? for a replaceable word."""
    out = [[]]
    for kind, what in sequence:
        if kind == "word":
            ends = [[what]]
        elif kind == "any":
            ends = [["?"] * n for n in range(what + 1)]
        else:
            ends = [x for choice in what for x in alternatives(choice)]
        out = [a + b for a in out for b in ends]
    return out


@pytest.mark.parametrize("markup", ["a [b] c", "a (b c|d) {2} e", "a [b [c]] [(d|e)] f", "{2} a", "a {1}"])
def test_automaton_as_enumeration(markup):
    import itertools

    codes = {w: i + 1 for i, w in enumerate("abcdef")}
    automaton = L.TokenAutomaton(markup, codes)
    accepted = alternatives(L.parse(markup))
    fits = lambda w, a: len(w) == len(a) and all(y in ("?", x) for x, y in zip(w, a, strict=True))
    for n in range(6):
        for w in itertools.product("abcdef", repeat=n) if n < 5 else itertools.product("abce", repeat=5):
            best = max((len(a) for a in accepted if any(fits(w[: len(a)], a) for _ in [0])), default=0)
            assert automaton.longest([codes[x] for x in w]) == best, w
