"""License notices, found by token automata that are compiled from template markup.

Markup: words stand for themselves; `[...]` is optional; `(a b|c)` is one of several; `{n}` is a replaceable region of up to n
words. All other wording is mandatory and must match word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import table

#: Fixed phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "notice-apache-2": "licensed under the apache license version 2 0 [the license] [you may not use this file except in compliance with the license]",
    "notice-cc-by": "licensed under [(a|the)] (cc by|creative commons attribution) [(nc|noncommercial)] [(sa|nd|sharealike|noderivatives)] [(2|3|4) (0|5)] [international] [license]",
    "notice-gpl": "licensed under the [terms of the] gnu [(lesser|affero)] general public license [as published by the free software foundation] [[either] version (1|2|3) [of the license] [or [at your option] any later version]]",
    "notice-mit": "(released|licensed|distributed|available) under [the [terms of the]] mit license",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction {40} subject to the following conditions",
    "text-bsd": "redistribution and use in source and binary forms with or without modification are permitted [provided that the following conditions are met]",
    "text-warranty": "(provided|distributed) [by {12}] [in the hope that it will be useful but] (as is|without) [and] [any] [express or implied] (warranty|warranties)",
    "notice-copyright": "copyright [c] {8} all rights reserved",
    "notice-spdx": "spdx license identifier {4}",
    # whole licence texts; names of holders are replaceable, numbering and usual insertions optional
    "license-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    " in no event shall {12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "license-isc": "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    " the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    " in no event shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
    " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "license-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    " [[3] neither the name of {12} nor the names of {2} contributors may be used to endorse or promote products derived from this software without specific prior written permission]"
    " this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "license-zlib": "this software is provided as is without any express or implied warranty in no event will {6} be held liable for any damages arising from the use of this software"
    " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    " [1] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
    " [2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may not be removed or altered from any source distribution",
}


def parse(markup: str) -> list:
    """Markup to nested lists of ("word", w), ("any", n) and ("one", [sequences])."""
    pieces = re.findall(r"[\[\]()|]|\{\d+\}|[^\s\[\](){}|]+", markup)
    at = 0

    def sequence(stop: str) -> list:
        nonlocal at
        out = []
        while at < len(pieces) and pieces[at] not in stop:
            piece = pieces[at]
            at += 1
            if piece in "[(":
                close = "]" if piece == "[" else ")"
                choices = [sequence("|" + close)]
                while pieces[at] == "|":
                    at += 1
                    choices.append(sequence("|" + close))
                at += 1
                out.append(("one", choices + [[]] * (piece == "[")))
            elif piece[0] == "{":
                out.append(("any", int(piece[1:-1])))
            else:
                out.append(("word", piece))
        return out

    return sequence("")


class TokenAutomaton:
    """A template as an automaton over word codes; its deterministic states are made when they are first reached."""

    def __init__(self, markup: str, codes: dict[str, int]):
        self.words: list[dict[int, set[int]]] = []
        self.any: list[set[int]] = []
        self.empty: list[set[int]] = []
        first = self._state()
        self.end = self._add(parse(markup), first, codes)
        self.first = self._closed({first})
        self.seen: dict[tuple[frozenset, int], frozenset] = {}

    def _state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.empty.append(set())
        return len(self.words) - 1

    def _add(self, sequence: list, at: int, codes: dict[str, int]) -> int:
        for kind, what in sequence:
            if kind == "word":
                to = self._state()
                self.words[at].setdefault(codes[what], set()).add(to)
                at = to
            elif kind == "any":
                end = self._state()
                for _ in range(what):
                    self.empty[at].add(end)
                    to = self._state()
                    self.any[at].add(to)
                    at = to
                self.empty[at].add(end)
                at = end
            else:
                ends = [self._add(choice, at, codes) for choice in what]
                to = self._state()
                for end in ends:
                    self.empty[end].add(to)
                at = to
        return at

    def _closed(self, states: set[int]) -> frozenset:
        todo, done = list(states), set(states)
        while todo:
            for to in self.empty[todo.pop()] - done:
                done.add(to)
                todo.append(to)
        return frozenset(done)

    def step(self, states: frozenset, code: int) -> frozenset:
        to = self.seen.get((states, code))
        if to is None:
            reached: set[int] = set()
            for s in states:
                reached |= self.words[s].get(code, set()) | self.any[s]
            to = self.seen[states, code] = self._closed(reached)
        return to

    def starts(self) -> set[int]:
        return {code for s in self.first for code in self.words[s]}

    def seconds(self) -> set[int] | None:
        """Codes of the word after the first; None if any word may follow."""
        found: set[int] = set()
        for code in self.starts():
            states = self.step(self.first, code)
            if self.end in states or any(self.any[s] for s in states):
                return None
            found |= {c for s in states for c in self.words[s]}
        return found

    def longest(self, codes: list[int]) -> int:
        """Words of the longest accepted beginning, or 0."""
        states, best = self.first, 0
        for n, code in enumerate(codes, 1):
            states = self.step(states, code)
            if not states:
                break
            if self.end in states:
                best = n
        return best


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES):
        spelled = sorted({w for p in base for w in p.split()} | {w for m in templates.values() for w in re.findall(r"[^\s\[\](){}|]+", re.sub(r"\{\d+\}", " ", m))})
        data, offsets = T.buffers(pa.array([" ".join(spelled)]))
        starts, ends, _ = T.words(data, offsets, T.WORD_ALNUM)
        if len(starts) != len(spelled):
            raise ValueError("template words must be lower-case words of letters and digits")
        hashes = T.Rolling(data).of(starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], (order + 1).astype(np.int32)
        self.spelled = [b"", *(w.encode() for w in spelled)]
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(hashes >> np.uint64(48)).astype(np.int64)] = True
        codes = {w: k + 1 for k, w in enumerate(spelled)}
        self.base = [(label, TokenAutomaton(phrase, codes), [codes[w] for w in phrase.split()]) for phrase, label in base.items()]
        self.templates = [(label, TokenAutomaton(m, codes)) for label, m in templates.items()]
        n = len(spelled) + 1
        self.pairs = []
        for _, automaton, *_ in [*self.base, *self.templates]:
            first, second = np.zeros(n, bool), np.zeros(n, bool)
            first[list(automaton.starts())] = True
            after = automaton.seconds()
            second[:] = after is None
            second[list(after or ())] = True
            self.pairs.append((first, second))

    def word_codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """0 for words of no template; a word's letters are compared, not only its hash."""
        out = np.zeros(len(starts), np.int32)
        hashes = T.spans_hashed(data, starts, ends)
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(48)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[near] == hashes[at]
        at, code = at[same], self.codes[near[same]]
        long = np.array([len(w) for w in self.spelled])[code]
        right = ends[at] - starts[at] == long
        at, code, long = at[right], code[right], long[right]
        if len(at):
            letters = np.frombuffer(b"".join(self.spelled), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(w) for w in self.spelled])])[code]
            equal = np.logical_and.reduceat(data[T.ranges(starts[at], long)] == letters[T.ranges(begin, long)], np.cumsum(long) - long)
            out[at[equal]] = code[equal]
        return out

    def scan(self, texts: pa.Array) -> dict[str, list]:
        data, offsets = T.buffers(texts)
        data = T.LOWER_AZ[data]
        starts, ends, first = T.words(data, offsets, T.WORD_ALNUM)
        codes = self.word_codes(data, starts, ends)
        n = len(texts)
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set] = [set() for _ in range(n)]
        more: list[set] = [set() for _ in range(n)]
        spans: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
        after = np.append(codes[1:], 0)
        for k, (label, automaton, *phrase) in enumerate([*self.base, *self.templates]):
            begins, follows = self.pairs[k]
            at = np.flatnonzero(begins[codes] & follows[after])
            for p, text in zip(at.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist(), strict=True):
                stop = int(first[text + 1])
                size = automaton.longest(_codes_until(codes, p, stop))
                if not size:
                    continue
                if phrase:
                    places[text].append(p - int(first[text]))
                    base[text].add(label)
                else:
                    more[text].add(label)
                spans[text].append((p - int(first[text]), size, label))
        covered = [len({w for a, size, _ in s for w in range(a, a + size)}) for s in spans]
        words = np.diff(first).tolist()
        return {
            "n_words": words, "n_base": [len(p) for p in places], "first_word": [min(p, default=None) for p in places], "last_word": [max(p, default=None) for p in places],
            "base_labels": [",".join(sorted(b)) for b in base], "labels": [",".join(sorted(b | m)) for b, m in zip(base, more, strict=True)],
            "score": [c / w if w else 0.0 for c, w in zip(covered, words, strict=True)], "spans": spans,
        }


class _codes_until:
    """Codes p .. stop one by one, without a copy of a long text's rest."""

    def __init__(self, codes: np.ndarray, p: int, stop: int):
        self.codes, self.p, self.stop = codes, p, stop

    def __iter__(self):
        for a in range(self.p, self.stop, 64):
            yield from self.codes[a : min(a + 64, self.stop)].tolist()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())]))
_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A-Z count as lower case; words are runs of ASCII letters and digits and of anything beyond ASCII. n_base counts all places of
    the fixed phrases; labels adds those of accepted templates; score is the share of words that any of them covers; spans are all
    accepted places (start and length in words, label). A null or empty text has no words, no labels and score 0. Repeated rows each
    give a row; very long texts are scanned whole; other columns don't matter; an empty table gives none. One pass, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(base, templates)
        for whole in batches:
            for batch in T.slices(whole, "text"):
                found = scanner.scan(batch.column(1))
                spans = pa.array([[{"start": a, "length": n, "label": x} for a, n, x in s] for s in found["spans"]], _SPANS)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c], k) for c, k in _KINDS.items()), spans], names=["doc_id", *_KINDS, "spans"])

    fields = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,length:long,label:string>>"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, fields)


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed phrases and licence templates in every document.

    Null and empty texts have no words and no labels; repeated rows each give a row; an empty table gives none.
    """
    return scan(table(spark, sf_dir, "documents")).drop("spans")
