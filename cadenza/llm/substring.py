"""Repeated word passages, found by suffix automata of reference shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import bucketed, distinct_texts, joined, numbered, table, text_key
from cadenza.llm._repeats import repeated_spans

SIZE = 35
GRAM = 16


class SuffixAutomaton:
    """Suffix automaton of several sequences. A state stands for strings that end at the same places."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places = [0]

    def _extend(self, last: int, symbol: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if symbol in nexts[last]:
            to = nexts[last][symbol]
            return to if length[to] == length[last] + 1 else self._split(last, symbol, to)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        while last != -1 and symbol not in nexts[last]:
            nexts[last][symbol] = new
            last = link[last]
        if last != -1:
            to = nexts[last][symbol]
            link[new] = to if length[to] == length[last] + 1 else self._split(last, symbol, to)
        return new

    def _split(self, state: int, symbol: int, to: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        twin = len(nexts)
        nexts.append(nexts[to].copy())
        link.append(link[to])
        length.append(length[state] + 1)
        link[to] = twin
        while state != -1 and nexts[state].get(symbol) == to:
            nexts[state][symbol] = twin
            state = link[state]
        return twin

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def count(self, sequences: list[list[int]], weights: list[int]) -> None:
        """Counts the places of every state's strings; the sequences must have been added."""
        nexts, link, length = self.next, self.link, self.length
        places = self.places = [0] * len(nexts)
        for sequence, weight in zip(sequences, weights, strict=True):
            state = 0
            for symbol in sequence:
                state = nexts[state][symbol]
                places[state] += weight
        for state in sorted(range(1, len(nexts)), key=length.__getitem__, reverse=True):
            places[link[state]] += places[state]

    def repeated(self, sequence: list[int], size: int) -> list[bool]:
        """Streams a sequence: for each place, whether the `size` symbols that end there have two places.

        The matching statistic is the longest suffix read so far that the reference holds; it is followed along the
        suffix links and cut to `size`.
        """
        nexts, link, length, places = self.next, self.link, self.length, self.places
        state = matched = 0
        out = []
        for symbol in sequence:
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            if matched >= size:
                matched = size
                while length[link[state]] >= size:
                    state = link[state]
                out.append(places[state] > 1)
            else:
                out.append(False)
        return out


def repeated_windows(units: np.ndarray, offsets: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Flags of the window starts in a shard's words, numbered by spelling, whose `size` words have another place.

    The shard's automaton is built from all of its passages, which then stream through it; nothing else decides.
    """
    flags = np.zeros(len(units), bool)
    _, symbols = np.unique(units, return_inverse=True)
    sequences = [symbols[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    automaton = SuffixAutomaton()
    for sequence in sequences:
        automaton.add(sequence)
    automaton.count(sequences, weights.tolist())
    for at, sequence in zip(offsets.tolist(), sequences, strict=False):
        flags[at : at + max(0, len(sequence) - size + 1)] = automaton.repeated(sequence, size)[size - 1 :]
    return flags


def repeated_word_spans(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(key_a, key_b, spans) of distinct texts: runs of starts, in words, of passages of `size` words that occur twice.

    The corpus is its own reference, so an automaton of all of it would have no size bound to broadcast. Reference shards
    are dealt by anchor with the passages that can match them, which makes every automaton local to one task.
    """
    return repeated_spans(texts, repeated_windows, size=size, gram=min(GRAM, size), words=True, kernel_on_copies=True)


def _digest(size: int):
    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, at = T.buffers(batch.column(batch.schema.get_field_index("text")))
                starts, ends, first = T.words(data, at, T.WORD_UNCHANGED)
                spans = batch.column(batch.schema.get_field_index("spans"))
                kept = np.ones(len(starts), bool)
                for i in np.flatnonzero(np.asarray(spans.is_valid())):
                    found = spans[int(i)].values
                    kept[first[i] : first[i + 1]] = ~T.covered(found.field("start").to_numpy(), found.field("length").to_numpy() + size - 1, first[i + 1] - first[i])
                left = np.concatenate([[0], np.cumsum(kept)])[first]
                starts, ends = starts[kept], ends[kept]
                lengths = ends - starts
                to = np.concatenate([[0], np.cumsum(lengths + 1)])
                joined = np.full(int(to[-1]), 0x20, np.uint8)
                joined[T.ranges(to[:-1], lengths)] = data[T.ranges(starts, lengths)]
                raw = memoryview(joined)
                sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(to[left[:-1]].tolist(), to[left[1:]].tolist(), strict=True)]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n - np.diff(left)), pa.array(sha)], names=["key_a", "key_b", "n_words", "n_removed", "kept_sha256"])

    return run


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256. A null text has no words; repeated rows of one doc_id each give
    a row and count as places; an empty table gives none. Very long texts are hashed in pieces and never cut. Other columns don't matter."""
    texts = bucketed(distinct_texts(docs), "key_a", "key_b")
    found = joined(texts, repeated_word_spans(texts, size), ["key_a", "key_b"], "left")
    by_text = found.mapInArrow(_digest(size), "key_a long, key_b long, n_words long, n_removed long, kept_sha256 string")
    return joined(docs.select("doc_id", *text_key()), by_text, ["key_a", "key_b"]).drop("key_a", "key_b")


def _kept(size: int):
    def run(batches):
        for whole in batches:
            for batch in T.slices(whole, "text"):
                data, at = T.buffers(batch.column(batch.schema.get_field_index("text")))
                starts, ends, first = T.words(data, at, T.WORD_UNCHANGED)
                spans = batch.column(batch.schema.get_field_index("spans"))
                kept = []
                for i in range(batch.num_rows):
                    found = spans[i].values
                    keep = ~T.covered(found.field("start").to_numpy(), found.field("length").to_numpy() + size - 1, first[i + 1] - first[i])
                    own = zip(starts[first[i] : first[i + 1]][keep].tolist(), ends[first[i] : first[i + 1]][keep].tolist(), strict=True)
                    raw = data.tobytes() if batch.num_rows == 1 else data[at[i] : at[i + 1]].tobytes()
                    kept.append(b" ".join(raw[a - at[i] : b - at[i]] for a, b in own).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], names=["key_a", "key_b", "kept"])

    return run


def without_passages(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs whose repeated passages of `size` words are gone; such texts' words are joined by one space, others stay as they are."""
    texts = bucketed(distinct_texts(docs), "key_a", "key_b")
    hit = joined(texts, repeated_word_spans(texts, size), ["key_a", "key_b"]).mapInArrow(_kept(size), "key_a long, key_b long, kept string")
    plain, names = numbered(docs)
    text = F.col(names["text"])
    out = joined(plain.select("*", *text_key(names["text"])), hit, ["key_a", "key_b"], "left")
    fresh = {"text": F.when(text.isNotNull(), F.coalesce("kept", text))}
    return out.select(*[fresh.get(c, F.col(n)).alias(c) for c, n in names.items()])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, those in passages of 35 words that occur twice, and a digest of the rest.

    Null, empty and short texts have nothing to remove; equal rows are places of their own; an empty table gives none.
    """
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
