"""Token ids of whole texts with the tokenizers library.

This vocabulary drops white space and never joins across it, so a text's ids are those of its words in turn. Each
batch's different words are found in Arrow, new ones go through the library, and known ones come from a bounded store.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from cadenza.llm import _text as T

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
KNOWN_WORDS = 600_000
_TOGETHER = 4096  # new words that go through the library at once
#: Letters that stay letters when they are normalised (NFC) and lower-cased. İ gets a combining dot, and letters of other scripts
#: can fall apart under NFC; a mark would join the punctuation behind it, so words with such letters are coded whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ƿǍ-ʯΆΈ-ΊΌΎ-ΡΣ-ώА-яЀ-ҁҊ-ԯ"
_TAIL = rf"^(?P<head>[{_LETTERS}]+)(?P<tail>[!-&(-/:-@\[-`{{-~]+)$"

_encoders: dict[str, WordEncoder] = {}
T.stores.append(_encoders)


class WordEncoder:
    """Ids by word, for a tokenizer that treats the words between ASCII white space one by one."""

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Only words that came up in more than one batch since the last time stay; none if these alone are too many."""
        keep = self.uses > 1
        if keep.sum() > self.most // 2:
            self._clear()
            return
        counts = np.diff(self.starts)[keep]
        self.ids = self.ids[T.ranges(self.starts[:-1][keep], counts)]
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.known = {word: i for i, word in enumerate(compress(self.known, keep.tolist()))}  # a dict keeps the order of its words
        self.uses = np.ones(len(self.known), np.int32)

    def _learn(self, words: list[str]) -> None:
        counts, ids = [], []
        for at in range(0, len(words), _TOGETHER):
            some = words[at : at + _TOGETHER]
            coded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some)))
            ids.append(np.array(coded.ids, np.uint32))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts))])
        self.ids = np.concatenate([self.ids, *ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int32)])

    def _places(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in the store, after learning what is new."""
        if len(self.known) > self.most:
            self._shrink()
        new = list(set(words) - self.known.keys())
        if new:
            self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.uses[places] += 1
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets of texts); nulls are empty."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        spelled, at = coded.dictionary, coded.indices.to_numpy()
        # punctuation after letters is a word of its own to this vocabulary, so both parts are kept apart
        parts = pc.extract_regex(spelled, pattern=_TAIL)
        two = np.asarray(parts.is_valid())
        head = pc.if_else(parts.is_valid(), pc.struct_field(parts, "head"), spelled)
        tail = pc.fill_null(pc.struct_field(parts, "tail"), "")
        plain = pc.string_is_ascii(head)
        head, tail = pc.if_else(plain, pc.ascii_lower(head), head).dictionary_encode(), tail.dictionary_encode()
        places = self._places([*head.dictionary.to_pylist(), *tail.dictionary.to_pylist()])
        first = places[head.indices.to_numpy()]
        second = places[len(head.dictionary) + tail.indices.to_numpy()]
        counts = np.diff(self.starts)
        one, more = counts[first], np.where(two, counts[second], 0)
        # ids of each different word, then of all words
        size = one + more
        begin = np.cumsum(size) - size
        own = np.zeros(int(size.sum()), np.uint32)
        own[T.ranges(begin, one)] = self.ids[T.ranges(self.starts[first], one)]
        own[T.ranges(begin + one, more)] = self.ids[T.ranges(self.starts[second], more)]
        lengths = size[at]
        ids = own[T.ranges(begin[at], lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[offsets]


def encoder(path: str | None = None) -> WordEncoder:
    """One encoder for each vocabulary and worker process. path: a tokenizers file; by default the public word vocabulary."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    stops = offsets[1:] + np.arange(n)
    keep[stops] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)
