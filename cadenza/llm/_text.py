"""Vectorised helpers on Arrow string columns: bytes, words, rolling hashes.

Everything here works on one Arrow batch at a time, inside a Spark task.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xC2B2AE3D27D4EB4F | 1
_STEP_INV = pow(_STEP, -1, 1 << 64)

#: Bytes that separate words: ASCII white space, or everything in ASCII that is no letter or digit.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD_UNCHANGED = ~SPACES
WORD_ALNUM = np.ones(256, bool)
WORD_ALNUM[0x00:0x30] = WORD_ALNUM[0x3A:0x41] = WORD_ALNUM[0x5B:0x61] = WORD_ALNUM[0x7B:0x80] = False
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of any slice of a sequence of unsigned integers, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int = _BASE, inverse: int = _BASE_INV):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.prefix[1:])
        self.inverse = powers(inverse, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the slice of `size` values that starts at each place (none if too short)."""
        n = max(0, len(self.prefix) - size)
        return mix((self.prefix[size : size + n] - self.prefix[:n]) * self.inverse[:n] + np.uint64(size * 0xA24BAED4963EE407 % 2**64))


def steps(values: np.ndarray) -> Rolling:
    """Rolling hashes over hashed words (another base than over bytes)."""
    return Rolling(values, _STEP, _STEP_INV)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system: idle workers would keep it while others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Stores of a worker process that one kind of work needs; other work empties them, as workers outlive a stage.
stores: list[dict] = []


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about `most` bytes of text (one longer text stands alone). keep: leave the stores."""
    if not keep:
        for store in stores:
            store.clear()
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def spans_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Hash of each of some spans in rising order, as Rolling gives it; memory is bounded by `most` bytes or the longest span."""
    if len(data) <= 2 * most:
        return Rolling(data).of(starts, ends)
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        low = int(starts[at])
        out[at:to] = Rolling(data[low : int(ends[to - 1])]).of(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each text, and where each text's words begin (length texts + 1)."""
    inside = table[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] |= inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    stops[edges] |= inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the words end to end, each with a space behind it."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=offsets[1:])
    joined = np.full(int(offsets[-1]), 0x20, np.uint8)
    joined[ranges(offsets[:-1], lengths)] = data[ranges(starts, lengths)]
    return joined, offsets


def dictionary(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each slice, the different slices): equal codes are equal bytes."""
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 16) -> bytes:
    """BLAKE2b of each span, end to end."""
    view = memoryview(np.ascontiguousarray(data))
    blake = hashlib.blake2b
    return b"".join([blake(view[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word, eight bytes at a time, each time fully mixed: words of up to eight bytes and one length never share a hash."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    left = ends - starts
    out = mix(left.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    which, at = np.arange(len(starts)), starts
    while len(which):
        chunk = padded[at[:, None] + np.arange(8)].view(np.uint64).ravel()
        short = np.minimum(left, 8).astype(np.uint64)
        chunk &= ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * short)
        out[which] = mix(out[which] ^ chunk)
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return out


def gram_hashes(words_: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the words [begin, end) each, mixed word by word."""
    out = mix((end - begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    for k in range(int((end - begin).max(initial=0))):
        inside = begin + k < end
        if inside.all():
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ words_[begin + k])
        else:
            out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) ^ words_[begin[inside] + k])
    return out


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` neighbouring values, by block prefixes and suffixes."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, size)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each of the given lengths, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Boolean mask of the places that some [start, start + length) covers."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1], out=change[:-1]) > 0
