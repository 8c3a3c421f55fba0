"""Token ids in wavelet matrices: succinct bit planes with rank and select, one table file for each shard."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm import tokens
from cadenza.llm._io import shared_dir, table

#: Tokens of a block, about: blocks end with the document that fills them.
BLOCK = 1 << 20
_STEP = 512  # bits between two entries of the rank directory

_FILE = "shard int, block int, first long, n long, alphabet binary, zeros array<long>, planes array<binary>, ranks array<binary>, doc_ids array<long>, doc_starts array<long>"


class WaveletMatrix:
    """A sequence of ids as bit planes from the highest bit of each id's place in the sorted alphabet to the lowest.

    Behind a plane, the entries with bit 0 come first and keep their order, then those with bit 1. So access, rank and
    select each take one rank or select query a plane.
    """

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.alphabet, self.zeros = n, alphabet, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        place = np.cumsum(present) - 1
        width = max(1, int(len(alphabet) - 1).bit_length())
        kind = np.uint16 if width <= 16 else np.uint32
        at = place.astype(kind)[ids]
        zeros, planes, ranks = [], [], []
        for level in range(width - 1, -1, -1):
            bits = (at >> kind(level)) & kind(1) != 0
            packed = np.packbits(bits, bitorder="little")
            padded = np.zeros(-(-len(packed) // (_STEP // 8)) * (_STEP // 8), np.uint8)
            padded[: len(packed)] = packed
            counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _STEP // 64).sum(axis=1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32).tobytes())
            low = at[~bits]
            zeros.append(len(low))
            at = np.concatenate([low, at[bits]])
        return cls(len(ids), alphabet, zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the last to the first."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        at = np.zeros(self.n, kind)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bits = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            before = np.empty(self.n, kind)
            before[~bits] = at[:zeros]
            before[bits] = at[zeros:] | kind(1 << level)
            at = before
        return self.alphabet[at] if len(self.alphabet) else np.zeros(0, np.uint32)

    def _ones(self, plane: int, i: int) -> int:
        block = i // _STEP
        bits = self.planes[plane][block * _STEP // 8 : -(-i // 8)]
        count = int(np.bitwise_count(bits).sum())
        if i % 8 and len(bits):
            count -= int(bits[-1] >> (i % 8)).bit_count()
        return int(self.ranks[plane][block]) + count

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i // 8] >> (i % 8)) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        code = 0
        for plane, zeros in enumerate(self.zeros):
            bit = self._bit(plane, i)
            ones = self._ones(plane, i)
            i = zeros + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for plane, zeros in enumerate(self.zeros):
            a, b = self._ones(plane, low), self._ones(plane, high)
            low, high = (zeros + a, zeros + b) if code >> (len(self.zeros) - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often the id stands before place `end`."""
        code = self._code(token)
        if code is None:
            return 0
        low, high = self._range(code, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        ranks = self.ranks[plane].astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks)) * _STEP - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * _STEP // 8 : (block + 1) * _STEP // 8], bitorder="little")
        return block * _STEP + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the id's occurrence number k, from 0."""
        code = self._code(token)
        if code is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(code, self.n)[0] + k
        for plane in range(len(self.zeros) - 1, -1, -1):
            bit = code >> (len(self.zeros) - 1 - plane) & 1
            at = self._select_bit(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def matrix_of(row) -> WaveletMatrix:
    """The matrix of one row of the table that `write` makes."""
    return WaveletMatrix(row["n"], np.frombuffer(row["alphabet"], np.uint32), list(row["zeros"]), list(row["planes"]), list(row["ranks"]))


def _blocks(end: int, vocabulary: str | None):
    def run(batches):
        coder = tokens.encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        first = block = 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def flush():
            nonlocal first, block, held, size
            ids = np.concatenate([x[0] for x in held])
            lengths = np.concatenate([x[1] for x in held])
            m = WaveletMatrix.of(ids)
            row = {
                "shard": shard, "block": block, "first": first, "n": m.n, "alphabet": m.alphabet.tobytes(), "zeros": m.zeros,
                "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks],
                "doc_ids": [d for x in held for d in x[2]], "doc_starts": (np.cumsum(lengths) - lengths).tolist(),
            }
            first, block, held, size = first + m.n, block + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for whole in batches:
            for batch in T.slices(whole, "text", 20 << 20, keep=True):
                ids, offsets = tokens.with_end(*coder.encode(batch.column(batch.schema.get_field_index("text"))), end)
                docs = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                at = 0
                while at < len(docs):
                    to = min(len(docs), max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK - size))))
                    held.append((ids[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1]), docs[at:to]))
                    size += int(offsets[to] - offsets[at])
                    at = to
                    if size >= BLOCK:
                        yield flush()
        if held:
            yield flush()

    return run


_LONGS, _BINARIES = pa.list_(pa.int64()), pa.list_(pa.binary())
_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("alphabet", pa.binary()), ("zeros", _LONGS), ("planes", _BINARIES), ("ranks", _BINARIES), ("doc_ids", _LONGS), ("doc_starts", _LONGS)])


def write(docs: DataFrame, path: str, end: int = tokens.END_ID, vocabulary: str | None = None) -> None:
    """Writes documents' ids in ascending doc_id order (nulls first, equal ids by text) as one compressed file a shard.

    doc_id is a long. A null or empty text has only the end id; repeated rows each stand in the files; a very long text is a block of its
    own; other columns don't matter; an empty table gives files without documents. A shard is a range of doc_ids. Its file holds blocks of about BLOCK ids, each a wavelet matrix with its documents' starts.
    Spark's own writer commits the files, so lost executors leave no half shard, on any store.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text").alias("tie")  # only puts rows of one doc_id in order; texts decide where it is equal
    dealt = docs.select("doc_id", "text", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    dealt.select("doc_id", "text").mapInArrow(_blocks(end, vocabulary), _FILE).write.option("compression", "zstd").parquet(path)


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = matrix_of(row).decode()
                starts = np.append(row["doc_starts"], row["n"])
                raw = memoryview(np.ascontiguousarray(ids, np.dtype("<u4"))).cast("B")
                columns = [
                    pa.array([row["shard"]] * len(row["doc_ids"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64()),
                ]
                names = ["shard", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and its ids."""
    files = spark.read.schema(_FILE).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n").alias("own"))
    before = totals.withColumn("base", F.sum("own").over(Window.orderBy("shard")) - F.col("own")).drop("own")  # one row a shard
    fields = "shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.mapInArrow(_documents(with_ids), fields).join(before, "shard")
    return rows.withColumn("start", F.col("base") + F.col("within")).select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op7_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the wavelet files.

    Null and empty texts are the end id alone; repeated rows of one doc_id stand one behind the other; an empty table gives no row.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read(spark, path, with_ids=False)
