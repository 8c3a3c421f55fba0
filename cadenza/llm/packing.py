"""Harmonic packing of token sequences: pieces of about 1/k of the capacity stand k to a sequence."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm import tokens
from cadenza.llm._io import table, written

CAPACITY = 4096
#: Share of a sequence that a class may leave empty; a document that would leave more is cut.
SLACK = 0.02


@functools.lru_cache(1 << 16)
def cut(n: int, capacity: int, slack: float) -> tuple[tuple[int, int], ...]:
    """(length, class) of a document's pieces. A class k holds lengths over capacity/(k+1) and up to capacity/k.

    Whole sequences go first. What is left stays in one piece if k of its like leave little; else a piece of the next
    class's full length is cut off and the shorter rest is looked at again.
    """
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - slack) * capacity:
            pieces.append((rest, k))
            break
        pieces.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return tuple(pieces)


def _pieces(keep: list[str], capacity: int, slack: float, end: int, vocabulary: str | None, with_ids: bool):
    def run(batches):
        coder = tokens.encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in T.slices(whole, "text", 10 << 20, keep=True):
                ids, offsets = tokens.with_end(*coder.encode(batch.column(batch.schema.get_field_index("text"))), end)
                raw = memoryview(np.ascontiguousarray(ids, np.dtype("<u4"))).cast("B")
                row, start, length, crc, kind, rank, at = [], [], [], [], [], [], []
                for i, n in enumerate(np.diff(offsets).tolist()):
                    done = 0
                    for size, k in cut(n, capacity, slack):
                        a = int(offsets[i]) + done
                        row.append(i)
                        start.append(done)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * a : 4 * (a + size)]))
                        kind.append(k)
                        seen[k] = seen.get(k, -1) + 1
                        rank.append(seen[k])
                        at.append(a)
                        done += size
                row = np.array(row, np.int64)
                columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in keep]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(np.diff(offsets)[row]), pa.array(kind, pa.int32()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank, pa.int64())]
                names = [*keep, "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _fill(capacity: int, base: int):
    """First fit by falling length, for the pieces that fill no bin of their class."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "class", "index"], ascending=[False, True, True])
        left: list[int] = []
        sequence, offset = [], []
        hint: dict[int, int] = {}  # bins before this one have no room for that length
        for n in rows["length"].tolist():
            b = hint.get(n, 0)
            while b < len(left) and left[b] < n:
                b += 1
            if b == len(left):
                left.append(capacity)
            hint[n] = b
            sequence.append(base + b)
            offset.append(capacity - left[b])
            left[b] -= n
        return rows.assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, slack: float = SLACK, end: int = tokens.END_ID, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Documents are coded and cut where they lie; only pieces' numbers move. Each class numbers its pieces across all workers
    (a count for each worker and class, summed up), and k neighbours of class k make a sequence. The fewer than k
    pieces that a class has over are bounded by the capacity alone, whatever the corpus: less than one sequence for each of
    at most 2*sqrt(capacity) classes. They are packed together by first fit.
    A null or empty text has only the end id. Equal rows each get their own pieces. A text longer than the capacity fills whole
    sequences first; other columns don't matter; an empty table gives no row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long" + ", ids array<int>" * with_ids
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(["doc_id"], capacity, slack, end, vocabulary, with_ids), fields))
    counts = pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).drop("n")
    totals = sorted((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect())  # at most 2*sqrt(capacity) rows
    full, base = {}, 0
    for k, n in totals:
        full[k] = (base, n // k * k)
        base += n // k
    of = lambda place: F.element_at(F.create_map(*[F.lit(x) for k, v in full.items() for x in (k, v[place])]), F.col("class")).cast("long") if full else F.lit(0).cast("long")
    numbered = pieces.join(before, ["part", "class"]).withColumn("index", F.col("before") + F.col("rank")).drop("part", "rank", "before")
    numbered = numbered.withColumns({"base": of(0), "whole": of(1)})
    in_class = numbered.where("index < whole").withColumn("sequence_id", F.col("base") + F.expr("index div class"))
    earlier = Window.partitionBy("sequence_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    in_class = in_class.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))
    over = numbered.where("index >= whole").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    over = over.groupBy().applyInPandas(_fill(capacity, base), over.schema)
    return in_class.unionByName(over).drop("class", "index", "base", "whole")


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens.

    Null and empty texts are the end id alone; repeated rows of one doc_id are documents of their own; an empty table gives no row.
    """
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
