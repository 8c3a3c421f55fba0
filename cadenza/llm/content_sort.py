"""Exact duplicates by a content sort: equal texts become neighbours, and neighbours are compared in full.

1. Texts are normalised (A-Z lower-cased, nothing else). Spark samples splitters and range-partitions the rows by their first bytes, then by
   the SHA-256 of all bytes, then by identifier. The digest stands in for the bytes behind the first ones, so that a splitter has a fixed
   size however long texts are, and the identifier lets a text with a third of all rows fill as many partitions as it needs.
2. Spark's external sort brings equal texts of a partition together, the identifier that stays first. Each row is compared with the row
   before it, byte by byte; equal neighbours form a run.
3. A run may go on in the next partition. Of each partition only the first and the last run can, so these carry their text. Neighbouring
   edges are compared in full as well, and what they join is at most two runs a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import drop, table, written

HEAD = 32  # first bytes that rows are dealt and sorted by, before the digest

_SORTED = "id long, text string, digest binary"
_RUNS = "id long, digest binary, size long, keep long, first boolean, part int, edge int, text string"


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, text) to (id, text, head, digest), A-Z lower-cased and null as empty."""
    for whole in batches:
        for batch in T.slices(whole, "text", 8 << 20):
            data, offsets = T.buffers(batch.column(1))
            data = T.LOWER_AZ[data]
            view = memoryview(data)
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            text = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
            head = pa.array([bytes(view[a : min(b, a + HEAD)]) for a, b in bounds], pa.binary())
            digest = pa.array([hashlib.sha256(view[a:b]).digest() for a, b in bounds], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, head, digest], names=["id", "text", "head", "digest"])


class _Run:
    """The run that is still open: its identifiers, text and digest."""

    def __init__(self, text: pa.Scalar, digest: pa.Scalar):
        self.text, self.digest, self.ids, self.size = text, digest, [], 0

    def add(self, ids: pa.Array) -> None:
        self.ids.append(ids)
        self.size += len(ids)

    def rows(self, part: int, edge: int) -> Iterator[pa.RecordBatch]:
        """Its rows; at a partition's edge the first of them carries the text."""
        keep, first = self.ids[0][0], True
        for ids in self.ids:
            n = len(ids)
            leads = np.zeros(n, bool)
            leads[0] = first
            text = pa.nulls(n, pa.string())
            if edge and first:
                text = pa.concat_arrays([pa.array([self.text.as_py()], pa.string()), pa.nulls(n - 1, pa.string())])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.repeat(self.digest, n), pa.repeat(pa.scalar(self.size, pa.int64()), n), pa.repeat(keep, n), pa.array(leads), pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(pa.scalar(edge, pa.int32()), n), text],
                names=["id", "digest", "size", "keep", "first", "part", "edge", "text"],
            )
            first = False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over sorted partitions: a row for each row, with its run's size and first identifier.

    edge is 1 in the partition's first run, 2 in its last, 3 if that is the same run, else 0. Of the open run only identifiers are held.
    """
    from pyspark import TaskContext

    part, run, begun = TaskContext.get().partitionId(), None, False
    for whole in batches:
        for batch in T.slices(whole, "text", 8 << 20, keep=True):
            ids, text, digest = batch.column(0), batch.column(1), batch.column(2)
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
            if run is not None and text[0].as_py() == run.text.as_py():
                fresh[0] = False
            starts = np.flatnonzero(fresh)
            lead = int(starts[0]) if len(starts) else batch.num_rows
            if lead:
                run.add(ids[:lead])
            if not len(starts):
                continue
            if run is not None:
                yield from run.rows(part, 0 if begun else 1)
                begun = True
            last = int(starts[-1])
            if len(starts) > 1:  # runs that begin and end in this batch
                if not begun:
                    run = _Run(text[int(starts[0])], digest[int(starts[0])])
                    run.add(ids[int(starts[0]) : int(starts[1])])
                    yield from run.rows(part, 1)
                    begun, starts = True, starts[1:]
                n = np.diff(starts)
                if len(n):
                    low = int(starts[0])
                    rows = last - low
                    at = pa.array(np.repeat(starts[:-1], n))
                    yield pa.RecordBatch.from_arrays(
                        [ids[low:last], digest[low:last], pa.array(np.repeat(n, n)), ids.take(at), pa.array(fresh[low:last]), pa.repeat(pa.scalar(part, pa.int32()), rows), pa.repeat(pa.scalar(0, pa.int32()), rows), pa.nulls(rows, pa.string())],
                        names=["id", "digest", "size", "keep", "first", "part", "edge", "text"],
                    )
            run = _Run(text[last], digest[last])
            run.add(ids[last:])
    if run is not None:
        yield from run.rows(part, 2 if begun else 3)


def _joined(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(part, edge, whole_size, whole_keep, leads) for the runs at partitions' edges; leads: the whole run begins there.

    edges: a row for each such run. Texts are compared on the executors; the driver sees numbers of two runs a partition, no text.
    """
    parts = sorted({r["part"] for r in edges.select("part").distinct().collect()})
    follows = spark.createDataFrame(list(zip(parts[1:], parts[:-1], strict=True)), "part int, before int")
    heads = edges.where("edge in (1, 3)").select("part", "text")
    tails = edges.where("edge in (2, 3)").select(F.col("part").alias("before"), F.col("text").alias("tail"))
    goes_on = {r["part"] for r in heads.join(follows, "part").join(tails, "before").where("text = tail").select("part").collect()}
    runs: list[list[tuple]] = []
    for r in sorted(edges.drop("text").collect(), key=lambda r: (r["part"], r["edge"])):
        if r["edge"] in (1, 3) and r["part"] in goes_on:
            runs[-1].append(r)
        else:
            runs.append([r])
    rows = [(r["part"], r["edge"], sum(x["size"] for x in run), run[0]["keep"], i == 0) for run in runs for i, r in enumerate(run)]
    return spark.createDataFrame(rows, "part int, edge int, whole_size long, whole_keep long, leads boolean")


def copies(docs: DataFrame, keep: str = "smallest", ident: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text). Equal texts form a group.

    keep: whether the smallest or the largest identifier stays. A null text counts as empty; a null identifier stays only where its group
    has no other. Of repeated rows of one identifier exactly one stays, and each counts in group_size. An empty table gives no rows. Texts of
    any length are compared whole. Other columns don't matter.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_normalised, "id long, text string, head binary, digest binary")
    dealt = rows.repartitionByRange(n, "head", "digest", order).sortWithinPartitions("head", "digest", "text", order)
    runs = written(dealt.select("id", "text", "digest").mapInArrow(_runs, _RUNS))
    ends = written(runs.where("edge > 0 and text is not null").select("part", "edge", "size", "keep", "text"))
    whole = _joined(spark, ends)
    drop(ends)
    edge = runs.where("edge > 0").join(F.broadcast(whole), ["part", "edge"])  # two rows a partition
    inner = runs.where("edge = 0").select("id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("first").alias("kept"), "digest")
    outer = edge.select("id", F.col("whole_keep").alias("keep_id"), F.col("whole_size").alias("group_size"), (F.col("first") & F.col("leads")).alias("kept"), "digest")
    return inner.unionByName(outer).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs without exact copies (up to the case of A-Z): of each group of equal texts one row stays, with all columns as they are."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    ident, text = F.col(names["doc_id"]), F.col(names["text"])
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    stay = copies(docs, keep).where("kept").select(F.col("id").alias("keep_id"), F.col("text_sha256").alias("keep_digest"))
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = plain.withColumn("digest", F.sha2(lower, 256)).join(stay, ident.eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest")), "left_semi")
    alone = found.groupBy(names["doc_id"], "digest").agg(*[F.first(c).alias(c) for c in names.values() if c != names["doc_id"]])
    return alone.select(*[F.col(n).alias(c) for c, n in names.items()])


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of equal texts, the largest doc_id of which stays: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, repeated rows of one doc_id are a group of their own size of which one stays, an empty table gives no rows.
    """
    return copies(table(spark, sf_dir, "documents"), "largest").withColumnRenamed("id", "doc_id")


OP11_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)"""
