"""A training corpus in five stages, from `documents` to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept. Its result is written as Parquet and read
again, so a lost executor costs the running stage at most.
"""

from __future__ import annotations

import uuid

from cadenza.llm import decontamination, language, near_duplicates, packing, suffix_array
from cadenza.llm._io import delete, drop_since, made, shared_dir, table
from pyspark.sql import DataFrame, SparkSession


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null or hold no letter, and uncertain ones, go."""
    return language.with_language(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies: the smallest doc_id, one row of it. Null and empty texts are one class; an empty table stays empty."""
    return near_duplicates.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur twice, which every passage of over 50 words reaches. Null texts stay null, and all rows stay."""
    return suffix_array.without_repeats(docs, suffix_array.PASSAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans that hold ten words of a benchmark item. Null texts stay null, all rows stay, and without items so do the texts."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are the end id
    alone; an empty table gives no row."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicate_removal),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("harmonic_packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, kept = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}", made()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_since(spark, kept)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
