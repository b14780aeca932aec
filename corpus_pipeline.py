"""Corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage works on all rows that the one before it kept and is written to the shared folder before the next begins.
The mix takes a document up to three times, as that many rows; the last stage returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinweave.llm import exact_dedup, order_minhash, packing, pu_quality, source_mix
from twinweave.llm._common import delete, new_path, scratch, table

#: SQL can't express the quality classifier, Order MinHash or the tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts, with all their columns.

    Rows are judged one by one, so null and repeated ids are rows of their own; null texts count as empty and texts are
    read whole. Without positive labels all rows stay. An empty table stays empty.
    """
    with scratch(spark, "pipeline"):
        return pu_quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, the one with the largest id: see ``exact_dedup.drop_exact_copies``."""
    with scratch(spark, "pipeline"):
        return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the least id: see ``order_minhash.drop_near_copies``."""
    with scratch(spark, "pipeline"):
        return order_minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times: see ``source_mix.mix_rows``."""
    with scratch(spark, "pipeline"):
        return source_mix.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is packed for itself, whether its id is null or repeated: see ``packing.pack_documents``.
    """
    with scratch(spark, "pipeline"):
        return packing.packed_digests(docs)


STAGES = [("quality", quality), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next one is written; the last is the caller's to release."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    with scratch(spark, "pipeline"):
        return docs
