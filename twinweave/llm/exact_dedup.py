"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z. Three stages compare the whole normalised text, never a digest
alone: Spark's map-side aggregation removes copies inside each input partition; salted digest groups merge what is left,
so that one text with a third of all rows meets in ``salts`` tasks instead of one; the salt winners, at most ``salts``
rows a text, combine globally. Members then learn their group by digest, hot digests in many tasks, which is safe because the last stage also counts
the distinct texts of each digest; should a digest ever have two, its members are matched by text instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.llm._common import hot_keys, make_importable, materialise, private, salted_join, text_or_empty


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _normalise(digest: Callable[[bytes], str], keep_text: bool):
    """Arrow batches (id, text) to (id, digest[, text]) with A-Z lower-cased; other letters stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.ascii_lower(batch.column(1))
            digests = pa.array([digest(x.as_buffer()) for x in text], pa.string())
            columns = [batch.column(0), digests, *([text] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_digest", "_text"][: len(columns)])

    return run


def normalised(docs: DataFrame, id_col: str, text_col: str, keep_text: bool, digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    make_importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_normalise(digest, keep_text), f"_id {kind}, _digest string" + ", _text string" * keep_text)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of equal texts stays. Null texts count as empty. Null ids lose to any other id; a group of null ids
    only keeps null. Rows that repeat an id and its text are one document: each carries the same flag and each counts in
    group_size. Texts are compared whole, however long. An empty table gives an empty table; other columns, whatever their names, are not read.
    """
    rows = normalised(docs, id_col, text_col, True, digest)
    salted = rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    texts = salted.repartition("_digest").groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    groups = materialise(texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n")), "exact-groups")
    hot = hot_keys(groups, "_digest", "_n", groups.agg(F.sum("_n")).first()[0] or 0)
    found = salted_join(normalised(docs, id_col, text_col, False, digest), groups.where("_texts = 1").drop("_texts"), "_digest", hot, "_id")
    clashing = groups.where("_texts > 1").select("_digest")
    if not clashing.isEmpty():
        by_text = rows.join(clashing, "_digest", "left_semi").join(texts.join(clashing, "_digest", "left_semi"), ["_digest", "_text"])
        found = found.unionByName(by_text.select(found.columns))
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("text_sha256"))


def _with_digest(at: int, name: str):
    """Arrow batches of whole rows with the digest of column ``at`` behind them; the digests are those of exact_groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.ascii_lower(pc.fill_null(batch.column(at), ""))
            digests = pa.array([sha256_hex(x.as_buffer()) for x in text], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, name])

    return run


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one row for each distinct text.

    The row with the largest id of a text stays, and null ids lose to any other. Rows are known by id and SHA-256 of the
    normalised text together, so null or repeated ids with different texts are different documents. Of rows with the same
    id and text that differ in case or in other columns, the one stays whose own text has the least SHA-256, then the one
    with the least hash of its other columns (maps aside). Null texts count as
    empty; extra columns may have any names; an empty table stays empty.
    """
    digest, stay_id, stay_digest = private(docs, "_digest", "_stay_id", "_stay_digest")
    stay = exact_groups(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias(stay_id), F.col("text_sha256").alias(stay_digest)).distinct()
    rows = docs.mapInArrow(_with_digest(docs.columns.index(text_col), digest), T.StructType([*docs.schema.fields, T.StructField(digest, T.StringType())]))
    kept = rows.join(stay, (rows[digest] == stay[stay_digest]) & rows[id_col].eqNullSafe(stay[stay_id]), "left_semi")
    hashed = [F.col(f.name) for f in docs.schema if f.name != text_col and "map<" not in f.dataType.simpleString()]
    (row,) = private(docs, "_row")
    order = F.struct(F.sha2(text_or_empty(text_col), 256), F.xxhash64(*hashed))
    first = kept.groupBy(F.col(id_col).alias(stay_id), F.col(digest)).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return first.select(f"{row}.*")
