"""Token ids as Parquet list columns, in ascending order of the id.

Spark's Parquet writer makes the files: dictionary pages for ids that repeat, delta encoding (format v2) for the document
columns, row groups and pages of a stated size, and column and offset indexes, so a reader that wants a few documents
skips row groups by doc_id and pages by the index, and one that wants only lengths never reads the ids. A range partition
gives each task a stretch of doc_ids; a document's row keeps its place in the task's stretch, and the stretches add up
to global starts when the files are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.llm._common import make_importable, new_path, text_or_empty
from twinweave.llm.tokens import default_vocabulary

#: Parquet settings of the store; the ids keep their dictionary, the document columns are delta encoded.
LAYOUT = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size": str(1 << 20), "parquet.page.row.count.limit": "20000", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#start_in_part": "false"}
BATCH_BYTES = 4 << 20
RANGE_DOCS = 1 << 17


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        from twinweave.llm.tokens import encoder

        enc, at, part = encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in pieces_of(batch):
                ids = enc.encode(rows.column(1).to_pylist(), end_id)
                n = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
                ends = np.cumsum(n)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(at + ends - n), pa.array(n), lists], ["doc_id", "part", "start_in_part", "n_tokens", "tokens"])
                at += int(n.sum())

    return run


def pieces_of(batch: pa.RecordBatch, column: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, or one row."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, layout: dict[str, str] = LAYOUT) -> None:
    """Write the store. Texts are encoded whole, however long. Null texts count as empty and hold only the end id; null ids come first; rows that repeat an id
    stay beside each other, shorter texts first, then in the order of a hash of the text; one id with very many rows is many ranges. Other columns are not read; an empty table gives a store of no rows."""
    make_importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # Ranges of a bounded number of documents, so that tasks and files don't grow with the table.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_DOCS))
    # Rows that repeat an id are split by the keys behind it, equal rows by their number.
    keys = [F.col("doc_id").asc_nulls_first(), F.length("text"), F.xxhash64("text"), F.col("uid")]
    ordered = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("uid")
    schema = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"
    ordered.mapInArrow(_encode(vocabulary or default_vocabulary(), end_id), schema).write.options(**layout).parquet(path)


STORED = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens. The starts of the parts come from one small row a part."""
    stored = spark.read.schema(STORED).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("_n"), F.min("doc_id").alias("_first"))
    parts = parts.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_before"))
    return stored.join(parts, "part").select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")


def list_crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of ids, becomes the crc32 of their little-endian unsigned 32-bit bytes."""
    import numpy as np

    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = lists.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crcs = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], crcs], [*batch.schema.names[:-1], "ids_crc32"])


def store_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder, read it back, and return doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, vocabulary, end_id)
    stored = docs.sparkSession.read.schema(STORED).parquet(path)
    digests = stored.select("part", "start_in_part", "doc_id", "n_tokens", "tokens").mapInArrow(list_crc32, "part int, start_in_part long, doc_id long, n_tokens long, ids_crc32 long")
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_before"))
    return digests.join(parts, "part").select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
