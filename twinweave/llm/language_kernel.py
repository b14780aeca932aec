"""Language identification with string kernels.

The kernel of two texts is the normalised number of blended-spectrum n-grams (1 to MAX_N bytes of the lower-cased text)
present in both, over SLOTS hash slots. Nystroem landmarks, some training texts of each language, span the feature space;
one-versus-rest kernel ridge regression is fitted in it. A batch of texts is scored by two matrix products: presence rows
by landmark rows, then kernel rows by one weight column a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.llm._common import bucket_of, make_importable, text_or_empty

MAX_N, SLOT_BITS = 4, 13
SLOTS = 1 << SLOT_BITS
BLOCK = 128
CHUNK = 1 << 20
LETTER = r"\p{L}"


def presence(text: str, row) -> None:
    """Set the slots of a text's n-grams in a zeroed row of SLOTS numbers. Long texts go in overlapping chunks."""
    import numpy as np

    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    for at in range(0, max(len(data), 1), CHUNK):
        part = data[at : at + CHUNK + MAX_N - 1]
        grams = part
        for n in range(1, MAX_N + 1):
            if len(part) < n:
                break
            if n > 1:
                grams = grams[:-1] * np.uint32(263) + part[n - 1 :]
            row[((grams + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)] = 1


@dataclass(frozen=True)
class KernelModel:
    languages: list[str]
    landmarks: object  # landmarks x SLOTS, rows of unit length
    weights: object  # landmarks x languages

    def scores(self, texts: list[str]):
        import numpy as np

        rows = np.zeros((len(texts), SLOTS), np.float32)
        for i, text in enumerate(texts):
            presence(text, rows[i])
        kernel = rows @ self.landmarks.T
        kernel /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return kernel @ self.weights


def fit_kernel(rows, labels: list[str], per_language_landmarks: int = 40, ridge: float = 1e-2) -> KernelModel:
    """Kernel ridge regression on presence rows, in the span of the first landmarks of each language."""
    import numpy as np

    languages = sorted(set(labels))
    rows = rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    names = np.array(labels, dtype=object)
    chosen = np.concatenate([np.flatnonzero(names == lang)[:per_language_landmarks] for lang in languages])
    landmarks = rows[chosen]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = (rows @ landmarks.T) @ root
    targets = np.where(names[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
    weight = 1 / np.array([np.sum(names == x) for x in labels])
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(gram, features.T @ (targets * weight[:, None]))
    return KernelModel(languages, landmarks.astype(np.float32), weights.astype(np.float32))


def _presence_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        bits = []
        for text in batch.column(2):
            row = np.zeros(SLOTS, np.uint8)
            presence(text.as_py(), row)
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["doc_id", "label", "bits"])


def sample_ids(rows: DataFrame, key: str, per_key: int) -> list[int]:
    """Ids of the first rows of each key by a hash of the id: a bounded sample, the same at each run.

    A key's ids are counted, and only those with a hash in the share of the range where some eight times as many as wanted
    are expected are ranked, so that few rows of a key meet however large it is.
    """
    distinct = rows.where(F.col("doc_id").isNotNull()).select("doc_id", key).distinct().withColumn("_hash", F.xxhash64("doc_id"))
    counts = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).collect()
    share = F.create_map(*[F.lit(v) for r in counts for v in (r[0], min(1.0, (8.0 * per_key + 64) / r[1]))]) if counts else F.create_map()
    place = F.col("_hash").cast("double") / 2.0**64 + 0.5
    few = distinct.where(place <= share[F.col(key)]) if counts else distinct
    order = W.partitionBy(key).orderBy("_hash", "doc_id")
    ranked = few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_key)
    return [r[0] for r in ranked.select("doc_id").collect()]


def train_languages(docs: DataFrame, train: Column, per_language: int = 400) -> KernelModel | None:
    """Fit on at most ``per_language`` training texts of each language; only fixed-size presence bits reach the driver."""
    import numpy as np

    make_importable(docs.sparkSession)
    rows = docs.where(train & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("label"), text_or_empty("text").alias("text")).where(F.col("text").rlike(LETTER))
    ids = sample_ids(rows, "label", per_language)
    if not ids:
        return None
    found = rows.where(F.col("doc_id").isin(ids)).mapInArrow(_presence_bits, "doc_id long, label string, bits binary")
    # One row an id and label, so that what reaches the driver stays bounded where ids repeat.
    found = found.groupBy("doc_id", "label").agg(F.min("bits").alias("bits")).collect()
    found = sorted(found, key=lambda r: (r.label, r.doc_id, bytes(r.bits)))
    bits = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in found]).astype(np.float32)
    return fit_kernel(bits, [r.label for r in found])


def _predict(model: KernelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                scores = model.scores([x.as_py() for x in rows.column(2)])
                best = scores.argmax(axis=1)
                top = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)
                has = rows.column(3).to_numpy(zero_copy_only=False)
                names = [model.languages[i] if h else "und" for i, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(np.where(has, top, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, held_out: Column | None = None, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Texts that are null or without a letter are ``und`` with score 0, and so are all if there is nothing to learn from.
    Texts are read whole, however long. Of rows that repeat an id and language one is learned from. Repeated rows and ids are scored each for itself; an empty table gives an empty table.
    """
    held_out = bucket_of("doc_id") % 4 == 2 if held_out is None else held_out
    model = train_languages(docs, ~held_out, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty("text").alias("text")).withColumn("has", F.col("text").rlike(LETTER))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
