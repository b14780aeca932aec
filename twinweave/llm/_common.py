"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.plans.joins import hot_keys, lookup_join, salted_join
from twinweave.plans.storage import delete, materialise, new_path, release, scratch, shared_dir
from twinweave.plans.workers import make_importable

__all__ = ["bucket_of", "delete", "hot_keys", "lookup_join", "make_importable", "materialise", "new_path", "private", "release", "salted_join", "scratch", "shared_dir", "table", "text_or_empty"]


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def bucket_of(id_col: str, salt: str = "") -> Column:
    """crc32 of the id as text (null: empty), for folds."""
    return F.crc32(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
