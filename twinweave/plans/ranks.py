"""Row numbers over a whole table without one task that sorts it all, and hash ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.plans.storage import cut

def hash_key(seed: int | str, *cols: str) -> Column:
    """md5 of the seed and the columns: the order of every seeded sample and shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def global_row_number(df: DataFrame, keys: list[str | Column], name: str = "rn") -> DataFrame:
    """``name`` numbers the rows from 1 in the order of ``keys`` (nulls first).

    A range partition by all keys deals the rows out, so ties of the first key are split by the next ones; rows are
    numbered in their range, stored, and moved up by the sizes of the ranges before it, a table of one row a range.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = cut(ranged.select("*", F.spark_partition_id().alias("__part"), place.alias("__place")))
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = numbered.join(F.broadcast(before), "__part")
    return joined.withColumn(name, (F.col("__before") + F.col("__place") + 1).cast("long")).drop("__part", "__place", "__before")


def top_by_hash(df: DataFrame, count: Column | int, seed: int | str, cols: list[str]) -> DataFrame:
    """The first ``count`` rows in hash order: a seeded sample without replacement."""
    ranked = global_row_number(df.withColumn("__h", hash_key(seed, *cols)), ["__h", *cols], "__rank")
    return ranked.where(F.col("__rank") <= count).drop("__h", "__rank")
