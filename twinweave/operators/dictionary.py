"""Front-coded dictionaries: names in order, each as the length that it shares with the one before and the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.operators.relational import sorted_ids

#: Names of a block, whose first is written whole.
BLOCK = 64


def shared_length(a: Column, b: Column) -> Column:
    """Characters that two texts begin with alike."""
    most = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.substr(a, F.lit(1), most), ""), F.split(F.substr(b, F.lit(1), most), ""), lambda x, y: x == y)
    differ = F.array_position(same, False)
    return F.when(differ == 0, most).otherwise(differ - 1).cast("int")


def front_coded(names: DataFrame, col: str, block: int = BLOCK) -> DataFrame:
    """block, id, shared, rest of the distinct names; ids are those of ``sorted_ids``.

    Ids come from ranges, and a block holds ``block`` names wherever it lies, so no task holds more of the dictionary than
    its blocks, and any block can be read for itself.
    """
    rows = sorted_ids(names.select(col).where(F.col(col).isNotNull()).distinct(), col).withColumn("block", F.floor(F.col("id") / block))
    before = F.lag(col).over(W.partitionBy("block").orderBy("id"))
    coded = rows.withColumn("_before", before).withColumn("shared", F.when(F.col("_before").isNull(), 0).otherwise(shared_length(F.col(col), F.col("_before"))))
    return coded.select("block", "id", "shared", F.substr(F.col(col), F.col("shared") + 1).alias("rest"))


def decoded(dictionary: DataFrame, col: str) -> DataFrame:
    """id and the name, block by block."""
    lists = dictionary.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "shared", "rest"))).alias("rows"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, row: Column) -> Column:
        name = F.concat(F.substr(state["last"], F.lit(1), row["shared"]), row["rest"])
        return F.struct(name.alias("last"), F.concat(state["names"], F.array(name)).alias("names"))

    named = lists.select("rows", F.aggregate("rows", start, step)["names"].alias("names"))
    both = named.select(F.explode(F.arrays_zip("rows", "names")).alias("x"))
    return both.select(F.col("x.rows.id").alias("id"), F.col("x.names").alias(col))
