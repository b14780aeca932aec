"""Long values in pairs: sentence chunks are matched by place, changed pair by pair and put back in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.plans.storage import cut

#: Two columns to a struct of two columns, first and second.
PairGenerator = Callable[[Column, Column], Column]


def alternate_words(a: Column, b: Column) -> Column:
    """struct(first, second): words of both by turns, beginning with a's and with b's; where one has ended, the other goes on."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    turn = lambda x, y: F.array_join(F.transform(F.arrays_zip(words(x).alias("x"), words(y).alias("y")), lambda p, i: F.when(i % 2 == 0, F.coalesce(p["x"], p["y"])).otherwise(F.coalesce(p["y"], p["x"]))), " ")
    return F.struct(turn(a, b).alias("first"), turn(b, a).alias("second"))


def interpolate_long(rows: DataFrame, a: str, b: str, generator: PairGenerator, least: int = 60, most: int = 80) -> DataFrame:
    """``rows`` with first and second: the two texts changed together, chunk by chunk.

    Where neither text has ``least`` words, the generator takes both whole. Else both are cut into chunks of whole sentences
    of up to ``most`` words; the generator takes the chunks at the same place, those that only one text has stay as they
    are, and each side is joined in order. Null texts count as empty. Rows that repeat are changed each for itself. The
    generator sees a row for each pair of chunks, so it may be a column expression or a vectorised function.
    """
    held = cut(rows.withColumn("_uid", F.monotonically_increasing_id()))
    x, y = (F.coalesce(F.col(c), F.lit("")) for c in (a, b))
    long = (F.size(X.tokens(x)) >= least) | (F.size(X.tokens(y)) >= least)
    sides = held.select("_uid", F.when(long, X.chunks(x, most)).otherwise(F.array(x)).alias("x"), F.when(long, X.chunks(y, most)).otherwise(F.array(y)).alias("y"))
    pieces = cut(sides.select("_uid", F.posexplode(F.arrays_zip("x", "y")).alias("at", "z")).select("_uid", "at", "z.x", "z.y"))
    both = pieces.where("x is not null and y is not null").withColumn("made", generator(F.col("x"), F.col("y"))).select("_uid", "at", "made.first", "made.second")
    alone = pieces.where("x is null or y is null").select("_uid", "at", F.col("x").alias("first"), F.col("y").alias("second"))
    inside = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda p: p[c]), " ").alias(c)
    joined = both.unionByName(alone).groupBy("_uid").agg(inside("first"), inside("second"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return held.join(joined, "_uid", "left").select(*rows.columns, blank("first"), blank("second"))
