"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of a table's rows is hot; there are fewer than its inverse of them.
HOT_SHARE, HOT_SALTS = 1 / 512, 32
#: Bytes of a table that a join may broadcast, once they are counted: 64 a row and those of its strings.
MOST_BROADCAST = 1 << 24


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The keys of ``counts`` with over HOT_SHARE of ``total`` rows: at most 1 / HOT_SHARE of them, so small enough to broadcast."""
    return counts.where(F.col(n) > max(1.0, total * HOT_SHARE)).select(key)


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``big`` joined to ``small`` on ``key`` with the rows of each hot key dealt to HOT_SALTS tasks by a hash of ``by``."""
    flag = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    left = big.join(flag, key, "left").withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(HOT_SALTS))).otherwise(0).cast("int")).drop("_hot")
    right = small.join(flag, key, "left").withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, key: str, n: str, by: str) -> DataFrame:
    """``big`` joined to the stored table ``small``, one row a key, whose column ``n`` counts its rows in ``big``.

    The bytes of ``small`` are counted: it is broadcast up to MOST_BROADCAST of them; else the rows of hot keys are salted.
    """
    strings = [F.length(f.name) for f in small.schema if f.dataType.simpleString() in ("string", "binary")]
    rows, total, letters = small.agg(F.count(F.lit(1)), F.sum(n), F.sum(sum(strings, F.lit(0)))).first()
    if 64 * rows + 4 * (letters or 0) <= MOST_BROADCAST:
        return big.join(F.broadcast(small), key)
    return salted_join(big, small, key, hot_keys(small, key, n, total), by)


def keyed_join(big: DataFrame, small: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """``big`` joined to ``small``, one row a key, on ``key``: the keys of ``big``, or of the stored table ``counted`` that it comes
    from, are counted and hot ones salted by ``by``."""
    often = (big if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = often.agg(F.sum("_n")).first()[0] or 0
    return salted_join(big, small, key, hot_keys(often, key, "_n", total), by)
