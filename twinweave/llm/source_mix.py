"""Mixing sources to target weights with Pareto order sampling.

A source's target is its weighted share of all words, at most ``max_repeat`` times its own words, the excess reshared by
weight. Inside a source a document's expected number of copies is a rate of its size class, min(max_repeat, c * (base +
class)), with c solved so that the expected words meet the target: inclusion probabilities are unequal. The whole part
of a rate is taken for certain. For the fraction p, each document gets the Pareto rank (u / (1 - u)) / (p / (1 - p)) with
u from a hash of its id, and the lowest ranks are taken until the source's words are as near to its target as the next
document allows. The cut-off is found exactly without sorting a source in one task: counts in 1,024 rank buckets, then in
1,024 parts of the bucket that holds the cut, then a sort of the few documents of that part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.llm._common import materialise, private, text_or_empty

#: Source weights by rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
BASE = 20
PARTS = 1024
SALTS = 16


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """_key, source_size, target per source; ``sized`` has _key, _source, _size. One row a source passes through one task."""
    per = sized.groupBy("_key", "_source").agg(F.sum("_size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    per = per.withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    per = per.withColumn("_capped", F.col("_left") * F.col("_w") > F.col("_cap") * F.col("_wleft"))
    free = F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(everything)
    free_w = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_w"))).over(everything)
    share = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * free / free_w)
    return per.select("_key", "source_size", share.alias("target"))


def _class_rates(sized: DataFrame, targets: DataFrame, max_repeat: int) -> DataFrame:
    """_key, _class, source_size, target, _rate, _rest: the last is what the source's fractions must add, in words."""
    classes = sized.groupBy("_key", "_class").agg(F.sum("_size").alias("_words")).join(targets, "_key")
    classes = classes.withColumn("_pull", F.col("_class") + BASE)
    order = W.partitionBy("_key").orderBy(F.col("_class").desc())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    left = F.col("target") - (F.coalesce(F.sum("_words").over(before), F.lit(0)) * max_repeat).cast("double")
    mass = F.sum(F.col("_words") * F.col("_pull")).over(after).cast("double")
    classes = classes.withColumn("_left", left).withColumn("_mass", mass)
    classes = classes.withColumn("_capped", F.col("_left") * F.col("_pull") > F.col("_mass") * max_repeat)
    own = W.partitionBy("_key")
    scale = F.max(F.when(~F.col("_capped") & (F.col("_mass") > 0), F.struct(F.col("_class"), (F.col("_left") / F.col("_mass")).alias("c")))).over(own)["c"]
    rate = F.when(F.col("_capped"), F.lit(float(max_repeat))).otherwise(F.least(F.lit(float(max_repeat)), F.greatest(F.lit(0.0), F.coalesce(scale, F.lit(0.0)) * F.col("_pull"))))
    classes = classes.withColumn("_rate", rate)
    rest = F.col("target") - F.sum(F.floor("_rate") * F.col("_words")).over(own).cast("double")
    return classes.withColumn("_rest", rest).select("_key", "_class", "source_size", "target", "_rate", "_rest")


def _salted(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a small per-source table to documents without one source's rows meeting in one task."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"], how).drop("_salt")


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    Null texts have size 0; null sources are one source, ranked last. Equal ranks are ordered by id, then size, then a
    hash of the text, so only equal rows can change places; rows that repeat an id share its rank. A null id draws its
    rank from its text. Documents of size 0 take part but add no word; texts are counted whole. Other columns are not
    read; an empty table gives an empty table.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    return _mixed(rows, weights, max_repeat, seed).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), "copies")


def _mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """_uid, _id, _size, source_size, target, copies for rows (_uid, _id, _source, _text); a row is known by its _uid."""
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("text|"), text_or_empty("_text")))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("long")
    sized = rows.select("_uid", "_id", "_source", word_count("_text").alias("_size"), ((digits.cast("double") + 0.5) / float(2**52)).alias("_u"), F.xxhash64(text_or_empty("_text")).alias("_tie"))
    sized = sized.withColumn("_key", F.when(F.col("_source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("_source")))).withColumn("_class", F.length(F.bin("_size")))
    sized = materialise(sized, "mix-sizes")
    rates = _class_rates(sized, source_targets(sized, weights, max_repeat), max_repeat)
    ranked = _salted(sized, rates, ["_key", "_class"])
    ranked = ranked.withColumn("_whole", F.floor("_rate")).withColumn("_p", F.col("_rate") - F.floor("_rate"))
    ranked = ranked.withColumn("_q", F.when(F.col("_p") > 0, (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))))
    ranked = ranked.withColumn("_part", F.least(F.lit(PARTS * PARTS - 1), F.floor(F.col("_q") / (1 + F.col("_q")) * PARTS * PARTS)).cast("int"))
    ranked = materialise(ranked.drop("_u", "_p", "_rate"), "mix-ranks")

    def cut(rows: DataFrame, part: Column) -> DataFrame:
        """The part of each source in which its words pass what it may still take, and the words before it."""
        sums = rows.where(F.col("_q").isNotNull()).groupBy("_key", part.alias("_at"), "_rest", "_base").agg(F.sum("_size").alias("_words"))
        upto = F.col("_base") + F.sum("_words").over(W.partitionBy("_key").orderBy("_at"))
        return sums.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_words") <= F.col("_rest"))).select("_key", "_at", (F.col("_upto") - F.col("_words")).alias("_before"))

    first = cut(ranked.withColumn("_base", F.lit(0).cast("long")), F.floor(F.col("_part") / PARTS).cast("int"))
    in_first = _salted(ranked, first, ["_key"]).where(F.floor(F.col("_part") / PARTS) == F.col("_at")).withColumn("_base", F.col("_before")).drop("_at", "_before")
    second = materialise(cut(in_first, F.col("_part")), "mix-cuts")
    placed = _salted(ranked, second, ["_key"], "left")
    # Zero rates have no rank; a source whose fractions all fit has no cut.
    taken_part = F.col("_q").isNotNull() & (F.col("_at").isNull() | (F.col("_part") < F.col("_at")))
    on_cut = F.col("_q").isNotNull() & (F.col("_part") == F.col("_at"))
    cut_rows = _running(placed.where(on_cut), ["_q", "_id", "_size", "_tie", "_uid"]).withColumn("_more", (2 * (F.col("_before") + F.col("_upto")) - F.col("_size") <= 2 * F.col("_rest")).cast("int")).drop("_upto")
    rest = placed.where(~F.coalesce(on_cut, F.lit(False))).withColumn("_more", taken_part.cast("int"))
    out = rest.unionByName(cut_rows)
    copies = (F.col("_whole") + F.col("_more")).cast("long")
    return out.select("_uid", "_id", "_size", "source_size", "target", copies.alias("copies"))


def _running(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds _upto: the words of a source's rows up to and with each row, in ``order``.

    Rows may be many where one id, and so one rank, has a large share of them: ranges by source and order are stored and
    summed up by themselves, and the sums of a source's ranges, one row each, come before.
    """
    ranged = materialise(rows.repartitionByRange("_key", *order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    sums = ranged.groupBy("_key", "_range").agg(F.sum("_size").alias("_words"))
    earlier = sums.select("_key", "_range", (F.sum("_words").over(W.partitionBy("_key").orderBy("_range")) - F.col("_words")).alias("_earlier"))
    inside = F.sum("_size").over(W.partitionBy("_key", "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_upto", inside).join(earlier, ["_key", "_range"]).withColumn("_upto", F.col("_upto") + F.col("_earlier")).drop("_range", "_earlier")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns; a document taken k times is k rows.

    Each row takes its own number of copies, whether its id is null or repeated or not; see ``mix_copies`` for nulls and
    ties. Extra columns may have any names; an empty table stays empty.
    """
    uid, copies, copy = private(docs, "_uid", "_copies", "_copy")
    rows = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "mix-rows")
    known = rows.select(F.col(uid).alias("_uid"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    taken = _mixed(known, **options).where("copies > 0").select(F.col("_uid").alias(uid), F.col("copies").cast("int").alias(copies))
    return rows.join(taken, uid).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(uid, copies, copy)
