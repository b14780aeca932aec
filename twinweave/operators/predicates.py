"""Predicate matching by name, by value and by both. Predicate tables are small beside triples; joins carry no hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.operators.relational import attribute_triples


def predicate_table(triples: DataFrame, kg: int) -> DataFrame:
    """p, name of the graph's attribute predicates."""
    return attribute_triples(triples).where(F.col("kg") == kg).select("p").distinct().withColumn("name", X.expand_predicate(F.col("p")))


def _letters(name: Column) -> Column:
    """Distinct labels of a name's characters: the character and which of its occurrences it is; one label for an empty name."""
    chars = F.split(name, "")
    labelled = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return F.when(name == "", F.array(F.lit(""))).otherwise(labelled)


def candidate_pairs(one: DataFrame, two: DataFrame, threshold: float) -> DataFrame:
    """p1, n1, p2, n2 of two predicate tables (p, name) that may reach the similarity ``threshold``; none that does is missing.

    Names of similarity t have at least t times the longer one's length of characters in common, each occurrence counted.
    So of a name's characters, rarest first, all but that many and one more must hold one of the other's; only such pairs,
    of fitting lengths, are made. At a threshold of 0 these are all pairs with a character in common.
    """
    both = one.select(F.lit(1).alias("side"), "p", "name").unionByName(two.select(F.lit(2).alias("side"), "p", "name"))
    held = both.select("side", "p", "name", F.explode(_letters(F.col("name"))).alias("letter"))
    often = held.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("side", "p").orderBy("n", "letter")
    needed = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.length("name") - 1e-9))
    ranked = held.join(often, "letter").withColumn("nth", F.row_number().over(order))
    kept = ranked.where(F.col("nth") <= F.greatest(F.lit(1), F.length("name")) - needed + 1)
    a = kept.where("side = 1").select("letter", F.col("p").alias("p1"), F.col("name").alias("n1"))
    b = kept.where("side = 2").select("letter", F.col("p").alias("p2"), F.col("name").alias("n2"))
    fits = F.least(F.length("n1"), F.length("n2")) >= F.lit(threshold) * F.greatest(F.length("n1"), F.length("n2")) - 1e-9
    return a.join(b, "letter").where(fits).select("p1", "n1", "p2", "n2").distinct()


def name_similarity(one: DataFrame, two: DataFrame, threshold: float = 0.0) -> DataFrame:
    """p1, p2, similarity of the pairs of two predicate tables (p, name) of at least ``threshold``, and above 0: pairs that are
    left out have no character in common or are below it."""
    ratio = X.levenshtein_ratio(F.col("n1"), F.col("n2"))
    return candidate_pairs(one, two, threshold).select("p1", "p2", ratio.alias("similarity")).where((F.col("similarity") > 0) & (F.col("similarity") >= threshold))


def mutual_matches(similarity: DataFrame, threshold: float) -> DataFrame:
    """Pairs above the threshold that are each other's best."""
    best = lambda a, b: F.row_number().over(W.partitionBy(a).orderBy(F.desc("similarity"), b))
    return similarity.withColumn("_a", best("p1", "p2")).withColumn("_b", best("p2", "p1")).where((F.col("_a") == 1) & (F.col("_b") == 1) & (F.col("similarity") > threshold)).drop("_a", "_b")


def threshold_matches(similarity: DataFrame, threshold: float = 0.3) -> DataFrame:
    return similarity.where(F.col("similarity") >= threshold)


def match_statistics(matches: DataFrame, high: float = 0.85) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean"), F.min("similarity").alias("min"), F.max("similarity").alias("max"), F.stddev_pop("similarity").alias("std"), F.count(F.when(F.col("similarity") >= high, 1)).alias("high"))


def value_types(triples: DataFrame, least_share: float = 0.6) -> DataFrame:
    """kg, p, type: the most frequent type of the predicate's values, mixed below ``least_share``."""
    counts = attribute_triples(triples).groupBy("kg", "p", X.value_type(F.col("o")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("kg", "p").agg(F.max_by("t", F.struct("n", "t")).alias("t"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return tops.select("kg", "p", F.when(F.col("n") / F.col("all") >= least_share, F.col("t")).otherwise("mixed").alias("type"))


def value_similarity(triples: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """p1, p2, similarity by values of the given ``pairs`` (p1, p2): 0.1 for different types; text 0.4 exact + 0.6 word Jaccard; numbers 0.5 exact and
    0.5 closeness of means times ratio of deviations; else the exact share. Fewer than ``least`` values give 0.

    Overlaps are counted by joining distinct values and words, never value lists of a predicate in one row.
    """
    values = attribute_triples(triples).select("kg", "p", F.lower("o").alias("v")).distinct()
    words = values.select("kg", "p", F.explode(X.tokens(F.col("v"))).alias("w")).distinct()
    number = X.first_number(F.col("v"))
    info = values.groupBy("kg", "p").agg(F.count(F.lit(1)).alias("n"), F.avg(number).alias("m"), F.stddev_pop(number).alias("sd")).join(value_types(triples), ["kg", "p"]).join(words.groupBy("kg", "p").agg(F.count(F.lit(1)).alias("nw")), ["kg", "p"], "left")

    def overlap(rows: DataFrame, col: str, name: str) -> DataFrame:
        a, b = rows.where("kg = 1").select(F.col("p").alias("p1"), col), rows.where("kg = 2").select(F.col("p").alias("p2"), col)
        return a.join(b, col).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias(name))

    side = lambda k: info.where(F.col("kg") == k).select(*[F.col(c).alias(f"{c}{k}") for c in ("p", "n", "m", "sd", "type", "nw")])
    rows = pairs.select("p1", "p2").distinct().join(side(1), "p1").join(side(2), "p2").join(overlap(values, "v", "same"), ["p1", "p2"], "left").join(overlap(words, "w", "shared"), ["p1", "p2"], "left")
    same, shared = F.coalesce("same", F.lit(0)), F.coalesce("shared", F.lit(0))
    exact = same / F.least("n1", "n2")
    word_jaccard = F.coalesce(F.try_divide(shared.cast("double"), (F.coalesce("nw1", F.lit(0)) + F.coalesce("nw2", F.lit(0)) - shared).cast("double")), F.lit(0.0))
    gap = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.greatest(F.abs("m1"), F.abs("m2"))), F.lit(0.0)))
    spread = F.coalesce(F.try_divide(F.least("sd1", "sd2"), F.greatest("sd1", "sd2")), F.lit(1.0))
    score = F.when((F.col("n1") < least) | (F.col("n2") < least), 0.0).when(F.col("type1") != F.col("type2"), 0.1).when(F.col("type1") == "text", 0.4 * exact + 0.6 * word_jaccard).when(F.col("type1") == "number", 0.5 * exact + 0.5 * (1 - gap) * spread).otherwise(exact)
    return rows.select("p1", "p2", score.alias("similarity"))


def hybrid_alignment(names: DataFrame, values: DataFrame, known: DataFrame, name_weight: float = 0.6, threshold: float = 0.3) -> DataFrame:
    """p1, p2, combined: weighted name and value similarity; known matches have a name similarity of 1."""
    given = known.select("p1", "p2", F.lit(1.0).alias("name"))
    found = threshold_matches(names, threshold).join(known, ["p1", "p2"], "left_anti").select("p1", "p2", F.col("similarity").alias("name"))
    rows = given.unionByName(found).join(values.withColumnRenamed("similarity", "value"), ["p1", "p2"], "left")
    return rows.select("p1", "p2", (name_weight * F.col("name") + (1 - name_weight) * F.coalesce("value", F.lit(0.0))).alias("combined"))
