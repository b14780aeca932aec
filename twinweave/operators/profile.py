"""Profiles of graphs and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.operators.relational import attribute_triples, edges, entities, relation_triples, subjects
from twinweave.plans.kg import Dataset


def _count(name: str, condition=None):
    return F.count(F.lit(1) if condition is None else F.when(condition, 1)).cast("long").alias(name)


def kg_statistics(triples: DataFrame) -> DataFrame:
    """kg, triples, entities, relations, attributes."""
    base = triples.groupBy("kg").agg(_count("triples"), F.countDistinct(F.when(F.col("o_kind") == "uri", F.col("p"))).alias("relations"), F.countDistinct(F.when(F.col("o_kind") == "lit", F.col("p"))).alias("attributes"))
    return base.join(entities(triples).groupBy("kg").agg(_count("entities")), "kg").select("kg", "triples", "entities", "relations", "attributes")


def alignment_structure(splits: DataFrame) -> DataFrame:
    """One row: unique pairs, pairs per split, overlaps of the splits, unique entities, least and greatest ends."""
    pairs = splits.groupBy("e1", "e2").agg(*[F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s) for s in ("sup", "ref", "valid")])
    both = lambda *names: F.sum(sum((F.col(n) for n in names[1:]), F.col(names[0])).__eq__(len(names)).cast("long")).alias("_".join(names))
    return pairs.agg(_count("pairs"), F.sum("sup").alias("sup"), F.sum("ref").alias("ref"), F.sum("valid").alias("valid"), both("sup", "ref"), both("sup", "valid"), both("ref", "valid"), both("sup", "ref", "valid"), F.countDistinct("e1").alias("left_entities"), F.countDistinct("e2").alias("right_entities"), F.min("e1").alias("least_left"), F.max("e2").alias("greatest_right"))


def alignment_coverage(data: Dataset) -> DataFrame:
    """kg, aligned, in_triples, missing, not_aligned."""
    aligned = data.alignment.select(F.lit(1).alias("kg"), F.col("e1").alias("entity")).unionByName(data.alignment.select(F.lit(2).alias("kg"), F.col("e2").alias("entity"))).distinct().withColumn("a", F.lit(1))
    known = entities(relation_triples(data.triples)).withColumn("t", F.lit(1))
    return aligned.join(known, ["kg", "entity"], "full").groupBy("kg").agg(_count("aligned", F.col("a") == 1), _count("in_triples", (F.col("a") == 1) & (F.col("t") == 1)), _count("missing", F.col("t").isNull()), _count("not_aligned", F.col("a").isNull()))


def attribute_coverage(triples: DataFrame) -> DataFrame:
    """kg, only_triples, only_attributes, both."""
    rel = entities(relation_triples(triples)).withColumn("r", F.lit(1))
    attr = subjects(attribute_triples(triples)).withColumn("a", F.lit(1))
    return rel.join(attr, ["kg", "entity"], "full").groupBy("kg").agg(_count("only_triples", F.col("a").isNull()), _count("only_attributes", F.col("r").isNull()), _count("both", (F.col("a") == 1) & (F.col("r") == 1)))


def data_density(triples: DataFrame, splits: DataFrame) -> DataFrame:
    """kg, split, avg_attributes, avg_relations (as subject), without_attributes."""
    ends = splits.select("split", F.lit(1).alias("kg"), F.col("e1").alias("entity")).unionByName(splits.select("split", F.lit(2).alias("kg"), F.col("e2").alias("entity")))
    counts = triples.groupBy("kg", F.col("s").alias("entity")).agg(_count("_attr", F.col("o_kind") == "lit"), _count("_rel", F.col("o_kind") == "uri"))
    rows = ends.join(counts, ["kg", "entity"], "left").select("kg", "split", F.coalesce("_attr", F.lit(0)).alias("_attr"), F.coalesce("_rel", F.lit(0)).alias("_rel"))
    return rows.groupBy("kg", "split").agg(F.avg("_attr").alias("avg_attributes"), F.avg("_rel").alias("avg_relations"), _count("without_attributes", F.col("_attr") == 0))


def functionality(triples: DataFrame) -> DataFrame:
    """kg, p, value: distinct subjects by uses; relations also inverted, as ``p-``."""
    rel = relation_triples(triples)
    rows = triples.select("kg", "p", "s").unionByName(rel.select("kg", F.concat("p", F.lit("-")).alias("p"), F.col("o").alias("s")))
    return rows.groupBy("kg", "p").agg((F.countDistinct("s") / F.count(F.lit(1))).alias("value"))


def first_of(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` distinct rows of each key. A limit by rank is also applied before the exchange, so a hub sends at
    most that many rows a task and its list is never gathered whole."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.select(*keys, *order).distinct().withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def padded_neighbours(triples: DataFrame, most: int, pad: str = "") -> DataFrame:
    """kg, node, neighbours: sorted distinct neighbours in both directions, cut and padded to ``most``."""
    lists = first_of(edges(triples), ["kg", "node"], ["other"], most).groupBy("kg", "node").agg(F.sort_array(F.collect_list("other")).alias("n"))
    return lists.select("kg", "node", F.slice(F.concat("n", F.array_repeat(F.lit(pad), most)), 1, most).alias("neighbours"))


def relation_neighbours(triples: DataFrame, most: int = 1000) -> DataFrame:
    """kg, node, facts: (relation, neighbour) with inverse relations as ``p-``, sorted, at most ``most``."""
    rows = edges(triples).select("kg", "node", F.when(F.col("direction") == "in", F.concat("p", F.lit("-"))).otherwise(F.col("p")).alias("p"), "other")
    return first_of(rows, ["kg", "node"], ["p", "other"], most).groupBy("kg", "node").agg(F.array_sort(F.collect_list(F.struct("p", "other"))).alias("facts"))


def entity_values(triples: DataFrame, most: int, pad: str = "") -> DataFrame:
    """kg, s, o_values: sorted distinct literals, cut and padded."""
    lists = first_of(attribute_triples(triples), ["kg", "s"], ["o"], most).groupBy("kg", "s").agg(F.sort_array(F.collect_list("o")).alias("v"))
    return lists.select("kg", "s", F.slice(F.concat("v", F.array_repeat(F.lit(pad), most)), 1, most).alias("o_values"))


def idf_weights(triples: DataFrame) -> DataFrame:
    """kg, p, n, weight = ln(1 + N / n) / ln(1 + N) over the graph's attribute triples."""
    counts = attribute_triples(triples).groupBy("kg", "p").agg(_count("n"))
    total = F.broadcast(counts.groupBy("kg").agg(F.sum("n").alias("_all")))
    return counts.join(total, "kg").select("kg", "p", "n", (F.log1p(F.col("_all") / F.col("n")) / F.log1p(F.col("_all").cast("double"))).alias("weight"))


def literal_blocks(triples: DataFrame) -> DataFrame:
    """kg, value, n: entities that share a literal."""
    return attribute_triples(triples).groupBy("kg", F.col("o").alias("value")).agg(F.countDistinct("s").alias("n"))


def word_blocks(triples: DataFrame) -> DataFrame:
    """kg, word, n: entities whose literals hold a word."""
    words = attribute_triples(triples).select("kg", "s", F.explode(F.split(F.lower("o"), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("kg", "word").agg(F.countDistinct("s").alias("n"))


def char_vocabulary(triples: DataFrame) -> DataFrame:
    """ch, id from 1 in code point order; 0 pads."""
    from twinweave.operators.relational import sorted_ids

    chars = attribute_triples(triples).select(F.explode(F.split("o", "")).alias("ch")).where("ch <> ''")
    return sorted_ids(chars, "ch").select("ch", (F.col("id") + 1).alias("id"))


def vocabulary_limits(vocab: DataFrame, ids: DataFrame) -> DataFrame:
    """kg, vocabulary_size: one more than the last position that holds an entity of the graph."""
    return vocab.join(ids.select("kg", F.col("entity").alias("token")), "token").groupBy("kg").agg((F.max("id") + 1).alias("vocabulary_size"))


def typed_values(triples: DataFrame) -> DataFrame:
    """kg, s, o_values, types: literals in order of predicate and value with the predicate's first-seen number."""
    from twinweave.operators.relational import sorted_ids

    types = sorted_ids(attribute_triples(triples), "p").withColumnRenamed("id", "type")
    rows = attribute_triples(triples).join(types, "p")
    lists = rows.groupBy("kg", "s").agg(F.array_sort(F.collect_list(F.struct("type", "o"))).alias("v"))
    return lists.select("kg", "s", F.transform("v", lambda x: x["o"]).alias("o_values"), F.transform("v", lambda x: x["type"]).alias("types"))


def stage_summary(data: Dataset) -> DataFrame:
    """``kg_statistics`` with the number of aligned pairs: the rows of a stage's summary."""
    return kg_statistics(data.triples).crossJoin(F.broadcast(data.alignment.agg(_count("aligned_pairs"))))
