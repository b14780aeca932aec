"""Training-data structure: merged, swapped and masked triples, adjacency, relation features and reflection layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.operators.relational import attribute_triples, edges, relation_triples
from twinweave.plans.joins import keyed_join
from twinweave.plans.kg import Dataset
from twinweave.plans.storage import cut


def _partner(pairs: DataFrame, key: str, value: str, kind: str = "max") -> DataFrame:
    return pairs.groupBy(F.col(key).alias("_e")).agg(getattr(F, kind)(value).alias("_to"))


def rename_ends(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Both ends through (_e, _to); literals stay."""
    rows = triples.join(names.toDF("s", "_s"), "s", "left").withColumn("s", F.coalesce("_s", "s")).drop("_s")
    keyed = names.toDF("o", "_o").withColumn("o_kind", F.lit("uri"))
    return rows.join(keyed, ["o", "o_kind"], "left").withColumn("o", F.coalesce("_o", "o")).drop("_o")


def merged_triples(data: Dataset) -> DataFrame:
    """s, p, o: both graphs' relations with e2 renamed to e1 over all aligned pairs."""
    two = rename_ends(relation_triples(data.graph(2)), _partner(data.alignment, "e2", "e1"))
    return relation_triples(data.graph(1)).select("s", "p", "o").unionByName(two.select("s", "p", "o")).distinct()


def equivalence_expansion(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds triples with the head, and triples with the tail, replaced by its equivalent in ``pairs``, one side at a time."""
    same = pairs.select(F.col("e1").alias("_a"), F.col("e2").alias("_b")).unionByName(pairs.select(F.col("e2").alias("_a"), F.col("e1").alias("_b")))
    heads = triples.join(same, F.col("s") == F.col("_a")).select(F.col("_b").alias("s"), "p", "o")
    tails = triples.join(same, F.col("o") == F.col("_a")).select("s", "p", F.col("_b").alias("o"))
    return triples.select("s", "p", "o").unionByName(heads).unionByName(tails).distinct()


def masked(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o", F.explode(F.array(F.lit("MASK_0"), F.lit("MASK_2"))).alias("mask"))


def swapped(data: Dataset, links: DataFrame, kind: str) -> DataFrame:
    """kg, s, p, o: triples of linked entities copied to the partner; relations also by their object."""
    rows = (relation_triples if kind == "uri" else attribute_triples)(data.triples)
    both = links.select(F.lit(1).alias("kg"), F.col("e1").alias("_a"), F.col("e2").alias("_b")).unionByName(links.select(F.lit(2).alias("kg"), F.col("e2").alias("_a"), F.col("e1").alias("_b")))
    heads = rows.join(both, (rows.kg == both.kg) & (F.col("s") == F.col("_a"))).select((3 - rows.kg).alias("kg"), F.col("_b").alias("s"), "p", "o")
    if kind != "uri":
        return heads.distinct()
    tails = rows.join(both, (rows.kg == both.kg) & (F.col("o") == F.col("_a"))).select((3 - rows.kg).alias("kg"), "s", "p", F.col("_b").alias("o"))
    return heads.unionByName(tails).distinct()


def weighted_predicates(triples: DataFrame, matches: DataFrame, default: float = 0.2) -> DataFrame:
    """kg, s, p, o, weight: predicates replaced by their match (p1, p2, similarity), weights stretched to [0.5, 1]."""
    least = F.broadcast(matches.agg(F.min("similarity").alias("_min")))
    scaled = matches.crossJoin(least).withColumn("_w", F.when(F.col("_min") < 1, 1 - (1 - F.col("similarity")) * 0.5 / (1 - F.col("_min"))).otherwise(1.0))
    names = scaled.select(F.lit(1).alias("kg"), F.col("p1").alias("p"), F.col("p2").alias("_to"), "_w").unionByName(scaled.select(F.lit(2).alias("kg"), F.col("p2").alias("p"), F.col("p1").alias("_to"), "_w"))
    best = names.groupBy("kg", "p").agg(F.max(F.struct("_w", "_to")).alias("m"))
    return triples.join(best, ["kg", "p"], "left").select("kg", "s", F.coalesce("m._to", "p").alias("p"), "o", F.coalesce("m._w", F.lit(default)).alias("weight"))


def updated_matches(initial: DataFrame, latent: DataFrame, weight: float = 0.7, soft: float = 0.5) -> DataFrame:
    """p1, p2, similarity: weighted mean of both similarities, above ``soft``."""
    both = initial.withColumnRenamed("similarity", "a").join(latent.withColumnRenamed("similarity", "b"), ["p1", "p2"])
    return both.select("p1", "p2", (weight * F.col("a") + (1 - weight) * F.col("b")).alias("similarity")).where(F.col("similarity") > soft)


def stub_loops(data: Dataset) -> DataFrame:
    """kg, s, p, o: a self-loop for each linked entity without a relation."""
    linked = data.alignment.select(F.lit(1).alias("kg"), F.col("e1").alias("s")).unionByName(data.alignment.select(F.lit(2).alias("kg"), F.col("e2").alias("s"))).distinct()
    busy = edges(data.triples).select("kg", F.col("node").alias("s")).distinct()
    return linked.join(busy, ["kg", "s"], "left_anti").select("kg", "s", F.lit("stub").alias("p"), F.col("s").alias("o"))


def normalised_adjacency(triples: DataFrame) -> DataFrame:
    """kg, row, col, val of D^-1/2 A D^-1/2 with self-loops; parallel relations count once."""
    both = edges(triples).select("kg", F.col("node").alias("row"), F.col("other").alias("col"))
    cells = both.unionByName(both.select("kg", "row", F.col("row").alias("col"))).distinct()
    degree = cells.groupBy("kg", "row").agg(F.count(F.lit(1)).alias("d"))
    joined = cells.join(degree.withColumnRenamed("d", "dr"), ["kg", "row"]).join(degree.toDF("kg", "col", "dc"), ["kg", "col"])
    return joined.select("kg", "row", "col", (1 / (F.sqrt("dr") * F.sqrt("dc"))).alias("val"))


def relation_edge_index(triples: DataFrame) -> DataFrame:
    """kg, head, tail, relation, weight: edges both ways, inverse relations as ``p-``, weight 1 / relations of the pair."""
    rows = edges(triples).select("kg", F.col("node").alias("head"), F.col("other").alias("tail"), F.when(F.col("direction") == "in", F.concat("p", F.lit("-"))).otherwise(F.col("p")).alias("relation")).distinct()
    n = rows.groupBy("kg", "head", "tail").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, ["kg", "head", "tail"]).select("kg", "head", "tail", "relation", (1 / F.col("n")).alias("weight"))


def relation_features(triples: DataFrame) -> DataFrame:
    """kg, entity, p, direction, n: incoming and outgoing uses of each relation."""
    return edges(triples).groupBy("kg", F.col("node").alias("entity"), "p", "direction").agg(F.count(F.lit(1)).alias("n"))


def _dot(v: Column, weights: list[float]) -> Column:
    """Inner product of a vector column and constants."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.get(v, F.lit(i)) * F.lit(float(w))
    return total


def _sums(width: int, value) -> list[Column]:
    return [F.sum(value(i)).alias(f"_{i}") for i in range(width)]


def _packed(width: int, value) -> Column:
    return F.array(*[value(F.col(f"_{i}")) for i in range(width)])


def relation_directions(edge_list: DataFrame, relations: DataFrame, width: int) -> DataFrame:
    """node, other, n, r: each edge's unit vector of the weighted sum of its relations' vectors, and its number of entries.

    ``edge_list`` has node, other, p, weight; ``relations`` p, embedding. A sum of zero stays zero.
    """
    rows = keyed_join(edge_list, relations.select("p", F.col("embedding").alias("_v")), "p", "node")
    sums = rows.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"), *_sums(width, lambda i: F.col("weight") * F.get("_v", F.lit(i))))
    length = F.sqrt(sum((F.col(f"_{i}") * F.col(f"_{i}") for i in range(width)), F.lit(0.0)))
    return sums.select("node", "other", "n", _packed(width, lambda c: F.when(length > 0, c / length).otherwise(0.0)).alias("r"))


def reflection_layer(directions: DataFrame, vectors: DataFrame, kernel: tuple[list[float], list[float], list[float]]) -> DataFrame:
    """id, embedding: attention over neighbours that are mirrored at the hyperplane of the edge's relation.

    A neighbour x becomes x - 2 (x.r) r. The kernel's three weights, for the node, the mirrored neighbour and the relation,
    score an edge; a node's output is the mean of its mirrored neighbours, weighted by softmax over its edges. Nodes without
    edges become zero. Scores are taken off the largest of all, as sums then need no second pass over a node's edges: a hub
    is added up where its edges are, and its own score and vector reach them by salted joins.
    """
    mine, theirs, edge = kernel
    # ``directions`` is read several times, so it should be a stored table.
    width = len(mine)
    own = vectors.select(F.col("id").alias("node"), _dot(F.col("embedding"), mine).alias("_own"))
    rows = keyed_join(directions, own, "node", "other", directions)
    rows = keyed_join(rows, vectors.select(F.col("id").alias("other"), F.col("embedding").alias("_x")), "other", "node", directions)
    along = sum((F.get("_x", F.lit(i)) * F.get("r", F.lit(i)) for i in range(width)), F.lit(0.0))
    rows = rows.withColumn("_along", along).withColumn("_y", F.zip_with("_x", "r", lambda x, r: x - 2 * F.col("_along") * r))
    rows = rows.select("node", "n", "_y", (F.col("_own") + _dot(F.col("_y"), theirs) + _dot(F.col("r"), edge)).alias("score"))
    rows = cut(rows)
    top = F.broadcast(rows.agg(F.max("score").alias("_top")))
    rows = rows.crossJoin(top).withColumn("_e", F.col("n") * F.exp(F.col("score") - F.col("_top")))
    sums = rows.groupBy("node").agg(F.sum("_e").alias("_t"), *_sums(width, lambda i: F.col("_e") * F.get("_y", F.lit(i))))
    made = sums.select(F.col("node").alias("id"), _packed(width, lambda c: c / (F.col("_t") + 1e-16)).alias("_made"))
    return vectors.select("id").join(made, "id", "left").select("id", F.coalesce("_made", F.array_repeat(F.lit(0.0), width)).alias("embedding"))


def reflection_stack(edge_list: DataFrame, vectors: DataFrame, relations: DataFrame, kernels: list[tuple[list[float], list[float], list[float]]], activation=F.tanh) -> DataFrame:
    """id, embedding: the activated vectors and the activated output of each layer after them, one behind the other."""
    directions = cut(relation_directions(edge_list, relations, len(kernels[0][0])))
    active = lambda v: v.select("id", F.transform("embedding", activation).alias("embedding"))
    current = cut(active(vectors.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))))
    out = current
    for i, kernel in enumerate(kernels):
        current = cut(active(reflection_layer(directions, current, kernel)))
        out = out.join(current.withColumnRenamed("embedding", f"_{i}"), "id").select("id", F.concat("embedding", f"_{i}").alias("embedding"))
    return out
