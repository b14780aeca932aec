"""Filters, projections, joins, set operations and dictionary encoding over triples and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.plans.kg import Dataset
from twinweave.plans.ranks import global_row_number
from twinweave.plans.storage import cut


def relation_triples(triples: DataFrame) -> DataFrame:
    return triples.where("o_kind = 'uri'")


def attribute_triples(triples: DataFrame) -> DataFrame:
    return triples.where("o_kind = 'lit'")


def subjects(triples: DataFrame) -> DataFrame:
    """Distinct (kg, entity) over subjects."""
    return triples.select("kg", F.col("s").alias("entity")).distinct()


def entities(triples: DataFrame) -> DataFrame:
    """Distinct (kg, entity) over subjects and URI objects."""
    return triples.select("kg", F.col("s").alias("entity")).unionByName(relation_triples(triples).select("kg", F.col("o").alias("entity"))).distinct()


def local_name(uri: Column) -> Column:
    """What follows the last slash or hash, then the last colon; underscores become spaces."""
    return F.translate(F.regexp_extract(F.regexp_extract(uri, "([^#/]*)$", 1), "([^:]*)$", 1), "_", " ")


def clean_predicates(triples: DataFrame, attr_names: DataFrame) -> DataFrame:
    """kg, p, name: the given label, else the local name."""
    used = triples.select("kg", "p").distinct()
    return used.join(attr_names, ["kg", "p"], "left").select("kg", "p", F.coalesce(F.expr("nullif(trim(label), '')"), local_name(F.col("p"))).alias("name"))


def predicate_token(p: Column) -> Column:
    """Lower-case predicate with underscores for spaces and without angle brackets."""
    return F.lower(F.translate(F.regexp_replace(p, "[<>]", ""), " ", "_"))


def remap_predicates(triples: DataFrame, attr_match: DataFrame) -> DataFrame:
    """Graph 2's predicates by their matched graph-1 names; of several matches the greatest name counts."""
    best = attr_match.groupBy(F.col("p2").alias("p")).agg(F.max("p1").alias("_to"))
    left, right = triples.where("kg = 1"), triples.where("kg = 2").join(best, "p", "left").withColumn("p", F.coalesce("_to", "p")).drop("_to")
    return left.unionByName(right)


def canonical_only(triples: DataFrame, attr_match: DataFrame) -> DataFrame:
    """Drops graph 2's attribute triples whose remapped predicate isn't one of graph 1's."""
    remapped = remap_predicates(triples, attr_match)
    known = attribute_triples(triples).where("kg = 1").select("p").distinct()
    kept = attribute_triples(remapped).where("kg = 2").join(known, "p", "left_semi").select(triples.columns)
    return attribute_triples(remapped).where("kg = 1").unionByName(kept).unionByName(relation_triples(remapped))


def clean_noisy_attributes(triples: DataFrame, most: int) -> DataFrame:
    """Attribute triples whose entity and predicate have at most ``most`` distinct values."""
    few = attribute_triples(triples).groupBy("kg", "s", "p").agg(F.countDistinct("o").alias("_n")).where(F.col("_n") <= most).select("kg", "s", "p")
    return attribute_triples(triples).join(few, ["kg", "s", "p"], "left_semi")


def scrub_literal(value: Column) -> Column:
    """Value up to a type or language mark, without .(),\" and with spaces for _-/."""
    cut = F.regexp_replace(value, r'"(\^\^|@en).*$', "")
    return F.trim(F.translate(F.regexp_replace(cut, r'[.(),"]', ""), "_-/", "   "))


def frequent_attributes(triples: DataFrame, least: int = 10) -> DataFrame:
    """Attribute triples of predicates used at least ``least`` times, scrubbed, without links."""
    used = attribute_triples(triples).groupBy("kg", "p").count().where(F.col("count") >= least).select("kg", "p")
    rows = attribute_triples(triples).join(used, ["kg", "p"], "left_semi").withColumn("o", scrub_literal(F.col("o")))
    return rows.where(~F.col("o").contains("http")).select(triples.columns)


def without_long_numbers(triples: DataFrame) -> DataFrame:
    """Drops attribute triples with a token of five or more characters that holds a digit."""
    return attribute_triples(triples).where(~F.exists(F.split(F.lower("o"), r"\s+"), lambda t: (F.length(t) >= 5) & t.rlike("[0-9]")))


def priority_attribute(triples: DataFrame, priority: DataFrame) -> DataFrame:
    """kg, s, value of the entity's best predicate: least priority, then least value; typed values are cut."""
    rows = attribute_triples(triples).join(priority, "p")
    return rows.groupBy("kg", "s").agg(F.min_by(F.regexp_replace("o", r"\^\^<.*$", ""), F.struct("priority", "o")).alias("value"))


def endpoints_known(triples: DataFrame, known: DataFrame) -> DataFrame:
    """Relation triples with both ends among ``known`` (kg, entity)."""
    return relation_triples(triples).join(known.toDF("kg", "s"), ["kg", "s"], "left_semi").join(known.toDF("kg", "o"), ["kg", "o"], "left_semi").select(triples.columns)


def prune(triples: DataFrame, removed: DataFrame) -> DataFrame:
    """Triples that touch no removed (kg, entity); literals never match."""
    gone_o = removed.toDF("kg", "o").withColumn("o_kind", F.lit("uri"))
    return triples.join(removed.toDF("kg", "s"), ["kg", "s"], "left_anti").join(gone_o, ["kg", "o", "o_kind"], "left_anti").select(triples.columns)


def supported_pairs(data: Dataset) -> DataFrame:
    """Pairs whose both sides have at least one relation and one attribute."""
    ends = entities(relation_triples(data.triples))
    attrs = subjects(attribute_triples(data.triples))
    pairs = data.alignment
    for kg, e in ((1, "e1"), (2, "e2")):
        for known in (ends, attrs):
            pairs = pairs.join(known.where(F.col("kg") == kg).select(F.col("entity").alias(e)), e, "left_semi")
    return pairs.select("e1", "e2")


def aligned_attributes(data: Dataset) -> DataFrame:
    """e1, p1, v1, p2, v2: an aligned pair's literals under matched predicates, the first match of each source value."""
    left = attribute_triples(data.graph(1)).select(F.col("s").alias("e1"), F.col("p").alias("p1"), F.col("o").alias("v1"))
    right = attribute_triples(data.graph(2)).select(F.col("s").alias("e2"), F.col("p").alias("p2"), F.col("o").alias("v2"))
    found = left.join(data.attr_match, "p1").join(data.alignment, "e1").join(right, ["e2", "p2"])
    return found.groupBy("e1", "p1", "v1").agg(F.min(F.struct("e2", "p2", "v2")).alias("m")).select("e1", "p1", "v1", "m.p2", "m.v2")


def matched_values(data: Dataset) -> DataFrame:
    """e1, e2, p1, p2, o1, o2: every pair of literals of an aligned pair under matched predicates."""
    left = attribute_triples(data.graph(1)).select(F.col("s").alias("e1"), F.col("p").alias("p1"), F.col("o").alias("o1"))
    right = attribute_triples(data.graph(2)).select(F.col("s").alias("e2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
    found = left.join(data.attr_match, "p1").join(data.alignment, "e1").join(right, ["e2", "p2"])
    return found.select("e1", "e2", "p1", "p2", "o1", "o2")


def common_predicates(data: Dataset) -> DataFrame:
    """e1, e2, name, v1, v2: predicates with the same token on both sides; the greatest value counts."""
    names = {1: "e1", 2: "e2"}
    sides = [attribute_triples(data.graph(k)).groupBy(F.col("s").alias(e), local_name(F.col("p")).alias("name")).agg(F.max("o").alias(f"v{k}")) for k, e in names.items()]
    return data.alignment.join(sides[0], "e1").join(sides[1], ["e2", "name"]).select("e1", "e2", "name", "v1", "v2")


def predicate_value_pairs(triples: DataFrame, matches: DataFrame, per_side: int = 1000, per_predicate: int = 100) -> DataFrame:
    """p1, p2, v1, v2: value pairs of matched predicates, by rank of the pair's hash; both limits are the operator's own."""
    def side(kg: int) -> DataFrame:
        values = attribute_triples(triples).where(F.col("kg") == kg).select("p", "o").distinct()
        rank = F.row_number().over(W.partitionBy("p").orderBy(F.md5("o"), "o"))
        return values.withColumn("_r", rank).where(F.col("_r") <= per_side).select(F.col("p").alias(f"p{kg}"), F.col("o").alias(f"v{kg}"))

    pairs = side(1).join(matches, "p1").join(side(2), "p2")
    rank = F.row_number().over(W.partitionBy("p1", "p2").orderBy(F.md5(F.concat_ws("|", "v1", "v2")), "v1", "v2"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= per_predicate).select("p1", "p2", "v1", "v2")


def set_graph(data: Dataset) -> DataFrame:
    """s, p, o, o_kind with both ends of aligned pairs renamed to one node ``set:e1|e2``; a last partner wins."""
    pairs = data.alignment.withColumn("node", F.concat(F.lit("set:"), "e1", F.lit("|"), "e2"))
    parts = []
    for kg, e in ((1, "e1"), (2, "e2")):
        names = pairs.groupBy(F.col(e).alias("_e")).agg(F.max("node").alias("_node"))
        rows = data.graph(kg).join(names.toDF("s", "_s"), "s", "left").withColumn("s", F.coalesce("_s", "s"))
        named = names.toDF("o", "_o").withColumn("o_kind", F.lit("uri"))
        parts.append(rows.join(named, ["o", "o_kind"], "left").select("s", "p", F.coalesce("_o", "o").alias("o"), "o_kind"))
    return parts[0].unionByName(parts[1]).distinct()


def edges(triples: DataFrame) -> DataFrame:
    """kg, node, p, other, direction: each relation seen from both ends."""
    rel = relation_triples(triples)
    out = rel.select("kg", F.col("s").alias("node"), "p", F.col("o").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(rel.select("kg", F.col("o").alias("node"), "p", F.col("s").alias("other"), F.lit("in").alias("direction")))


#: Nodes around one neighbour that a task pairs with as many others at a time.
BRIDGE_ROWS = 2_048


def bridged(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: distinct pairs of ``nodes`` (kg, entity) that share a neighbour outside ``nodes``.

    The nodes around a neighbour are dealt into blocks of about BRIDGE_ROWS, and each two blocks meet in one cell, so a hub is
    never one task. Only two nodes of several neighbours can share more than one; no other pairs are made distinct.
    The result has as many rows as there are such pairs: a hub's square, so pass a frontier, not all nodes.
    """
    ends = edges(triples).select("kg", "node", "other").distinct()
    inner = cut(ends.join(nodes.toDF("kg", "node"), ["kg", "node"], "left_semi").join(nodes.toDF("kg", "other"), ["kg", "other"], "left_anti"))
    several = inner.groupBy("kg", "node").agg((F.count(F.lit(1)) > 1).alias("several"))
    blocks = inner.groupBy("kg", "other").agg(F.ceil(F.count(F.lit(1)) / BRIDGE_ROWS).alias("blocks"))
    rows = inner.join(several, ["kg", "node"]).join(blocks, ["kg", "other"])
    rows = cut(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    cell = ["kg", "other", "i", "j"]
    cells = blocks.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    tasks = int(min(cells, 32 * triples.sparkSession.sparkContext.defaultParallelism))  # small inputs make large cells: not merged by size

    def pairs(members: DataFrame) -> DataFrame:
        x = members.select("kg", "other", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.col("node").alias("x"), F.col("several").alias("x_several"))
        y = members.select("kg", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("node").alias("y"), F.col("several").alias("y_several"))
        return x.repartition(tasks, *cell).join(y.repartition(tasks, *cell).hint("merge"), cell).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))

    named = lambda df: df.select("kg", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    once, many = named(pairs(rows).where(~(F.col("x_several") & F.col("y_several")))), rows.where("several")
    return once if many.isEmpty() else once.unionByName(named(pairs(many)).distinct())


def disjoint_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs in both inputs; a valid split has none."""
    return a.select("e1", "e2").intersect(b.select("e1", "e2"))


def sorted_ids(values: DataFrame, col: str) -> DataFrame:
    """col, id: 0 to n - 1 in sorted order of the distinct values."""
    return global_row_number(values.select(col).distinct(), [col], "id").withColumn("id", F.col("id") - 1)


def first_seen_ids(triples: DataFrame, offset: str = "count") -> DataFrame:
    """kg, entity, id in order of first occurrence in the sorted triples; graph 2 starts after graph 1's ids."""
    parts, start = [], F.lit(0).cast("long")
    for kg in (1, 2):
        rows = global_row_number(triples.where(F.col("kg") == kg), ["s", "p", "o"], "_pos")
        ends = F.when(F.col("o_kind") == "uri", F.array("s", "o")).otherwise(F.array("s"))
        seen = rows.select("_pos", F.posexplode(ends).alias("_i", "entity")).groupBy("entity").agg(F.min(F.col("_pos") * 2 + F.col("_i")).alias("_first"))
        ids = global_row_number(seen, ["_first"], "id").select(F.lit(kg).alias("kg"), "entity", (F.col("id") - 1).alias("id"))
        if kg == 2:
            ids = ids.crossJoin(F.broadcast(parts[0].agg(F.count(F.lit(1)).alias("_n")))).select("kg", "entity", (F.col("id") + F.col("_n")).alias("id"))
        parts.append(ids)
    return parts[0].unionByName(parts[1])


def interleaved_ids(counts: DataFrame) -> DataFrame:
    """kg, entity, id from (kg, entity, n): by falling count and name, graph 1 gets even, graph 2 odd ids; the longer
    graph's rest follows without gaps."""
    parts = [global_row_number(counts.where(F.col("kg") == kg).withColumn("_neg", -F.col("n")), ["_neg", F.col("entity").desc()], "rank").withColumn("rank", F.col("rank") - 1) for kg in (1, 2)]
    sizes = F.broadcast(counts.groupBy().agg(F.count(F.when(F.col("kg") == 1, 1)).alias("n1"), F.count(F.when(F.col("kg") == 2, 1)).alias("n2")))
    both = parts[0].unionByName(parts[1]).crossJoin(sizes).withColumn("_m", F.least("n1", "n2"))
    place = F.when(F.col("rank") < F.col("_m"), 2 * F.col("rank") + F.col("kg") - 1).otherwise(F.col("_m") + F.col("rank"))
    return both.select("kg", "entity", place.cast("long").alias("id"))


def shared_ids(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Ids with linked graph-2 entities under the id of their graph-1 partner."""
    one = ids.where("kg = 1").select(F.col("entity").alias("e1"), F.col("id").alias("_id"))
    linked = links.join(one, "e1").groupBy(F.col("e2").alias("entity")).agg(F.max("_id").alias("_id"))
    two = ids.where("kg = 2").join(linked, "entity", "left").select("kg", "entity", F.coalesce("_id", "id").alias("id"))
    return ids.where("kg = 1").select("kg", "entity", "id").unionByName(two)


def vocabulary(triples: DataFrame, special: int = 100) -> DataFrame:
    """token, id: special tokens, then sorted entities, then sorted relations."""
    rel = relation_triples(triples)
    names = rel.select(F.col("s").alias("token")).unionByName(rel.select(F.col("o").alias("token"))).distinct().withColumn("_k", F.lit(1))
    relations = rel.select(F.col("p").alias("token")).distinct().withColumn("_k", F.lit(2))
    ranked = global_row_number(names.unionByName(relations).withColumn("_key", F.concat(F.col("_k").cast("string"), "token")), ["_key"], "id")
    reserved = triples.sparkSession.range(special).select(F.format_string("[UNUSED%d]", "id").alias("token"), "id")
    return reserved.unionByName(ranked.select("token", (F.col("id") + special - 1).alias("id")))
