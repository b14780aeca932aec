"""Augmentation: synthetic pairs expanded from aligned seeds. Value generators are column expressions or pandas UDFs that
take the seed value and a hash key; everything else is joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.functions.generators import eda_variants, variation
from twinweave.operators.frontier import expanded_nodes
from twinweave.operators.profile import first_of
from twinweave.operators.relational import aligned_attributes, attribute_triples, edges, local_name, relation_triples
from twinweave.operators.splits import keep_by_hash, pair_budget, ratio_count, with_total
from twinweave.plans.kg import Dataset
from twinweave.plans.ranks import global_row_number, hash_key
from twinweave.plans.registry import AUGMENTERS
from twinweave.plans.storage import cut

Generator = Callable[[Column, Column], Column]


def expand_pairs(seeds: DataFrame) -> DataFrame:
    """e1, e2, a1, a2, n: seeds numbered in order with the URIs of their synthetic pair."""
    numbered = global_row_number(seeds.select("e1", "e2"), ["e1", "e2"], "n")
    return numbered.select("e1", "e2", X.minted(F.col("e1"), F.col("n")).alias("a1"), X.minted(F.col("e2"), F.col("n")).alias("a2"), "n")


def expanded_ends(expanded: DataFrame) -> DataFrame:
    """kg, e, a over both sides."""
    return expanded.select(F.lit(1).alias("kg"), F.col("e1").alias("e"), F.col("a1").alias("a")).unionByName(expanded.select(F.lit(2).alias("kg"), F.col("e2").alias("e"), F.col("a2").alias("a")))


def mirrored_relations(triples: DataFrame, expanded: DataFrame) -> DataFrame:
    """kg, s, p, o, o_kind: relations between expanded entities, in the graph that has the original, and from expanded
    entities to the others' originals; incoming edges likewise."""
    ends = expanded_ends(expanded)
    rel = relation_triples(triples)
    rows = rel.join(ends.toDF("kg", "s", "_s"), ["kg", "s"], "left").join(ends.toDF("kg", "o", "_o"), ["kg", "o"], "left").where("_s is not null or _o is not null")
    return rows.select("kg", F.coalesce("_s", "s").alias("s"), "p", F.coalesce("_o", "o").alias("o"), "o_kind").distinct()


def copied_literals(triples: DataFrame, expanded: DataFrame) -> DataFrame:
    """Literals of either side of a pair attached to both synthetic entities, verbatim."""
    sides = expanded.select(F.col("e1").alias("s"), F.lit(1).alias("kg"), "a1", "a2").unionByName(expanded.select(F.col("e2").alias("s"), F.lit(2).alias("kg"), "a1", "a2"))
    rows = attribute_triples(triples).join(sides, ["kg", "s"])
    both = F.explode(F.array(F.struct(F.lit(1).alias("kg"), F.col("a1").alias("s")), F.struct(F.lit(2).alias("kg"), F.col("a2").alias("s")))).alias("t")
    return rows.select(both, "p", "o", "o_kind").select("t.kg", "t.s", "p", "o", "o_kind").distinct()


def cached_values(data: Dataset, known: DataFrame, least: float = 0.3) -> DataFrame:
    """e1, p1, v1, e2, p2, v2 of aligned pairs under known predicate alignments (p1, p2, combined) that their values bear out;
    of several partners of a pair's predicate, on either side, the one of the highest confidence stays."""
    from twinweave.operators.selection import cached_matches

    lit = attribute_triples(data.triples)
    side = lambda kg, e, p, v: lit.where(F.col("kg") == kg).groupBy(F.col("s").alias(e), F.col("p").alias(p)).agg(F.min("o").alias(v))
    pairs = data.alignment.select("e1", "e2").join(side(1, "e1", "p1", "o1"), "e1").join(known.select("p1", "p2").distinct(), "p1").join(side(2, "e2", "p2", "o2"), ["e2", "p2"])
    sure = cached_matches(pairs, known, least)
    for one, other in (("p1", "p2"), ("p2", "p1")):
        top = sure.groupBy("e1", "e2", one).agg(F.max_by(other, F.struct(F.col("confidence"), F.col(other))).alias(other))
        sure = sure.join(top, ["e1", "e2", "p1", "p2"], "left_semi")
    return sure.join(pairs, ["e1", "e2", "p1", "p2"]).select("e1", "p1", F.col("o1").alias("v1"), "e2", "p2", F.col("o2").alias("v2"))


def generated_literals(data: Dataset, expanded: DataFrame, generator: Generator = variation, known: DataFrame | None = None, unmatched: float = 1.0, seed: int = 42) -> DataFrame:
    """Literals for synthetic entities. Matched predicates interpolate the first value of either side; unmatched ones vary
    their own first value, a share ``unmatched`` of them by hash. With ``known`` predicate alignments (p1, p2, combined),
    a pair's values must bear a match out (``cached_values``); without, the data's matches hold for every pair. A value is
    generated once for each distinct order-free key, so equal inputs agree everywhere."""
    matched = aligned_attributes(data) if known is None else cached_values(data, known)
    first = matched.groupBy("e1", "p1").agg(F.min(F.struct("p2", "v1", "v2")).alias("m")).select("e1", "p1", "m.p2", "m.v1", "m.v2")
    one = first.select(F.lit(1).alias("kg"), F.col("e1").alias("e"), F.col("p1").alias("p"), F.col("v1").alias("v"))
    two = first.join(data.alignment, "e1").select(F.lit(2).alias("kg"), F.col("e2").alias("e"), F.col("p2").alias("p"), F.col("v2").alias("v"))
    own = attribute_triples(data.triples).groupBy("kg", F.col("s").alias("e"), "p").agg(F.min("o").alias("_v"))
    values = own.join(one.unionByName(two).groupBy("kg", "e", "p").agg(F.min("v").alias("v")), ["kg", "e", "p"], "left").where(F.col("v").isNotNull() | (hash_share(seed, "kg", "e", "p") < unmatched)).select("kg", "e", "p", F.coalesce("v", "_v").alias("v"))
    wanted = values.join(expanded_ends(expanded), ["kg", "e"]).withColumn("_key", X.cache_key(F.col("v")))
    made = wanted.groupBy("_key").agg(F.min("v").alias("_v")).withColumn("o", generator(F.col("_v"), F.md5("_key")))
    return wanted.join(made.select("_key", "o"), "_key").select("kg", F.col("a").alias("s"), "p", "o", F.lit("lit").alias("o_kind"))


def bfs_seeds(data: Dataset, budget: int, depth: int, seed: int = 42) -> DataFrame:
    """e1, e2, depth: at most ``budget`` pairs, reached round by round from hash-ordered seeds at depth 0.

    A set neighbour of a pair at depth d is one deeper, down to ``depth``. A pair that shares a neighbour outside the
    alignment is a bridge: it starts anew at depth 0, but only where d + 2 is still within ``depth``. Pairs of earlier rounds
    come first, then hash order; pairs that no round reaches fill the budget, at depth + 1. A neighbour is taken once a
    round however many pairs lead to it, so a hub costs its edges, not their square; rounds are stored.
    """
    pairs = data.alignment.select("e1", "e2")
    ends = pairs.select(F.lit(1).alias("kg"), F.col("e1").alias("node"), "e1", "e2").unionByName(pairs.select(F.lit(2).alias("kg"), F.col("e2").alias("node"), "e1", "e2"))
    links = edges(data.triples).select("kg", "node", "other").distinct().join(ends, ["kg", "node"]).select("kg", "other", "e1", "e2")
    inside = ends.select("kg", F.col("node").alias("other"), F.col("e1").alias("f1"), F.col("e2").alias("f2"))
    direct = cut(links.join(inside, ["kg", "other"]).select("e1", "e2", "f1", "f2").distinct())
    outside = cut(links.join(inside.select("kg", "other").distinct(), ["kg", "other"], "left_anti"))
    visited = cut(keep_by_hash(pairs, seed, lambda n: F.greatest(F.lit(1), F.floor(F.lit(budget) / 4))).select("e1", "e2", F.lit(0).alias("depth"), F.lit(0).alias("turn")))
    turn = 0
    while visited.count() < budget:
        frontier = visited.where(F.col("turn") == turn)
        near = direct.join(frontier.where(F.col("depth") < depth), ["e1", "e2"]).select(F.col("f1").alias("e1"), F.col("f2").alias("e2"), (F.col("depth") + 1).alias("depth"))
        shared = outside.join(frontier.where(F.col("depth") + 2 <= depth).select("e1", "e2"), ["e1", "e2"], "left_semi").select("kg", "other").distinct()
        bridged = outside.join(shared, ["kg", "other"], "left_semi").select("e1", "e2", F.lit(0).alias("depth"))
        turn += 1
        found = near.unionByName(bridged).groupBy("e1", "e2").agg(F.min("depth").alias("depth")).join(visited.select("e1", "e2"), ["e1", "e2"], "left_anti")
        found = cut(found.withColumn("turn", F.lit(turn)))
        if found.isEmpty():
            break
        visited = cut(visited.unionByName(found))
    rest = pairs.join(visited, ["e1", "e2"], "left_anti").withColumns({"depth": F.lit(depth + 1), "turn": F.lit(turn + 1)})
    ranked = global_row_number(visited.unionByName(rest).withColumn("_k", hash_key(seed, "e1", "e2")), ["turn", "_k", "e1", "e2"], "_rn")
    return ranked.where(F.col("_rn") <= budget).select("e1", "e2", "depth")


def keep_value(value: Column, key: Column) -> Column:
    """A generator that makes nothing new."""
    return value


def non_set_expansion(data: Dataset, expanded: DataFrame, generator: Generator = variation) -> DataFrame:
    """kg, s, p, o, o_kind: twins of the neighbours outside the alignment of expanded pairs, with generated literals of their
    own, tied to the synthetic entities as the originals are. A twin exists in the graphs that have its original; its number
    is the neighbour's place in order, one higher in the second graph."""
    aligned = data.alignment.select(F.lit(1).alias("kg"), F.col("e1").alias("other")).unionByName(data.alignment.select(F.lit(2).alias("kg"), F.col("e2").alias("other")))
    near = edges(data.triples).join(expanded_ends(expanded).withColumnRenamed("e", "node"), ["kg", "node"]).join(aligned, ["kg", "other"], "left_anti")
    numbered = global_row_number(near.select("other").distinct(), ["other"], "n")
    twins = near.select("kg", "other").distinct().join(numbered, "other").select("kg", "other", X.minted(F.col("other"), F.col("n") + F.col("kg") - 1).alias("twin"))
    out = F.col("direction") == "out"
    tied = near.join(twins, ["kg", "other"]).select("kg", F.when(out, F.col("a")).otherwise(F.col("twin")).alias("s"), "p", F.when(out, F.col("twin")).otherwise(F.col("a")).alias("o"), F.lit("uri").alias("o_kind"))
    made = attribute_triples(data.triples).withColumnRenamed("s", "other").join(twins, ["kg", "other"])
    literals = made.select("kg", F.col("twin").alias("s"), "p", generator(F.col("o"), F.md5(X.cache_key(F.col("o")))).alias("o"), F.lit("lit").alias("o_kind"))
    return tied.unionByName(literals).distinct()


def twins_of(data: Dataset, others: DataFrame) -> DataFrame:
    """kg, e, twin of entities outside the alignment (e), in each graph that has them; the number is the entity's place in
    order, one higher in the second graph."""
    numbered = global_row_number(others.select("e").distinct(), ["e"], "n")
    held = edges(data.triples).select("kg", F.col("node").alias("e")).distinct()
    return held.join(numbered, "e").select("kg", "e", X.minted(F.col("e"), F.col("n") + F.col("kg") - 1).alias("twin"))


def twin_triples(data: Dataset, expanded: DataFrame, twins: DataFrame, generator: Generator = variation) -> DataFrame:
    """kg, s, p, o, o_kind: relations of twins with each other and with synthetic entities, as their originals have them, and
    the twins' literals, each varied from its own value."""
    ends = expanded_ends(expanded).unionByName(twins.select("kg", "e", F.col("twin").alias("a")))
    marked = twins.select("kg", F.col("e").alias("_t"))
    rel = relation_triples(data.triples).join(ends.toDF("kg", "s", "_s"), ["kg", "s"]).join(ends.toDF("kg", "o", "_o"), ["kg", "o"])
    touched = rel.join(marked.withColumnRenamed("_t", "s"), ["kg", "s"], "left_semi").unionByName(rel.join(marked.withColumnRenamed("_t", "o"), ["kg", "o"], "left_semi"))
    tied = touched.select("kg", F.col("_s").alias("s"), "p", F.col("_o").alias("o"), "o_kind")
    made = attribute_triples(data.triples).join(twins.withColumnRenamed("e", "s"), ["kg", "s"])
    literals = made.select("kg", F.col("twin").alias("s"), "p", generator(F.col("o"), F.md5(X.cache_key(F.col("o")))).alias("o"), F.lit("lit").alias("o_kind"))
    return tied.unionByName(literals).distinct()


@AUGMENTERS.register("plm")
def augment(data: Dataset, ratio: float, max_pairs: int | None = None, depth: int = 2, seed: int = 42, generator: Generator = variation, known: DataFrame | None = None, unmatched: float = 1.0, derived_from: str | None = None) -> Dataset:
    """Adds ceil(ratio * pairs) synthetic pairs, one at least, and twins of entities outside the alignment.

    The pairs and twins are those of ``frontier.expansion_frontier``. Relations are mirrored among synthetic entities and
    twins, and from synthetic entities to originals that have neither; literals are generated (see ``generated_literals`` for
    ``known`` and ``unmatched``). With ``derived_from``, a predicate, each synthetic entity points to its original.
    """
    n = data.alignment.agg(F.count(F.lit(1)).alias("n")).select(pair_budget(F.col("n"), ratio, max_pairs)).first()[0]
    seeds, others = expanded_nodes(data, n, depth, seed)
    expanded, twins = expand_pairs(seeds), cut(twins_of(data, others))
    outside = relation_triples(data.triples).join(twins.select("kg", F.col("e").alias("s")), ["kg", "s"], "left_anti").join(twins.select("kg", F.col("e").alias("o")), ["kg", "o"], "left_anti")
    new = mirrored_relations(outside, expanded).unionByName(twin_triples(data, expanded, twins, generator)).unionByName(generated_literals(data, expanded, generator, known, unmatched, seed))
    if derived_from:
        new = new.unionByName(expanded_ends(expanded).select("kg", F.col("a").alias("s"), F.lit(derived_from).alias("p"), F.col("e").alias("o"), F.lit("uri").alias("o_kind")))
    triples = data.triples.unionByName(new.select(data.triples.columns)).distinct()
    return data.with_(triples=triples, alignment=data.alignment.unionByName(expanded.select(F.col("a1").alias("e1"), F.col("a2").alias("e2"))))


@AUGMENTERS.register("eda")
def augment_eda(data: Dataset, ratio: float, seed: int = 42, alpha: float = 0.1) -> Dataset:
    """Adds floor(ratio * pairs) pairs named ``_eda_<n>`` with their subjects' triples, literals reworded."""
    seeds = keep_by_hash(data.alignment, seed, lambda n: F.floor(n * F.lit(ratio)))
    numbered = global_row_number(seeds, ["e1", "e2"], "n")
    name = lambda c: F.concat(c, F.lit("_eda_"), F.col("n").cast("string"))
    ends = numbered.select(F.lit(1).alias("kg"), F.col("e1").alias("s"), name(F.col("e1")).alias("a")).unionByName(numbered.select(F.lit(2).alias("kg"), F.col("e2").alias("s"), name(F.col("e2")).alias("a")))
    rows = data.triples.join(ends, ["kg", "s"])
    value = F.when(F.col("o_kind") == "lit", F.get(eda_variants(F.col("o"), hash_key(seed, "o"), alpha, 1), F.lit(0))).otherwise(F.col("o"))
    new = rows.select("kg", F.col("a").alias("s"), "p", value.alias("o"), "o_kind")
    return data.with_(triples=data.triples.unionByName(new), alignment=data.alignment.unionByName(numbered.select(name(F.col("e1")).alias("e1"), name(F.col("e2")).alias("e2"))))


@AUGMENTERS.register("stub")
def augment_nothing(data: Dataset, ratio: float = 0.0, seed: int = 42) -> Dataset:
    return data


def predicate_token_map(data: Dataset) -> DataFrame:
    """kg, p, token: matched predicates share ``<LOCAL>`` of graph 1's name."""
    used = attribute_triples(data.triples).select("kg", "p").distinct()
    other = data.attr_match.groupBy(F.col("p2").alias("p")).agg(F.max("p1").alias("_p")).withColumn("kg", F.lit(2))
    token = lambda c: F.concat(F.lit("<"), F.upper(F.translate(local_name(c), " ", "_")), F.lit(">"))
    return used.join(other, ["kg", "p"], "left").select("kg", "p", token(F.coalesce("_p", "p")).alias("token"))


def context_text(triples: DataFrame, most: int = 3, seed: int = 42) -> DataFrame:
    """kg, s, context: short literals of an entity with their predicates, ``most`` by hash; ``generic`` without any."""
    short = attribute_triples(triples).where(F.length("o") < 50).select("kg", "s", hash_key(seed, "s", "p", "o").alias("_h"), local_name(F.col("p")).alias("n"), "o")
    lists = first_of(short, ["kg", "s"], ["_h", "n", "o"], most).groupBy("kg", "s").agg(F.array_sort(F.collect_list(F.struct("_h", "n", "o"))).alias("c"))
    subjects = triples.select("kg", "s").distinct()
    return subjects.join(lists, ["kg", "s"], "left").select("kg", "s", F.coalesce(F.array_join(F.transform("c", lambda x: F.concat(x["n"], F.lit(": "), x["o"])), "; "), F.lit("generic")).alias("context"))


def training_rows(data: Dataset, repeats: int = 3, seed: int = 42, with_context: bool = False) -> DataFrame:
    """input, target: matched literals in both directions, ``repeats`` times, behind the predicate's token, filtered and in
    hash order of the row."""
    tokens = predicate_token_map(data).where("kg = 1").select(F.col("p").alias("p1"), "token")
    pairs = aligned_attributes(data).join(tokens, "p1")
    both = pairs.select("e1", "token", F.col("v1").alias("a"), F.col("v2").alias("b")).unionByName(pairs.select("e1", "token", F.col("v2").alias("a"), F.col("v1").alias("b")))
    rows = both.where(X.keeps_training_row(F.col("a"), F.col("b"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    if with_context:
        rows = rows.join(context_text(data.graph(1), seed=seed).select(F.col("s").alias("e1"), "context"), "e1").withColumn("token", F.concat_ws(" ", "token", F.concat(F.lit("["), "context", F.lit("]"))))
    return rows.select(F.concat_ws(" ", "token", "a").alias("input"), F.col("b").alias("target"), "copy", hash_key(seed, "token", "a", "b", "copy").alias("position"))


#: Words that training rows flip.
FLIP_PAIRS = {
    "yes": "no",
    "no": "yes",
    "true": "false",
    "false": "true",
    "left": "right",
    "right": "left",
    "up": "down",
    "down": "up",
    "top": "bottom",
    "bottom": "top",
    "start": "end",
    "end": "start",
    "on": "off",
    "off": "on",
    "active": "inactive",
    "inactive": "active",
    "enabled": "disabled",
    "disabled": "enabled",
}


def hash_share(seed: int, *cols: str) -> Column:
    """A number from 0 to 1 by the hash of the columns."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("double") / 2.0**32


def mixup_rows(data: Dataset, generator: Generator = variation, repeats: int = 3, synthetic: float = 0.3, per_token: int = 100, orphans: float = 0.5, per_name: int = 10, seed: int = 42) -> DataFrame:
    """kind, token, source, target, copy, position: rows that teach a generator, in the order of position.

    ``aligned``: matched literals that differ, both ways, ``repeats`` times. ``synthetic``: a share of them with a generated
    target. ``orphan``: at most ``per_token`` values of a token by hash, a share of them with a generated target. Those three
    pass the quality filter. ``flip``: fixed opposites and the words themselves. ``name``: variations of the many-worded
    names among the rows.
    """
    tokens = predicate_token_map(data)
    pairs = aligned_attributes(data).join(tokens.where("kg = 1").select(F.col("p").alias("p1"), "token"), "p1").where("lower(trim(v1)) <> lower(trim(v2))")
    ways = pairs.select("token", F.explode(F.array(F.struct(F.col("v1").alias("a"), F.col("v2").alias("b")), F.struct(F.col("v2").alias("a"), F.col("v1").alias("b")))).alias("w")).select("token", "w.a", "w.b")
    count = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = count(ways.select(F.lit("aligned").alias("kind"), "token", F.col("a").alias("source"), F.col("b").alias("target")), repeats)
    made = ways.where(hash_share(seed, "token", "a", "b") < synthetic).withColumn("target", generator(F.col("a"), F.md5("a"))).where("target <> a and target <> b")
    rows = rows.unionByName(count(made.select(F.lit("synthetic").alias("kind"), "token", F.col("a").alias("source"), "target"), 1))
    values = attribute_triples(data.triples).join(tokens, ["kg", "p"]).select("token", F.trim("o").alias("source")).where("source <> ''").distinct().withColumn("_h", hash_key(seed, "token", "source"))
    ranked = global_row_number(values, ["token", "_h", "source"], "_rn")
    ranked = ranked.join(ranked.groupBy("token").agg((F.min("_rn") - 1).alias("_before")), "token").where(F.col("_rn") - F.col("_before") <= per_token)
    alone = ranked.where(hash_share(seed + 1, "token", "source") < orphans).withColumn("target", generator(F.col("source"), F.md5("source"))).where("target <> source and length(target) > 2")
    rows = rows.unionByName(count(alone.select(F.lit("orphan").alias("kind"), "token", "source", "target"), 1))
    rows = rows.where(X.keeps_training_row(F.col("source"), F.col("target")))
    spark = data.triples.sparkSession
    flips = [("flip", "<value>", a, t) for a, b in FLIP_PAIRS.items() for t in (b, a)]
    rows = rows.unionByName(count(spark.createDataFrame(flips, "kind string, token string, source string, target string"), repeats))
    names = rows.where(F.lower("token").contains("<name>") & (F.size(X.tokens(F.col("source"))) >= 2) & (F.length("source") < 50)).select("token", "source").distinct()
    varied = count(names, per_name).withColumn("target", generator(F.col("source"), F.md5(F.concat_ws("|", "source", "copy")))).where("lower(target) <> lower(source)")
    rows = rows.unionByName(varied.select(F.lit("name").alias("kind"), "token", "source", "target", "copy"))
    return rows.withColumn("position", hash_key(seed, "kind", "token", "source", "target", "copy"))


__all__ = ["augment", "augment_eda", "bfs_seeds", "context_text", "copied_literals", "expand_pairs", "generated_literals", "keep_value", "mirrored_relations", "mixup_rows", "non_set_expansion", "predicate_token_map", "ratio_count", "training_rows", "with_total"]
