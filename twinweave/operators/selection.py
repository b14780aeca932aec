"""Choosing rows: model-side splits, balanced samples, negatives, names, cached matches, and where fused relations come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.operators.relational import attribute_triples, relation_triples
from twinweave.plans.kg import Dataset
from twinweave.plans.ranks import global_row_number, hash_key

#: Shares of each model's splits in order, whether the pairs are shuffled first, and what is left over.
MODEL_SPLITS = {
    "multiKE": ((("train", 0.2), ("valid", 0.1)), False, "test"),
    "attrE": ((("train", 0.3),), False, "test"),
    "rrea": ((("train", 0.3),), True, "test"),
    "bert_int": ((("test", 0.7),), True, "train"),
    "sdea": ((("valid", 0.1),), True, "test"),
}


def model_split(pairs: DataFrame, model: str, seed: int = 42) -> DataFrame:
    """e1, e2, split: a model's own cut of a list of pairs, sorted or in hash order; for ``sdea`` of its test pool."""
    shares, shuffled, rest = MODEL_SPLITS[model]
    rows = pairs.select("e1", "e2").distinct().withColumn("_h", hash_key(seed, "e1", "e2") if shuffled else F.lit(""))
    ranked = global_row_number(rows, ["_h", "e1", "e2"], "_rn").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n"))))
    split, upto = None, F.lit(0)
    for name, share in shares:
        upto = upto + F.floor(F.col("_n") * F.lit(share))
        split = F.when(F.col("_rn") <= upto, name) if split is None else split.when(F.col("_rn") <= upto, name)
    return ranked.select("e1", "e2", split.otherwise(rest).alias("split"))


def pair_universe(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """e1, e2: candidate and gold pairs, each once."""
    return candidates.select("e1", "e2").unionByName(gold.select("e1", "e2")).distinct()


def stratified_sample(rows: DataFrame, targets: DataFrame, cols: list[str], seed: int = 42) -> DataFrame:
    """Rows (p and ``cols``) of each predicate up to its target (p, n, target), by hash; below it, rows repeat as evenly as
    possible and ``copy`` numbers the repeats. Ranks inside a predicate are global row numbers less those before it."""
    ranked = global_row_number(rows.withColumn("_h", hash_key(seed, "p", *cols)), ["p", "_h", *cols], "_rn")
    starts = ranked.groupBy("p").agg((F.min("_rn") - 1).alias("_start"))
    ranked = ranked.join(starts.join(targets, "p"), "p").withColumn("_rank", F.col("_rn") - F.col("_start"))
    copies = F.floor(F.col("target") / F.col("n")) + (F.col("_rank") <= F.col("target") % F.col("n")).cast("int")
    kept = ranked.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return kept.select("p", *cols, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))


def contrastive_negatives(rows: DataFrame, seed: int = 42) -> DataFrame:
    """e, p, v, kind, negative for rows e, p, v: the next value in hash order of the same predicate, of the same attribute
    type under another predicate, and of all rows. A row without such a value has no negative of that kind."""
    typed = rows.select("e", "p", "v", X.attribute_type(F.col("p"), F.col("v")).alias("type")).withColumn("_h", hash_key(seed, "e", "p", "v"))
    parts = []
    for kind, first in (("predicate", "p"), ("type", "type"), ("random", None)):
        keys = [*([first] if first else []), "_h", "e", "p", "v"]
        ranked = global_row_number(typed, keys, "_rn")
        after = ranked.select((F.col("_rn") - 1).alias("_rn"), F.col("v").alias("negative"), F.col("p").alias("_p"), F.col("type").alias("_type"))
        fits = {"predicate": F.col("p") == F.col("_p"), "type": (F.col("type") == F.col("_type")) & (F.col("p") != F.col("_p")), "random": F.lit(True)}[kind]
        found = ranked.join(after, "_rn").where(fits & (F.col("v") != F.col("negative")))
        parts.append(found.select("e", "p", "v", F.lit(kind).alias("kind"), "negative"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cached_matches(values: DataFrame, alignments: DataFrame, least: float = 0.3) -> DataFrame:
    """e1, e2, p1, p2, confidence: known predicate alignments (p1, p2, combined) that an aligned pair's values (e1, e2, p1,
    p2, o1, o2) bear out: 0.7 of the known score and 0.3 of the best trigram overlap, which must reach ``least``."""
    scored = values.select("e1", "e2", "p1", "p2", X.trigram_jaccard(F.col("o1"), F.col("o2")).alias("_v")).groupBy("e1", "e2", "p1", "p2").agg(F.max("_v").alias("_v"))
    return scored.where(F.col("_v") >= least).join(alignments, ["p1", "p2"]).select("e1", "e2", "p1", "p2", (0.7 * F.col("combined") + 0.3 * F.col("_v")).alias("confidence"))


def relation_provenance(data: Dataset) -> DataFrame:
    """node, origin, p, other, other_kind, direction of the triples around fused nodes, by the graph that they come from.

    Ends of aligned pairs are named as in the fused graph; incoming edges exist for relations only.
    """
    pairs = data.alignment.withColumn("node", X.set_uri(F.col("e1"), F.col("e2")))
    parts = []
    for kg, e, origin in ((1, "e1", "source"), (2, "e2", "target")):
        names = pairs.groupBy(F.col(e).alias("e")).agg(F.max("node").alias("node"))
        graph = data.graph(kg)
        rel = relation_triples(graph)
        out = graph.select(F.col("s").alias("e"), "p", F.col("o").alias("other"), F.col("o_kind").alias("other_kind"), F.lit("out").alias("direction"))
        back = rel.select(F.col("o").alias("e"), "p", F.col("s").alias("other"), F.lit("uri").alias("other_kind"), F.lit("in").alias("direction"))
        fused = out.unionByName(back).join(names, "e")
        others = names.select(F.col("e").alias("other"), F.col("node").alias("_other"), F.lit("uri").alias("other_kind"))
        named = fused.join(others, ["other", "other_kind"], "left").withColumn("other", F.coalesce("_other", "other"))
        parts.append(named.select("node", F.lit(origin).alias("origin"), "p", "other", "other_kind", "direction"))
    return parts[0].unionByName(parts[1]).distinct()


def url_name(uri: Column) -> Column:
    """The last part of an identifier with its marks as spaces."""
    return F.trim(F.regexp_replace(F.regexp_extract(uri, "([^#/:]*)$", 1), "[_\\-.,()]+", " "))


def name_attributes(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """kg, e, p, value, cleaned, url_name: literals under naming predicates, cleaned of marks."""
    rows = attribute_triples(triples).where(F.col("p").isin(predicates))
    return rows.select("kg", F.col("s").alias("e"), "p", F.col("o").alias("value"), X.clean_markup(F.col("o")).alias("cleaned"), url_name(F.col("s")).alias("url_name"))


def select_names(entities: DataFrame, names: DataFrame, preferred: list[str], by_url: bool = False, random_start: bool = False, seed: int = 42) -> DataFrame:
    """kg, e, name, source: a hash-chosen naming value, of a preferred predicate if there is one; without any the URL's
    name, or ``no_value`` if ``random_start``. ``by_url`` takes the URL's name wherever values exist."""
    first = F.when(F.col("p").isin(preferred), "a").otherwise("b")
    chosen = names.groupBy("kg", "e").agg(F.min(F.struct(first.alias("k"), hash_key(seed, "e", "p", "value").alias("h"), "cleaned")).alias("c"))
    rows = entities.join(chosen, ["kg", "e"], "left")
    none = F.col("c").isNull()
    name = F.when(none & F.lit(random_start), "no_value").when(none | F.lit(by_url), url_name(F.col("e"))).otherwise(F.col("c.cleaned"))
    source = F.when(none & F.lit(random_start), "random").when(none | F.lit(by_url), "url").when(F.col("c.k") == "a", "prior").otherwise("non_prior")
    return rows.select("kg", "e", name.alias("name"), source.alias("source"))


def learned_variations(values: DataFrame) -> DataFrame:
    """word, variation, n: words that stand in the same place of two values (o1, o2) of equally many words and differ, both
    ways; n counts the value pairs."""
    sides = values.select("o1", "o2").distinct().select(X.tokens(F.col("o1")).alias("x"), X.tokens(F.col("o2")).alias("y")).where("size(x) = size(y)")
    met = sides.select(F.explode(F.arrays_zip("x", "y")).alias("w")).select(F.col("w.x").alias("word"), F.col("w.y").alias("variation")).where("word <> variation")
    both = met.unionByName(met.select(F.col("variation").alias("word"), F.col("word").alias("variation")))
    return both.groupBy("word", "variation").agg(F.count(F.lit(1)).alias("n"))


def improve_until(attempt, score, baseline: float, least: float = 0.0, attempts: int = 3):
    """(result, score, tries): calls ``attempt(i)`` until its score passes the baseline by ``least``, at most ``attempts``
    times, and keeps the best; ``attempt`` makes a plan and ``score`` runs it."""
    best, top, tries = None, None, 0
    for i in range(attempts):
        result = attempt(i)
        value, tries = score(result), i + 1
        if top is None or value > top:
            best, top = result, value
        if value - baseline >= least:
            break
    return best, top, tries
