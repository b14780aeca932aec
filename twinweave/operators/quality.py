"""Quality of synthetic entities: diversity, realism and alignment measures. Each returns one row of (metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.functions import vectors as V
from twinweave.operators.ranking import nearest_distance
from twinweave.operators.relational import attribute_triples


def long_form(row: DataFrame) -> DataFrame:
    """One row of doubles to (metric, value) rows."""
    return row.select(F.explode(F.create_map(*[x for c in row.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))


def attribute_diversity(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """unique_original, unique_synthetic, overlap, new and novelty over distinct (predicate, value)."""
    a = attribute_triples(original).select("p", "o").distinct().withColumn("a", F.lit(1))
    b = attribute_triples(synthetic).select("p", "o").distinct().withColumn("b", F.lit(1))
    new = F.count(F.when(F.col("a").isNull(), 1))
    row = a.join(b, ["p", "o"], "full").agg(F.count("a").alias("unique_original"), F.count("b").alias("unique_synthetic"), F.count(F.when((F.col("a") == 1) & (F.col("b") == 1), 1)).alias("overlap"), new.alias("new"), F.coalesce(F.try_divide(new.cast("double"), F.count("b").cast("double")), F.lit(0.0)).alias("novelty"))
    return long_form(row)


def type_token_ratio(texts: DataFrame, col: str = "text") -> DataFrame:
    words = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\s+")).alias("w")).where("w <> ''")
    return long_form(words.agg(F.coalesce(F.countDistinct("w") / F.count(F.lit(1)), F.lit(0.0)).alias("type_token_ratio")))


def bigrams(col: Column) -> Column:
    """The distinct pairs of neighbouring words of a text, which is split once."""
    words = F.array(F.array_remove(F.split(F.lower(col), r"\s+"), ""))
    pairs = F.transform(words, lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))))[0]
    return F.array_distinct(F.coalesce(pairs, F.array().cast("array<string>")))


def self_bleu(sample: DataFrame, col: str = "text") -> DataFrame:
    """Mean share of a text's distinct bigrams found in another, over ordered pairs of a stated sample.

    Counted by bigram in one pass, so no pair of texts is made and nothing is joined: each of a bigram's c texts of n bigrams
    adds (c - 1) / n. A text's first bigram counts the text.
    """
    grams = sample.select(F.inline(F.transform(F.array(bigrams(F.col(col))), lambda g: F.struct(g.alias("g"), F.size(g).alias("n")))))
    each = grams.select("n", F.posexplode("g").alias("i", "b"))
    held = each.groupBy("b").agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.col("n")).alias("r"), F.count(F.when(F.col("i") == 0, 1)).alias("t"))
    sums = held.agg(F.sum((F.col("c") - 1) * F.col("r")).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("m"))
    return long_form(sums.select(F.coalesce(F.try_divide(F.col("s"), (F.col("m") * (F.col("m") - 1)).cast("double")), F.lit(0.0)).alias("self_bleu")))


def embedding_diversity(sample: DataFrame, originals: DataFrame) -> DataFrame:
    """Mean pairwise cosine distance inside a stated sample, by the norm of its mean unit vector, and the mean distance of
    each of its rows to the nearest original."""
    unit = sample.select("id", V.normalised(V.doubles(F.col("embedding"))).alias("u"))
    sums = unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    n = F.col("n").cast("double")
    inside = sums.agg(F.sum(F.col("s") * F.col("s")).alias("q")).crossJoin(unit.agg(F.count(F.lit(1)).alias("n"))).select((1 - (F.col("q") - n) / (n * (n - 1))).alias("pairwise_distance"))
    nearest = nearest_distance(sample, originals).agg(F.avg("distance").alias("distance_to_original"))
    return long_form(inside.crossJoin(nearest))


def structural_diversity(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Population variance and mean of the literals of each entity (kg, entity), zeros included."""
    counts = attribute_triples(triples).groupBy("kg", F.col("s").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return long_form(entities.join(counts, ["kg", "entity"], "left").select(F.coalesce("n", F.lit(0)).alias("n")).agg(F.var_pop("n").alias("variance"), F.avg("n").alias("mean")))


DATE, NUMBER = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}", r"^-?[0-9]+(\.[0-9]+)?$"


def attribute_validity(triples: DataFrame) -> DataFrame:
    """date_rate, number_rate, empty_rate, repetition_rate of literals."""
    rows = attribute_triples(triples).select("kg", "s", F.lower("p").alias("p"), F.trim("o").alias("v"))
    filled = F.col("v") != ""
    date, number = filled & F.col("p").rlike("date|time"), filled & F.col("p").rlike("count|number|age|year")
    share = lambda part, whole, none: F.coalesce(F.try_divide(F.count(F.when(part, 1)).cast("double"), F.count(F.when(whole, 1)).cast("double")), F.lit(none))
    row = rows.agg(share(date & F.col("v").rlike(DATE), date, 1.0).alias("date_rate"), share(number & F.col("v").rlike(NUMBER), number, 1.0).alias("number_rate"), share(~filled, F.lit(True), 0.0).alias("empty_rate"))
    repeats = rows.groupBy("kg", "s").agg((F.count(F.lit(1)) - F.countDistinct("v")).alias("r"), F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("r") / F.sum("n"), F.lit(0.0)).alias("repetition_rate"))
    return long_form(row.crossJoin(repeats))


def is_fluent(value: Column) -> Column:
    words = F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != "")
    marks = F.length(F.regexp_replace(value, r"[A-Za-z0-9\s]", ""))
    return (F.length(value) >= 2) & value.rlike("[A-Za-z0-9]") & (marks / F.length(value) <= 0.5) & ((F.size(words) <= 1) | (F.size(F.array_distinct(words)) / F.size(words) >= 0.5))


def fluency(triples: DataFrame) -> DataFrame:
    """Share of text literals (not only digits, dots and dashes) that pass the fluency rules."""
    rows = attribute_triples(triples).where(~F.col("o").rlike(r"^[0-9.\-]*$"))
    return long_form(rows.agg(F.coalesce(F.avg(is_fluent(F.col("o")).cast("double")), F.lit(0.0)).alias("fluency")))


def length_statistics(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    stats = lambda df, name: attribute_triples(df).agg(F.avg(F.length("o")).alias(f"{name}_mean"), F.stddev_pop(F.length("o")).alias(f"{name}_std"))
    return long_form(stats(original, "original").crossJoin(stats(synthetic, "synthetic")))


def semantic_coherence(values: DataFrame) -> DataFrame:
    """Mean and deviation over entities of the mean pairwise cosine of their values (entity, embedding), two at least."""
    unit = values.select("entity", F.posexplode(V.normalised(V.doubles(F.col("embedding")))).alias("i", "x"))
    sums = unit.groupBy("entity", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    each = sums.groupBy("entity").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").cast("double").alias("n")).where("n > 1").select(((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("c"))
    return long_form(each.agg(F.avg("c").alias("coherence_mean"), F.stddev_pop("c").alias("coherence_std")))


def alignment_consistency(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Mean and deviation of the pairs' cosine."""
    from twinweave.operators.ranking import score_pairs

    return long_form(score_pairs(one, two, pairs).agg(F.avg("score").alias("consistency_mean"), F.stddev_pop("score").alias("consistency_std")))


def alignment_preservation(pairs: DataFrame, one: DataFrame, two: DataFrame, seed: int = 42) -> DataFrame:
    """Share of pairs whose partner is nearer than another target, the next one in hash order."""
    from twinweave.operators.ranking import score_pairs
    from twinweave.operators.splits import with_total
    from twinweave.plans.ranks import global_row_number, hash_key

    ring = with_total(global_row_number(pairs.withColumn("_h", hash_key(seed, "e1", "e2")), ["_h", "e1", "e2"], "_rn"))
    following = ring.select((F.col("_rn") - 1).alias("_rn"), F.col("e2").alias("other"))
    first = ring.where("_rn = 1").select(F.col("e2").alias("_first"))
    partnered = ring.join(following, "_rn", "left").crossJoin(F.broadcast(first)).select("e1", "e2", F.coalesce("other", "_first").alias("other"))
    own = score_pairs(one, two, partnered.select("e1", "e2")).withColumnRenamed("score", "own")
    other = score_pairs(one, two, partnered.select("e1", F.col("other").alias("e2"))).select("e1", F.col("score").alias("away"))
    return long_form(own.join(other, "e1").agg(F.avg((F.col("own") > F.col("away")).cast("double")).alias("preservation")))


def structural_consistency(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """jaccard of predicates, kl of their histograms, difference of attributes per entity, and their mean score."""
    def histogram(df: DataFrame, name: str) -> DataFrame:
        return attribute_triples(df).groupBy("p").agg(F.count(F.lit(1)).alias(name))

    joined = histogram(original, "a").join(histogram(synthetic, "b"), "p", "full")
    all_rows = W.partitionBy()
    smooth = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.sum(F.coalesce(F.col(c), F.lit(0))).over(all_rows) + 1e-10
    shares = joined.select("a", "b", smooth("a").alias("p1"), smooth("b").alias("q1"))
    shares = shares.select("a", "b", (F.col("p1") / F.sum("p1").over(all_rows)).alias("x"), (F.col("q1") / F.sum("q1").over(all_rows)).alias("y"))
    row = shares.agg((F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)) / F.count(F.lit(1))).alias("jaccard"), F.sum(F.col("x") * F.log(F.col("x") / F.col("y"))).alias("kl"))
    each = lambda df, name: attribute_triples(df).agg((F.count(F.lit(1)) / F.countDistinct("kg", "s")).alias(name))
    both = row.crossJoin(each(original, "_a")).crossJoin(each(synthetic, "_b")).select("jaccard", "kl", F.abs(F.col("_a") - F.col("_b")).alias("difference"))
    return long_form(both.withColumn("score", (F.col("jaccard") + 1 / (1 + F.col("kl")) + 1 / (1 + F.col("difference"))) / 3))


def predicate_pairs(triples: DataFrame) -> DataFrame:
    """p1, p2, n: entities that have both attribute predicates."""
    own = attribute_triples(triples).groupBy("kg", "s").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    twos = F.expr("flatten(transform(ps, (x, i) -> transform(slice(ps, i + 2, size(ps)), y -> named_struct('p1', x, 'p2', y))))")
    return own.select(F.explode(twos).alias("t")).groupBy("t.p1", "t.p2").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Cosine of both graphs' predicate pair counts."""
    a, b = predicate_pairs(original).withColumnRenamed("n", "a"), predicate_pairs(synthetic).withColumnRenamed("n", "b")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    sums = a.join(b, ["p1", "p2"], "full").agg(F.sum(zero("a") * zero("b")).alias("ab"), F.sum(zero("a") * zero("a")).alias("aa"), F.sum(zero("b") * zero("b")).alias("bb"))
    return long_form(sums.select(F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))), F.lit(0.0)).alias("cooccurrence")))


def style_consistency(one: DataFrame, two: DataFrame, window: int = 9) -> DataFrame:
    """Mean cosine with the next ``window`` rows inside each graph less the mean cosine across; rows have i, embedding.

    The mean over all pairs across is the product of both sides' mean unit vectors, so no pairs are listed.
    """
    def inside(df: DataFrame) -> DataFrame:
        a = df.select("i", V.doubles(F.col("embedding")).alias("u"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + window)).alias("j"))
        return a.join(df.select(F.col("i").alias("j"), V.doubles(F.col("embedding")).alias("w")), "j").select(V.cosine(F.col("u"), F.col("w")).alias("c"))

    def mean(df: DataFrame, name: str) -> DataFrame:
        unit = df.select(F.posexplode(V.normalised(V.doubles(F.col("embedding")))).alias("k", "x"))
        return unit.groupBy("k").agg(F.avg("x").alias(name))

    within = inside(one).unionByName(inside(two)).agg(F.avg("c").alias("within"))
    across = mean(one, "x").join(mean(two, "y"), "k").agg(F.sum(F.col("x") * F.col("y")).alias("across"))
    return long_form(within.crossJoin(across).withColumn("style", F.col("within") - F.col("across")))


def nndr(synthetic: DataFrame, original: DataFrame) -> DataFrame:
    """Mean and deviation of the distance to the nearest original by the least positive distance to a synthetic row."""
    to_original = nearest_distance(synthetic, original).withColumnRenamed("distance", "d")
    to_own = nearest_distance(synthetic, synthetic, others=True).withColumnRenamed("distance", "e")
    return long_form(to_original.join(to_own, "id").select((F.col("d") / F.col("e")).alias("r")).agg(F.avg("r").alias("nndr_mean"), F.stddev_pop("r").alias("nndr_std")))


def recommendations(values: DataFrame) -> DataFrame:
    """issues of a report's (metric, value) rows."""
    rules = (("novelty", F.col("value") < 0.3, "low novelty"), ("novelty", F.col("value") > 0.8, "novelty too high"), ("fluency", F.col("value") < 0.7, "low fluency"), ("empty_rate", F.col("value") > 0.1, "many empty values"), ("consistency_mean", F.col("value") < 0.4, "low consistency"))
    found = F.array(*[F.when((F.col("metric") == m) & rule, says) for m, rule, says in rules])
    return values.select("metric", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def quality_report(original: DataFrame, synthetic: DataFrame, everyone: DataFrame) -> DataFrame:
    """section, metric, value of the measures over triples."""
    parts = {"diversity": [attribute_diversity(original, synthetic), structural_diversity(synthetic, everyone)], "realism": [attribute_validity(synthetic), fluency(synthetic), length_statistics(original, synthetic)], "alignment": [structural_consistency(original, synthetic), cooccurrence(original, synthetic)]}
    rows = [df.withColumn("section", F.lit(name)) for name, frames in parts.items() for df in frames]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


def diverse_sample(rows: DataFrame, count: int, candidates: int = 1000) -> DataFrame:
    """id, step: greedy farthest-point sample by cosine distance. Each step is one pass that keeps every row's least
    distance to the chosen ones; only the chosen vector returns to the driver."""
    unit = rows.select("id", V.normalised(V.doubles(F.col("embedding"))).alias("u"))
    first = unit.orderBy("id").first()
    chosen = [] if first is None else [(first.id, first.u)]
    while 0 < len(chosen) < count:
        distances = [1 - V.dot(F.col("u"), F.array(*map(F.lit, u))) for _, u in chosen]
        least = F.least(*distances) if len(distances) > 1 else distances[0]
        far = unit.where(~F.col("id").isin([i for i, _ in chosen])).withColumn("d", least).orderBy(F.desc("d"), "id").first()
        if far is None:
            break
        chosen.append((far.id, far.u))
    return rows.sparkSession.createDataFrame([(i, n) for n, (i, _) in enumerate(chosen)], "id long, step int")


def literal_texts(triples: DataFrame, most: int = 10) -> DataFrame:
    """kg, e, text: an entity's first ``most`` literals, in order of predicate and value, as one text."""
    from twinweave.operators.profile import first_of

    rows = first_of(attribute_triples(triples).select("kg", F.col("s").alias("e"), "p", "o"), ["kg", "e"], ["p", "o"], most)
    return rows.groupBy("kg", "e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "o"))), lambda x: x["o"]), " ").alias("text"))


def hashed_words(text: Column, width: int = 64) -> Column:
    """A vector of how often the text's lower-cased words fall into each of ``width`` slots."""
    slots = F.transform(X.tokens(text), lambda w: F.crc32(w) % width)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(slots, lambda x: x == i)).cast("double"))


def attribute_lines(triples: DataFrame) -> DataFrame:
    """kg, e, attributes: ``name: value`` of an entity's predicates in order of their names, joined by semicolons; of several
    values under one name the last in order."""
    named = attribute_triples(triples).select("kg", F.col("s").alias("e"), F.regexp_extract("p", "([^/#]*)$", 1).alias("n"), "o").groupBy("kg", "e", "n").agg(F.max("o").alias("o"))
    return named.groupBy("kg", "e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "o"))), lambda x: F.concat(x["n"], F.lit(": "), x["o"])), "; ").alias("attributes"))


def sample_records(synthetic: DataFrame, original: DataFrame, alignment: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """synthetic_uri, synthetic_attributes, closest_original_uri, closest_original_attributes, aligned_counterpart_uri and
    three empty columns for an annotator, for ``count`` synthetic entities (kg, s, p, o, o_kind) by hash.

    The closest original of the same graph has the largest cosine of hashed words of the first ten literals, ties by the
    order of names; it is sought among all originals, block by block. Without literals there is none: ``N/A``.
    """
    from twinweave.operators.ranking import block_knn
    from twinweave.plans.ranks import global_row_number, top_by_hash
    from twinweave.plans.storage import cut

    chosen = cut(top_by_hash(synthetic.select("kg", F.col("s").alias("e")).distinct(), count, seed, ["kg", "e"]))
    numbered = lambda rows: cut(global_row_number(literal_texts(rows), ["kg", "e"], "id").withColumn("embedding", hashed_words(F.col("text"))))
    ours = numbered(synthetic.join(chosen.select("kg", F.col("e").alias("s")), ["kg", "s"], "left_semi"))
    theirs = numbered(original)
    found = None
    for kg in (1, 2):
        near = block_knn(ours.where(F.col("kg") == kg).select("id", "embedding"), theirs.where(F.col("kg") == kg).select("id", "embedding"), 1, "cosine")
        found = near if found is None else found.unionByName(near)
    closest = found.join(ours.select(F.col("id").alias("e1"), "kg", "e"), "e1").join(theirs.select(F.col("id").alias("e2"), F.col("e").alias("closest")), "e2").select("kg", "e", "closest")
    pairs = alignment.select(F.lit(1).alias("kg"), F.col("e1").alias("e"), F.col("e2").alias("partner")).unionByName(alignment.select(F.lit(2).alias("kg"), F.col("e2").alias("e"), F.col("e1").alias("partner")))
    pairs = pairs.groupBy("kg", "e").agg(F.min("partner").alias("partner"))
    rows = chosen.join(attribute_lines(synthetic), ["kg", "e"], "left").join(closest, ["kg", "e"], "left").join(pairs, ["kg", "e"], "left")
    rows = rows.join(attribute_lines(original).select("kg", F.col("e").alias("closest"), F.col("attributes").alias("near")), ["kg", "closest"], "left")
    or_none = lambda c: F.coalesce(c, F.lit("N/A"))
    blank = F.lit("")
    return rows.select(F.col("e").alias("synthetic_uri"), F.coalesce("attributes", blank).alias("synthetic_attributes"), or_none("closest").alias("closest_original_uri"), F.coalesce("near", blank).alias("closest_original_attributes"), or_none("partner").alias("aligned_counterpart_uri"), blank.alias("realism_score_1_5"), blank.alias("consistency_score_1_5"), blank.alias("notes"))
