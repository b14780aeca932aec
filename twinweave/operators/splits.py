"""Splits, reductions and samples of an alignment. Every seeded choice is a hash rank, so reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.operators.relational import prune, supported_pairs
from twinweave.plans.kg import Dataset
from twinweave.plans.ranks import global_row_number, hash_key
from twinweave.plans.registry import REDUCERS


def _share(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(float(ratio))).cast("long")


def with_total(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))


def split_positions(pairs: DataFrame, train: float = 0.2, test_until: float = 0.9) -> DataFrame:
    """e1, e2, split: sorted pairs, the first fifth sup, up to nine tenths ref, the rest valid."""
    ranked = with_total(global_row_number(pairs.select("e1", "e2"), ["e1", "e2"], "_rn"))
    split = F.when(F.col("_rn") <= _share(F.col("_n"), train), "sup").when(F.col("_rn") <= _share(F.col("_n"), test_until), "ref").otherwise("valid")
    return ranked.select("e1", "e2", split.alias("split"))


def is_synthetic(markers: tuple[str, ...] = ("_aug",)) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.col("e1").contains(marker) | F.col("e2").contains(marker)
    return found


def split_augmented_only_train(pairs: DataFrame, markers: tuple[str, ...] = ("_aug",)) -> DataFrame:
    """Originals by position; every synthetic pair trains."""
    return split_positions(pairs.where(~is_synthetic(markers))).unionByName(pairs.where(is_synthetic(markers)).select("e1", "e2", F.lit("sup").alias("split")))


def split_fixed_test(pairs: DataFrame, test: DataFrame, markers: tuple[str, ...] = ("_aug",)) -> DataFrame:
    """The given test pairs; the first tenth of the other originals, one at least, is valid; the rest trains."""
    rest = pairs.where(~is_synthetic(markers)).select("e1", "e2").join(test, ["e1", "e2"], "left_anti")
    ranked = with_total(global_row_number(rest, ["e1", "e2"], "_rn"))
    valid = F.greatest(F.lit(1), _share(F.col("_n"), 0.1))
    parts = ranked.select("e1", "e2", F.when(F.col("_rn") <= valid, "valid").otherwise("sup").alias("split"))
    return parts.unionByName(test.select("e1", "e2", F.lit("ref").alias("split"))).unionByName(pairs.where(is_synthetic(markers)).select("e1", "e2", F.lit("sup").alias("split")))


def keep_by_hash(pairs: DataFrame, seed: int | str, count) -> DataFrame:
    """The first ``count`` (a function of the number of pairs) in hash order."""
    ranked = with_total(global_row_number(pairs.select("e1", "e2").withColumn("_h", hash_key(seed, "e1", "e2")), ["_h", "e1", "e2"], "_rn"))
    return ranked.where(F.col("_rn") <= count(F.col("_n"))).select("e1", "e2")


def ratio_count(ratio: float):
    return lambda n: F.greatest(F.lit(1), _share(n, ratio))


@REDUCERS.register("random_entities")
def reduce_random_entities(data: Dataset, ratio: float, seed: int = 42) -> Dataset:
    """Keeps a share of the pairs, prunes what the removed entities touch, then drops pairs that lost their support."""
    kept = keep_by_hash(data.alignment, seed, ratio_count(ratio))
    gone = data.alignment.join(kept, ["e1", "e2"], "left_anti")
    removed = gone.select(F.lit(1).alias("kg"), F.col("e1").alias("entity")).unionByName(gone.select(F.lit(2).alias("kg"), F.col("e2").alias("entity"))).distinct()
    left = data.with_(triples=prune(data.triples, removed), alignment=kept)
    return left.with_(alignment=supported_pairs(left))


@REDUCERS.register("alignment_only")
def reduce_alignment_only(data: Dataset, ratio: float, seed: int = 42) -> Dataset:
    return data.with_(alignment=keep_by_hash(data.alignment, seed, ratio_count(ratio)))


@REDUCERS.register("stub")
def reduce_nothing(data: Dataset, ratio: float = 1.0, seed: int = 42) -> Dataset:
    return data


def supervision_split(pairs: DataFrame, pool_ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """e1, e2, role: a hash-ranked pool, the rest test."""
    pool = keep_by_hash(pairs, seed, lambda n: _share(n, pool_ratio))
    return pool.withColumn("role", F.lit("pool")).unionByName(pairs.select("e1", "e2").join(pool, ["e1", "e2"], "left_anti").withColumn("role", F.lit("test")))


def supervision_level(pool: DataFrame, level: float, seed: int = 42) -> DataFrame:
    """A level's training pairs: all of the pool from 1 on, else its share under a seed of its own."""
    if not level > 0:
        raise ValueError("a supervision level is above 0")
    if level >= 1:
        return pool.select("e1", "e2")
    return keep_by_hash(pool, seed + int(level * 1000), ratio_count(level))


def supervision_levels(pool: DataFrame, levels: list[float], seed: int = 42) -> DataFrame:
    parts = [supervision_level(pool, x, seed).withColumn("level", F.lit(float(x))) for x in sorted(levels)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reduce_supervision(data: Dataset, ratio: float, pool_ratio: float = 0.3, seed: int = 42) -> Dataset:
    """Training pairs from the pool; the rest outside the pool is the fixed test set."""
    roles = supervision_split(data.alignment, pool_ratio, seed)
    train = supervision_level(roles.where("role = 'pool'"), ratio, seed)
    return data.with_(alignment=train, fixed_test=roles.where("role = 'test'").select("e1", "e2"))


@REDUCERS.register("forget_labels")
def forget_labels(data: Dataset, ratio: float, splits: DataFrame | None = None, seed: int = 42) -> Dataset:
    """Keeps a share of the training pairs; ref, valid and pairs of no split are the fixed test set."""
    pairs = data.alignment.select("e1", "e2")
    if splits is None:
        train = keep_by_hash(pairs, seed, lambda n: _share(n, 0.2))
    else:
        train = pairs.join(splits.where("split = 'sup'").select("e1", "e2").distinct(), ["e1", "e2"], "left_semi")
    test = pairs.join(train, ["e1", "e2"], "left_anti")
    return data.with_(alignment=keep_by_hash(train, seed, ratio_count(ratio)), fixed_test=test)


def training_mode(original: DataFrame, augmented: DataFrame, mode: str) -> DataFrame:
    """Pairs to train on: ``baseline``, ``augmented`` or ``synthetic_only``; the last falls back to all if it is empty."""
    if mode == "baseline":
        return original.select("e1", "e2")
    if mode == "synthetic_only":
        only = augmented.select("e1", "e2").subtract(original.select("e1", "e2"))
        some = only.agg(F.count(F.lit(1)).alias("_n"))
        return augmented.select("e1", "e2").distinct().join(only.withColumn("_new", F.lit(True)), ["e1", "e2"], "left").crossJoin(F.broadcast(some)).where((F.col("_n") == 0) | F.col("_new")).select("e1", "e2")
    return augmented.select("e1", "e2")


def pair_budget(n: Column, ratio: float, most: int | None = None, rounding: str = "ceil") -> Column:
    count = F.greatest(F.lit(1), F.ceil(n * F.lit(ratio))) if rounding == "ceil" else F.floor(n * F.lit(ratio))
    return (F.least(count, F.lit(most)) if most is not None else count).cast("long")


def negative_triples(triples: DataFrame, per_triple: int, seed: int = 42) -> DataFrame:
    """s, p, o, k: k-th corruption of a relation, head or tail by hash, replaced by a hash-chosen entity of its graph;
    known triples are rejected."""
    rel = triples.where("o_kind = 'uri'").select("kg", "s", "p", "o")
    pool = rel.select("kg", F.col("s").alias("entity")).unionByName(rel.select("kg", F.col("o").alias("entity"))).distinct()
    numbered = [global_row_number(pool.where(F.col("kg") == kg), ["entity"], "_i") for kg in (1, 2)]
    pool = numbered[0].unionByName(numbered[1])
    sizes = pool.groupBy("kg").agg(F.count(F.lit(1)).alias("_n"))
    rows = rel.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_triple)))).join(F.broadcast(sizes), "kg")
    digits = F.conv(F.substring(hash_key(seed, "s", "p", "o", "k"), 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("_head", digits % 2 == 0).withColumn("_i", (F.floor(digits / 2) % F.col("_n")).cast("long") + 1)
    picked = rows.join(pool, ["kg", "_i"])
    made = picked.select("kg", F.when(F.col("_head"), F.col("entity")).otherwise(F.col("s")).alias("s"), "p", F.when(F.col("_head"), F.col("o")).otherwise(F.col("entity")).alias("o"), "k")
    return made.join(rel, ["kg", "s", "p", "o"], "left_anti")


def stratified_targets(counts: DataFrame, strategy: str = "sqrt", low: int = 10, high: int = 1000) -> DataFrame:
    """p, n, target: rows to sample from each predicate."""
    average = F.broadcast(counts.agg(F.avg("n").alias("_avg")))
    rows = counts.crossJoin(average)
    raw = {"uniform": F.col("n"), "sqrt": F.sqrt("n") * F.sqrt("_avg"), "log": F.log1p("n") * F.col("_avg") / F.log1p("_avg")}[strategy]
    return rows.select("p", "n", F.greatest(F.lit(low), F.least(F.lit(high), F.floor(raw))).cast("long").alias("target"))


def batches(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Adds ``batch``: rows in key order, ``size`` to a batch."""
    return global_row_number(df, keys, "_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")
