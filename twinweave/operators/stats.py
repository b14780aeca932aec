"""Statistics of experiment runs: long tables (dataset, experiment, stage, ratio, model, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Z of the usual confidence levels.
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def sanitised(value: Column, normalised: Column | bool = True) -> Column:
    """As a double; a share above 1 is a percentage; then clamped to [0, 1]."""
    v = value.try_cast("double")
    flag = F.lit(normalised) if isinstance(normalised, bool) else normalised
    return F.when(flag, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v)))).otherwise(v)


def experiment_parts(name: Column) -> Column:
    """struct(dataset, reduction, augmentation) of ``<dataset>_<tenths>_<tenths>``; null if it isn't one."""
    part = lambda n: F.regexp_extract(name, r"^(.*)_([0-9]+)_([0-9]+)$", n)
    return F.when(part(1) != "", F.struct(part(1).alias("dataset"), (part(2).try_cast("double") / 10).alias("reduction"), (part(3).try_cast("double") / 10).alias("augmentation")))


def experiment_filter(runs: DataFrame, datasets: list[str] | None = None, ratios: list[float] | None = None, models: list[str] | None = None) -> DataFrame:
    out = runs
    if datasets is not None:
        out = out.where(F.lower("dataset").isin([d.lower() for d in datasets]))
    if ratios is not None:
        out = out.where(F.round("ratio", 6).isin([round(r, 6) for r in ratios]))
    return out if models is None else out.where(F.col("model").isin(models))


def _spread(value: str = "value") -> list[Column]:
    return [F.count(value).cast("long").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def summary(runs: DataFrame, *keys: str) -> DataFrame:
    """n, mean, population std, min and max per key."""
    return runs.groupBy(*keys).agg(*_spread())


def model_average(runs: DataFrame) -> DataFrame:
    """Mean over the models that have the metric."""
    return runs.groupBy("dataset", "experiment", "stage", "ratio", "metric").agg(F.avg("value").alias("value"))


def dataset_summary(runs: DataFrame, base: str, other: str) -> DataFrame:
    """Per dataset and metric: both stages' n, mean and std side by side, their difference, and in percent of the base."""
    stage = lambda s, f, name: f(F.when(F.col("stage") == s, F.col("value"))).alias(f"{s}_{name}")
    sides = [stage(s, f, n) for s in (base, other) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.stddev_pop, "std"))]
    out = runs.groupBy("dataset", "metric").agg(*sides).withColumn("delta", F.col(f"{other}_mean") - F.col(f"{base}_mean"))
    return out.withColumn("delta_percent", F.try_divide(F.col("delta") * 100, F.col(f"{base}_mean")))


def ratio_summary(runs: DataFrame, base: str, other: str) -> DataFrame:
    """Per ratio and metric: means of both stages, their difference and the number of experiments."""
    mean = lambda s: F.avg(F.when(F.col("stage") == s, F.col("value")))
    return runs.groupBy("ratio", "metric").agg(mean(base).alias(f"{base}_mean"), mean(other).alias(f"{other}_mean"), (mean(other) - mean(base)).alias("delta"), F.countDistinct("experiment").alias("experiments"))


def comparison_table(runs: DataFrame, base: str, other: str, lower_is_better: tuple[str, ...] = ("mr",)) -> DataFrame:
    """Per dataset, ratio and metric: both means, and whether the other stage is at least as good."""
    mean = lambda s: F.avg(F.when(F.col("stage") == s, F.col("value")))
    out = runs.groupBy("dataset", "ratio", "metric").agg(mean(base).alias("base_mean"), mean(other).alias("other_mean"))
    lower = F.col("metric").isin(list(lower_is_better))
    return out.withColumn("improved", F.when(lower, F.col("other_mean") <= F.col("base_mean")).otherwise(F.col("other_mean") >= F.col("base_mean")))


def confidence(level: float = 0.95) -> tuple[Column, Column]:
    """Bounds of a summary row's mean; null below two values."""
    half = F.lit(Z.get(level, 1.96)) * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return F.when(F.col("n") >= 2, F.col("mean") - half), F.when(F.col("n") >= 2, F.col("mean") + half)


def advanced_summary(runs: DataFrame, *keys: str, level: float = 0.95) -> DataFrame:
    """``summary`` with quartiles (linear) and a confidence interval."""
    quarter = lambda q: F.percentile("value", q)
    rows = runs.groupBy(*keys).agg(*_spread(), quarter(0.25).alias("p25"), quarter(0.5).alias("p50"), quarter(0.75).alias("p75"))
    low, high = confidence(level)
    return rows.withColumns({"ci_low": low, "ci_high": high})


def cohens_d(runs: DataFrame, base: str, other: str, *keys: str) -> DataFrame:
    """Effect size with population deviations; null with fewer than two values or no spread."""
    at = lambda s, f: f(F.when(F.col("stage") == s, F.col("value")))
    rows = runs.groupBy(*keys).agg(at(base, F.count).alias("n1"), at(other, F.count).alias("n2"), at(base, F.avg).alias("m1"), at(other, F.avg).alias("m2"), at(base, F.stddev_pop).alias("s1"), at(other, F.stddev_pop).alias("s2"))
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(F.try_divide(((n1 - 1) * F.col("s1") * F.col("s1") + (n2 - 1) * F.col("s2") * F.col("s2")), (n1 + n2 - 2).cast("double")))
    return rows.select(*keys, F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (F.col("m2") - F.col("m1")) / pooled).alias("d"))


def paired_t_test(pairs: DataFrame, *keys: str) -> DataFrame:
    """t and p of paired values (a, b); p is exact enough over 30 pairs, else a 0.05 or 0.10 band at |t| = 2.

    The normal tail is a composed expression: 0.5 * erfc by its rational approximation, right to 1.5e-7.
    """
    d = F.col("b") - F.col("a")
    rows = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_pop(d).alias("s"))
    rows = rows.withColumn("t", F.when((F.col("n") >= 2) & (F.col("s") > 0), F.col("m") / (F.col("s") / F.sqrt(F.col("n").cast("double")))))
    x = F.abs("t") / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    erfc = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-x * x)
    p = F.when(F.col("t").isNull(), F.lit(None).cast("double")).when(F.col("n") > 31, erfc).when(F.abs("t") > 2, 0.05).otherwise(0.10)
    return rows.select(*keys, "n", "t", p.alias("p"))


def lear(deltas: DataFrame, *keys: str) -> DataFrame:
    """Low-resource score: differences (ratio, alpha, delta) weighted by 1 / ratio, per alpha, and the best alpha."""
    scores = deltas.where("ratio > 0").groupBy(*keys, "alpha").agg((F.sum(F.col("delta") / F.col("ratio")) / F.sum(1 / F.col("ratio"))).alias("lear"))
    return scores.groupBy(*keys).agg(F.max_by("alpha", F.struct("lear", -F.col("alpha"))).alias("best_alpha"), F.max("lear").alias("lear"))


def outliers_iqr(runs: DataFrame, *keys: str, k: float = 1.5, extreme: float = 3.0) -> DataFrame:
    """Rows outside [q1 - k iqr, q3 + k iqr] of their group, and whether outside the wider bounds; groups of four at least."""
    quarter = runs.groupBy(*keys).agg(F.count("value").alias("_n"), F.percentile("value", 0.25).alias("_q1"), F.percentile("value", 0.75).alias("_q3")).where("_n >= 4")
    iqr = F.col("_q3") - F.col("_q1")
    outside = lambda k: (F.col("value") < F.col("_q1") - k * iqr) | (F.col("value") > F.col("_q3") + k * iqr)
    return runs.join(quarter, list(keys)).where(outside(k)).withColumn("extreme", outside(extreme)).drop("_n", "_q1", "_q3")


def outliers_z(runs: DataFrame, *keys: str, limit: float = 3.0) -> DataFrame:
    """Rows more than ``limit`` population deviations from their group's mean; groups of three at least, with spread."""
    stats = runs.groupBy(*keys).agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")).where("_n >= 3 and _s > 0")
    return runs.join(stats, list(keys)).withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s")).where(F.abs("z") > limit).drop("_n", "_m", "_s")


def outlier_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Per key: outliers, their share in percent, mean, median, std, min and max."""
    found = outliers_iqr(runs, *keys)
    total = runs.groupBy(*keys).agg(F.count("value").alias("_all"))
    return found.groupBy(*keys).agg(*_spread(), F.percentile("value", 0.5).alias("median")).join(total, list(keys)).withColumn("percent", F.col("n") * 100 / F.col("_all")).drop("_all")


def best_config(runs: DataFrame, *keys: str, config: str) -> DataFrame:
    """The configuration with the highest value per key; the first wins ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), config))
    return runs.withColumn("_r", rank).where("_r = 1").select(*keys, config, "value")


def best_and_worst(runs: DataFrame, *keys: str, maximise: bool = True) -> DataFrame:
    """Per key the experiment with the best and with the worst value."""
    high = F.max_by("experiment", F.struct("value", -F.col("experiment"))), F.max("value")
    low = F.min_by("experiment", F.struct("value", "experiment")), F.min("value")
    best, worst = (high, low) if maximise else (low, high)
    return runs.groupBy(*keys).agg(best[0].alias("best"), best[1].alias("best_value"), worst[0].alias("worst"), worst[1].alias("worst_value"))


def tracking_summary(best: DataFrame) -> DataFrame:
    """Per metric: how many bests, and the values sorted."""
    return best.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("best_value")).alias("best_values"))


def top_n(runs: DataFrame, n: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "experiment"))
    return runs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def paired_means(runs: DataFrame, base: str, other: str, order: str, *keys: str) -> DataFrame:
    """keys, a, b: means of both stages where there are both. Values are added up one by one by ``order``, as a scan of the table
    does: the same values give the same mean wherever they are stored, so ties stay ties. Running sums hold no group whole."""
    rows = runs.where(F.col("stage").isin(base, other))
    upto = W.partitionBy(*keys, "stage").orderBy(order, "value").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = lambda s, c: F.when(F.col("stage") == s, F.col(c))
    mean = lambda s: F.try_divide(F.max_by(at(s, "_sum"), at(s, "_n")), F.max(at(s, "_n")))
    rows = rows.withColumns({"_sum": F.sum("value").over(upto), "_n": F.count("value").over(upto)})
    return rows.groupBy(*keys).agg(mean(base).alias("a"), mean(other).alias("b")).where("a is not null and b is not null")


def improvement_ranking(pairs: DataFrame) -> DataFrame:
    """dataset, experiment, delta, delta_percent (0 for a base of 0) and rank by falling delta in the dataset; rows have a, b."""
    rows = pairs.withColumn("delta", F.col("b") - F.col("a")).withColumn("delta_percent", F.when(F.col("a") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.col("a") * 100))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("delta"), "experiment")).cast("long")).drop("a", "b")


def synthetic_comparison(runs: DataFrame) -> DataFrame:
    """Per dataset: means of baseline, augmented and synthetic_only, the gap and benefit in percent, their bands, the
    transferability (synthetic by baseline) and what it says."""
    mean = lambda s: F.avg(F.when(F.col("stage") == s, F.col("value")))
    rows = runs.groupBy("dataset").agg(mean("baseline").alias("baseline"), mean("augmented").alias("augmented"), mean("synthetic_only").alias("synthetic_only"))
    gap = F.try_divide((F.col("baseline") - F.col("synthetic_only")) * 100, F.col("baseline"))
    benefit = F.try_divide((F.col("augmented") - F.col("baseline")) * 100, F.col("baseline"))
    transfer = F.when(F.col("synthetic_only") > F.col("baseline"), "artifacts").when(F.col("synthetic_only") >= 0.95 * F.col("baseline"), "transfers").otherwise("gap")
    rows = rows.withColumns({"gap": gap, "benefit": benefit, "transferability": F.try_divide(F.col("synthetic_only"), F.col("baseline")), "transfer": transfer})
    return rows.withColumns({"quality": F.when(F.col("gap") < 5, "excellent").when(F.col("gap") < 15, "good").otherwise("poor"), "effect": F.when(F.col("benefit") > 10, "high").when(F.col("benefit") > 5, "moderate").when(F.col("benefit") > 0, "low").otherwise("none")})


def heatmap(runs: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Mean value by ``rows`` and the listed values of ``cols``."""
    return runs.groupBy(rows).pivot(cols, values).agg(F.avg("value"))


def timing_summary(timings: DataFrame, *keys: str) -> DataFrame:
    """``summary`` of seconds with their total."""
    return timings.groupBy(*keys).agg(*_spread("seconds"), F.sum("seconds").alias("total"))


def timing_repair(timings: DataFrame, *keys: str, order: str) -> DataFrame:
    """Replaces seconds over ten medians (and an hour) or over a day by the group's median of plausible ones; a group's
    first run is zero-filled if it is implausible."""
    day = 86_400.0
    plausible = F.when((F.col("seconds") > 0) & (F.col("seconds") < day), F.col("seconds"))
    medians = timings.groupBy(*keys).agg(F.percentile(plausible, 0.5).alias("_median"), F.min(order).alias("_first"))
    rows = timings.join(medians, list(keys))
    odd = (F.col("seconds") > day) | (F.col("seconds") > F.greatest(10 * F.col("_median"), F.lit(3600.0)))
    fixed = F.when(odd & (F.col(order) == F.col("_first")), 0.0).when(odd, F.col("_median")).otherwise(F.col("seconds"))
    return rows.withColumn("repaired", fixed).drop("_median", "_first")


def sequential_starts(timings: DataFrame, *keys: str, order: str) -> DataFrame:
    """A run without duration starts where the one before it in its group ended."""
    before = F.lag("end_s").over(W.partitionBy(*keys).orderBy(order))
    return timings.withColumn("start_s", F.when((F.col("end_s") == F.col("start_s")) & before.isNotNull(), before).otherwise(F.col("start_s")))


def curriculum(rows: DataFrame, difficulty: str, key: str, phases: int) -> DataFrame:
    """Rows of each phase: phase p keeps the easiest (p + 1) * floor(n / phases), the last all."""
    from twinweave.operators.splits import with_total
    from twinweave.plans.ranks import global_row_number

    ranked = with_total(global_row_number(rows, [difficulty, key], "_rn")).withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))))
    keep = (F.col("phase") == phases - 1) | (F.col("_rn") <= (F.col("phase") + 1) * F.floor(F.col("_n") / phases))
    return ranked.where(keep).drop("_rn", "_n")
