"""Queries over experiment runs derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.operators import stats as S
from twinweave.plans.registry import query

STAGES = "CASE event_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'augmented' ELSE 'synthetic_only' END"
RUNS = f"runs AS (SELECT event_type AS dataset, user_id AS experiment, {STAGES} AS stage, (event_id % 5 + 1) / CAST(10 AS DOUBLE) AS ratio, event_id % 4 / CAST(10 AS DOUBLE) AS alpha, CASE user_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model, CASE event_id % 2 WHEN 0 THEN 'hits@1' ELSE 'mr' END AS metric, value, event_id FROM events)"


def runs(spark, sf):
    e = F.col("event_id")
    stage = F.when(e % 3 == 0, "baseline").when(e % 3 == 1, "augmented").otherwise("synthetic_only")
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("experiment"), stage.alias("stage"), ((e % 5 + 1) / 10.0).alias("ratio"), (e % 4 / 10.0).alias("alpha"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("model"), F.when(e % 2 == 0, "hits@1").otherwise("mr").alias("metric"), "value", "event_id")


def r9(df):
    """Doubles rounded to nine places: sums differ by order between engines."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def q(name, sql, f=None):
    text = f"WITH {RUNS}{sql}" if sql[0] == "," else f"WITH {RUNS} {sql}"
    return query(name, text, graphs=False)(f) if f else query(name, text, graphs=False)


AGG = "count({0}) AS n, round(avg({0}), 6) AS mean, round(coalesce(stddev_pop({0}), 0), 6) AS std, round(min({0}), 6) AS min, round(max({0}), 6) AS max"
V = AGG.format("value")
q("record_summary", f"SELECT dataset, stage, metric, {V} FROM runs GROUP BY 1, 2, 3", lambda s, d: r9(S.summary(runs(s, d), "dataset", "stage", "metric")))
q("ratio_statistics", f"SELECT ratio, {V} FROM runs GROUP BY 1", lambda s, d: r9(S.summary(runs(s, d), "ratio")))
q("model_average", "SELECT dataset, experiment, stage, ratio, metric, round(avg(value), 6) AS value FROM runs GROUP BY ALL", lambda s, d: r9(S.model_average(runs(s, d))))
q("experiment_filter", "SELECT dataset, experiment, event_id FROM runs WHERE lower(dataset) IN ('click', 'view', 'purchase') AND round(ratio, 6) IN (0.2, 0.3) AND model IN ('a')", lambda s, d: S.experiment_filter(runs(s, d), ["Click", "VIEW", "purchase"], [0.2, 0.3], ["a"]).select("dataset", "experiment", "event_id"))
q("metric_sanitise", "SELECT event_id, greatest(0, least(1, CASE WHEN value > 1 THEN value / 100 ELSE value END)) AS value FROM runs", lambda s, d: runs(s, d).select("event_id", S.sanitised(F.col("value")).alias("value")))
q("experiment_name_parse", "SELECT event_id, dataset, CAST(experiment % 10 AS DOUBLE) / 10 AS reduction, CAST(event_id % 7 AS DOUBLE) / 10 AS augmentation FROM runs", lambda s, d: runs(s, d).select("event_id", S.experiment_parts(F.concat_ws("_", "dataset", F.col("experiment") % 10, F.col("event_id") % 7)).alias("p")).select("event_id", "p.dataset", "p.reduction", "p.augmentation"))
M = lambda s: f"avg(value) FILTER (stage = '{s}')"
q("dataset_summary", "SELECT dataset, metric, count(value) FILTER (stage = 'baseline') AS baseline_n, round({0}, 6) AS baseline_mean, round(stddev_pop(value) FILTER (stage = 'baseline'), 6) AS baseline_std, count(value) FILTER (stage = 'augmented') AS augmented_n, round({1}, 6) AS augmented_mean, round(stddev_pop(value) FILTER (stage = 'augmented'), 6) AS augmented_std, round({1} - {0}, 6) AS delta, round(({1} - {0}) * 100 / nullif({0}, 0), 6) AS delta_percent FROM runs GROUP BY 1, 2".format(M("baseline"), M("augmented")), lambda s, d: r9(S.dataset_summary(runs(s, d), "baseline", "augmented")))
q("ratio_summary", "SELECT ratio, metric, round({0}, 6) AS baseline_mean, round({1}, 6) AS augmented_mean, round({1} - {0}, 6) AS delta, count(DISTINCT experiment) AS experiments FROM runs GROUP BY 1, 2".format(M("baseline"), M("augmented")), lambda s, d: r9(S.ratio_summary(runs(s, d), "baseline", "augmented")))
q("comparison_table", "SELECT dataset, ratio, metric, round({0}, 6) AS base_mean, round({1}, 6) AS other_mean, CASE WHEN metric = 'mr' THEN {1} <= {0} ELSE {1} >= {0} END AS improved FROM runs GROUP BY 1, 2, 3".format(M("baseline"), M("augmented")), lambda s, d: r9(S.comparison_table(runs(s, d), "baseline", "augmented")))
q("advanced_summary", f"SELECT *, round(CASE WHEN n >= 2 THEN m - CAST(1.96 AS DOUBLE) * s / sqrt(n) END, 6) AS ci_low, round(CASE WHEN n >= 2 THEN m + CAST(1.96 AS DOUBLE) * s / sqrt(n) END, 6) AS ci_high FROM (SELECT dataset, metric, {V}, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, avg(value) AS m, stddev_pop(value) AS s FROM runs GROUP BY 1, 2)".replace("SELECT *,", "SELECT * EXCLUDE (m, s),"), lambda s, d: r9(S.advanced_summary(runs(s, d), "dataset", "metric")))
q("confidence_interval", "SELECT stage, round(avg(value) - CAST(2.576 AS DOUBLE) * stddev_pop(value) / sqrt(count(value)), 6) AS ci_low, round(avg(value) + CAST(2.576 AS DOUBLE) * stddev_pop(value) / sqrt(count(value)), 6) AS ci_high FROM runs GROUP BY 1", lambda s, d: r9(S.advanced_summary(runs(s, d), "stage", level=0.99).select("stage", "ci_low", "ci_high")))
q("cohens_d", "SELECT dataset, round((m2 - m1) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 6) AS d FROM (SELECT dataset, {0} AS m1, {1} AS m2, count(value) FILTER (stage = 'baseline') AS n1, count(value) FILTER (stage = 'augmented') AS n2, stddev_pop(value) FILTER (stage = 'baseline') AS s1, stddev_pop(value) FILTER (stage = 'augmented') AS s2 FROM runs GROUP BY 1)".format(M("baseline"), M("augmented")), lambda s, d: r9(S.cohens_d(runs(s, d), "baseline", "augmented", "dataset")))
PAIRS = "pairs AS (SELECT dataset, experiment, avg(value) FILTER (stage = 'baseline') AS a, avg(value) FILTER (stage = 'augmented') AS b FROM runs GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL)"


def pairs(s, d):
    return S.paired_means(runs(s, d), "baseline", "augmented", "event_id", "dataset", "experiment")


ERFC = "k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-x * x)"
q("paired_t_test", f", {PAIRS}, t AS (SELECT dataset, count(*) AS n, avg(b - a) / (stddev_pop(b - a) / sqrt(count(*))) AS t FROM pairs GROUP BY 1), x AS (SELECT *, abs(t) / sqrt(2) AS x, 1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(t) / sqrt(2)) AS k FROM t) SELECT dataset, n, round(t, 6) AS t, round(CASE WHEN n > 31 THEN {ERFC} WHEN abs(t) > 2 THEN 0.05 ELSE 0.10 END, 6) AS p FROM x", lambda s, d: r9(S.paired_t_test(pairs(s, d), "dataset")))
q("lear", "SELECT dataset, arg_max(alpha, l) AS best_alpha, round(max(l), 6) AS lear FROM (SELECT dataset, alpha, sum(value / ratio) / sum(1 / ratio) AS l FROM runs GROUP BY 1, 2) GROUP BY 1", lambda s, d: r9(S.lear(runs(s, d).withColumnRenamed("value", "delta"), "dataset")))
IQR = "q AS (SELECT dataset, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS c FROM runs GROUP BY 1 HAVING c >= 4), o AS (SELECT dataset, event_id, value, value < q1 - {0} * (q3 - q1) OR value > q3 + {0} * (q3 - q1) AS is_out, value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) AS extreme FROM runs JOIN q USING (dataset))"
q("outliers_iqr", f", {IQR.format('CAST(1.5 AS DOUBLE)')} SELECT dataset, event_id, value, extreme FROM o WHERE is_out", lambda s, d: S.outliers_iqr(runs(s, d), "dataset").select("dataset", "event_id", "value", "extreme"))
q("outlier_summary", f", {IQR.format('CAST(1.5 AS DOUBLE)')} SELECT dataset, {V}, round(quantile_cont(value, 0.5), 6) AS median, round(count(value) * CAST(100 AS DOUBLE) / any_value(c), 6) AS percent FROM o JOIN q USING (dataset) WHERE is_out GROUP BY 1", lambda s, d: r9(S.outlier_summary(runs(s, d), "dataset")))
q("outliers_zscore", "SELECT dataset, event_id, round(value, 6) AS value, round((value - m) / s, 6) AS z FROM runs JOIN (SELECT dataset, avg(value) AS m, stddev_pop(value) AS s FROM runs GROUP BY 1) USING (dataset) WHERE abs((value - m) / s) > 2", lambda s, d: r9(S.outliers_z(runs(s, d), "dataset", limit=2.0).select("dataset", "event_id", "value", "z")))
q("best_config", "SELECT dataset, ratio, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY dataset, ratio ORDER BY value DESC, event_id) AS r FROM runs) WHERE r = 1", lambda s, d: S.best_config(runs(s, d), "dataset", "ratio", config="event_id"))
BW = "SELECT dataset, metric, arg_max(experiment, (value, -experiment)) AS best, max(value) AS best_value, arg_min(experiment, (value, experiment)) AS worst, min(value) AS worst_value FROM runs GROUP BY 1, 2"
q("best_worst", BW, lambda s, d: S.best_and_worst(runs(s, d), "dataset", "metric"))
q("tracking_summary", f"SELECT metric, count(*) AS n, string_agg(CAST(CAST(floor(best_value * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY best_value) AS best_values FROM ({BW}) GROUP BY 1", lambda s, d: S.tracking_summary(S.best_and_worst(runs(s, d), "dataset", "metric")).withColumn("best_values", F.array_join(F.transform("best_values", lambda v: F.floor(v * 1000).cast("long").cast("string")), ",")))
q("top_n", "SELECT dataset, experiment, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, experiment) AS rank FROM runs) WHERE rank <= 5", lambda s, d: S.top_n(runs(s, d), 5, "dataset").select("dataset", "experiment", "event_id", "value", "rank"))
q("improvement_ranking", f", {PAIRS} SELECT dataset, experiment, round(b - a, 6) AS delta, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a * 100 END, 6) AS delta_percent, row_number() OVER (PARTITION BY dataset ORDER BY b - a DESC, experiment) AS rank FROM pairs", lambda s, d: r9(S.improvement_ranking(pairs(s, d))))
q("synthetic_comparison", "SELECT *, CASE WHEN gap < 5 THEN 'excellent' WHEN gap < 15 THEN 'good' ELSE 'poor' END AS quality, CASE WHEN benefit > 10 THEN 'high' WHEN benefit > 5 THEN 'moderate' WHEN benefit > 0 THEN 'low' ELSE 'none' END AS effect FROM (SELECT dataset, round({0}, 6) AS baseline, round({1}, 6) AS augmented, round({2}, 6) AS synthetic_only, round(({0} - {2}) * 100 / {0}, 6) AS gap, round(({1} - {0}) * 100 / {0}, 6) AS benefit, round({2} / {0}, 6) AS transferability, CASE WHEN {2} > {0} THEN 'artifacts' WHEN {2} >= CAST(0.95 AS DOUBLE) * {0} THEN 'transfers' ELSE 'gap' END AS transfer FROM runs GROUP BY 1)".format(M("baseline"), M("augmented"), M("synthetic_only")), lambda s, d: r9(S.synthetic_comparison(runs(s, d))))
q("heatmap_pivot", "SELECT dataset, round(avg(value) FILTER (model = 'a'), 6) AS a, round(avg(value) FILTER (model = 'b'), 6) AS b FROM runs GROUP BY 1", lambda s, d: r9(S.heatmap(runs(s, d), "dataset", "model", ["a", "b"])))
TIMES = "times AS (SELECT *, value * (CASE WHEN event_id % 50 = 0 THEN 100000 ELSE 10 END) AS seconds FROM runs)"


def times(s, d):
    return runs(s, d).withColumn("seconds", F.col("value") * F.when(F.col("event_id") % 50 == 0, 100000).otherwise(10))


q("timing_summary", f", {TIMES} SELECT stage, {AGG.format('seconds')}, round(sum(seconds), 4) AS total FROM times GROUP BY 1", lambda s, d: r9(S.timing_summary(times(s, d), "stage")).withColumn("total", F.round("total", 4)))
q("timing_repair", f", {TIMES}, m AS (SELECT dataset, stage, quantile_cont(seconds, 0.5) FILTER (seconds > 0 AND seconds < 86400) AS md, min(event_id) AS f FROM times GROUP BY 1, 2) SELECT dataset, stage, event_id, round(CASE WHEN odd AND event_id = f THEN 0 WHEN odd THEN md ELSE seconds END, 6) AS repaired FROM (SELECT times.*, md, f, seconds > 86400 OR seconds > greatest(10 * md, 3600) AS odd FROM times JOIN m USING (dataset, stage))", lambda s, d: r9(S.timing_repair(times(s, d), "dataset", "stage", order="event_id").select("dataset", "stage", "event_id", "repaired")))
q("timing_starts", "SELECT event_id, CASE WHEN zero AND b IS NOT NULL THEN b ELSE event_id * 100 END AS start_s FROM (SELECT event_id, event_id % 4 = 0 AS zero, lag(event_id * 100 + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 50 END) OVER (PARTITION BY dataset, stage ORDER BY event_id) AS b FROM runs)", lambda s, d: S.sequential_starts(runs(s, d).withColumn("start_s", F.col("event_id") * 100).withColumn("end_s", F.col("start_s") + F.when(F.col("event_id") % 4 == 0, 0).otherwise(50)), "dataset", "stage", order="event_id").select("event_id", "start_s"))
q("curriculum_phases", "SELECT event_id, CAST(p AS INTEGER) AS phase FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM runs), range(3) t(p) WHERE p = 2 OR rn <= (p + 1) * floor(n / 3)", lambda s, d: S.curriculum(runs(s, d).select("event_id", "value"), "value", "event_id", 3).select("event_id", "phase"))
