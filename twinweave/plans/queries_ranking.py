"""Queries over embeddings: the second side is a perturbed copy, e2_i = e_i + 0.9 * e_(i + 1), with gold pairs (i, i)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions import vectors as V
from twinweave.operators import quality as Q
from twinweave.operators import ranking as K
from twinweave.plans.ranks import top_by_hash
from twinweave.plans.registry import query
from twinweave.plans.storage import cut


def emb(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("embedding"), "label")
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    following = rows.select(F.col("id").alias("_next"), F.col("embedding").alias("_e"))
    two = rows.crossJoin(n).withColumn("_next", (F.col("id") + 1) % F.col("n")).join(following, "_next").select("id", F.zip_with("embedding", "_e", lambda a, b: a + b * 0.9).alias("embedding"))
    return rows.select("id", "embedding"), two


def stored(spark, sf):
    """``emb`` for queries that score it more than once: the second side is joined once and stored."""
    one, two = emb(spark, sf)
    return one, cut(two)


def gold(one):
    return one.select(F.col("id").alias("e1"), F.col("id").alias("e2"))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def ours(k=None):
    return lambda s, d: rounded(K.block_knn(*emb(s, d), k, "cosine"), "score")


E = """v1 AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), v2 AS (SELECT a.id, list_transform(range(1, 65), lambda i: a.v[i] + b.v[i] * CAST(0.9 AS DOUBLE)) AS v FROM v1 a JOIN v1 b ON b.id = (a.id + 1) % (SELECT count(*) FROM v1)),
 dots AS (SELECT a.id AS e1, b.id AS e2, list_dot_product(a.v, b.v) AS score FROM v1 a, v2 b), cosines AS (SELECT a.id AS e1, b.id AS e2, list_cosine_similarity(a.v, b.v) AS score FROM v1 a, v2 b)"""
TOP = "SELECT e1, e2, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS rank FROM {0}) WHERE rank <= {1}"
q = lambda name, sql: query(name, f"WITH {E}{sql}", graphs=False)

q("knn_cosine", " " + TOP.format("cosines", 10))(ours(10))
q("knn_bidirectional", ", back AS (SELECT e2 AS e1, e1 AS e2, score FROM cosines) SELECT 'lr' AS direction, * FROM (" + TOP.format("cosines", 5) + ") UNION ALL SELECT 'rl', * FROM (" + TOP.format("back", 5) + ")")(lambda s, d: rounded((lambda a, b: K.block_knn(a, b, 5, "cosine").withColumn("direction", F.lit("lr")).unionByName(K.block_knn(b, a, 5, "cosine").withColumn("direction", F.lit("rl"))))(*stored(s, d)), "score"))
q("knn_inner_self", ", self AS (SELECT a.id AS e1, b.id AS e2, list_dot_product(a.v, b.v) AS score FROM v1 a, v1 b) " + TOP.format("self", 5))(lambda s, d: rounded((lambda a, b: K.block_knn(a, a, 5))(*emb(s, d)), "score"))
q("knn_euclidean", ", euc AS (SELECT a.id AS e1, b.id AS e2, 1 - list_distance(a.v, b.v) AS score FROM v1 a, v2 b) " + TOP.format("euc", 5))(lambda s, d: rounded(K.block_knn(*emb(s, d), 5, "euclidean", 200), "score"))
q("knn_manhattan", ", man AS (SELECT a.id AS e1, b.id AS e2, 1 - list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))) AS score FROM v1 a, v2 b) " + TOP.format("man", 5))(lambda s, d: rounded(K.block_knn(*emb(s, d), 5, "manhattan"), "score"))
q("closest_original", " SELECT e1, e2, round(score, 6) AS score FROM (SELECT e2 AS e1, e1 AS e2, score, row_number() OVER (PARTITION BY e2 ORDER BY score DESC, e1) AS r FROM cosines) WHERE r = 1")(lambda s, d: rounded(K.block_knn(*reversed(emb(s, d)), 1, "cosine"), "score").drop("rank"))
CSLS = ", r1 AS (SELECT e1, avg(score) AS m FROM (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS r FROM cosines) WHERE r <= 10 GROUP BY e1), r2 AS (SELECT e2, avg(score) AS m FROM (SELECT *, row_number() OVER (PARTITION BY e2 ORDER BY score DESC, e1) AS r FROM cosines) WHERE r <= 10 GROUP BY e2), csls AS (SELECT e1, e2, 2 * score - r1.m - r2.m AS score FROM cosines JOIN r1 USING (e1) JOIN r2 USING (e2))"
q("csls", CSLS + " " + TOP.format("csls", 5))(lambda s, d: rounded(K.csls_knn(*emb(s, d), 5), "score"))
BEST = "SELECT {0}, {1} FROM (SELECT {0}, {1}, row_number() OVER (PARTITION BY {0} ORDER BY score DESC, {1}) AS r FROM {2}) WHERE r = 1"
q("best_alignment", " SELECT e1, e2, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS r FROM dots) WHERE r = 1")(lambda s, d: rounded(K.best_alignment(K.block_knn(*emb(s, d), 1)), "score"))
q("mutual_best", f" SELECT a.e1, a.e2 FROM ({BEST.format('e1', 'e2', 'dots')}) a JOIN ({BEST.format('e2', 'e1', 'dots')}) b ON a.e1 = b.e1 AND a.e2 = b.e2")(lambda s, d: K.block_mutual(*stored(s, d)))
q("reciprocal_pairs", f" SELECT a.e1, a.e2 FROM ({BEST.format('e1', 'e2', 'dots')}) a JOIN ({BEST.format('e1', 'e2', 'cosines')}) b ON a.e1 = b.e1 AND a.e2 = b.e2")(lambda s, d: (lambda a, b: K.reciprocal_pairs(K.block_knn(a, b, 1), K.block_knn(a, b, 1, "cosine")))(*stored(s, d)))
RANK = "rk AS (SELECT e1, CAST(count(*) FILTER (s.score > g.score OR (s.score = g.score AND s.e2 < g.e2)) AS BIGINT) + 1 AS rank FROM {0} s JOIN (SELECT e1, e2, score FROM {0} WHERE e1 = e2) g USING (e1) GROUP BY e1)"
q("gold_ranks", f", {RANK.format('cosines')} SELECT e1, e1 AS e2, rank FROM rk")(lambda s, d: (lambda a, b: K.block_gold_ranks(a, b, gold(a), "cosine"))(*emb(s, d)))
METRIC = "SELECT 'hits@1' AS metric, {0}(count(*) FILTER (rank <= 1) * CAST({1} AS DOUBLE) / count(*){2}) AS value FROM rk UNION ALL SELECT 'hits@5', {0}(count(*) FILTER (rank <= 5) * CAST({1} AS DOUBLE) / count(*){2}) FROM rk UNION ALL SELECT 'hits@10', {0}(count(*) FILTER (rank <= 10) * CAST({1} AS DOUBLE) / count(*){2}) FROM rk UNION ALL SELECT 'mr', {0}(avg(rank){2}) FROM rk UNION ALL SELECT 'mrr', {0}(avg(1.0 / rank){2}) FROM rk"
METRIC = METRIC.replace("avg(1.0 / rank)", "avg(CAST(1 AS DOUBLE) / rank)")


def _metrics(metric="cosine", **options):
    def run(s, d):
        a, b = emb(s, d)
        return K.metrics(K.block_gold_ranks(a, b, gold(a), metric), **options)

    return run


q("hits_closed", f", {RANK.format('cosines')} {METRIC.format('round', 1, ', 9')}")(_metrics(digits=9))
q("hits_percent", f", {RANK.format('dots')} {METRIC.format('round', 100, ', 5')}")(_metrics("inner", percent=True, digits=5))
q("hits_aliases", f", {RANK.format('cosines')}, m AS ({METRIC.format('round', 1, ', 9')}) SELECT * FROM m UNION ALL SELECT unnest(['precision', 'recall', 'f1']), value FROM m WHERE metric = 'hits@1'")(lambda s, d: K.with_aliases(_metrics(digits=9)(s, d)))


@q("hits_csls", f"{CSLS}, {RANK.format('csls')} {METRIC.format('round', 1, ', 9')}")
def _hits_csls(s, d):
    a, b = K.csls_bias(*emb(s, d))
    return K.metrics(K.block_gold_ranks(a, b, gold(a), "cosine", scale=2.0), digits=9)


@q("hits_candidates", ", c AS (" + TOP.format("cosines", 3) + "), rk AS (SELECT v1.id, c.rank FROM v1 LEFT JOIN c ON c.e1 = v1.id AND c.e2 = v1.id) SELECT 'hits@1' AS metric, round(count(*) FILTER (rank <= 1) / count(*), 9) AS value FROM rk UNION ALL SELECT 'hits@3', round(count(*) FILTER (rank <= 3) / count(*), 9) FROM rk UNION ALL SELECT 'mr', round(CAST(sum(rank) AS DOUBLE) / count(*), 9) FROM rk UNION ALL SELECT 'mrr', round(sum(CAST(1 AS DOUBLE) / rank) / count(*), 9) FROM rk")
def _hits_candidates(s, d):
    a, b = emb(s, d)
    return K.metrics(K.open_ranks(K.block_knn(a, b, 3, "cosine"), gold(a), 3), ks=(1, 3), found_only=False, digits=9)


@q("hits_bidirectional", ", back AS (SELECT e2 AS e1, e1 AS e2, score FROM cosines), " + RANK.format("cosines").replace("rk AS", "rk1 AS") + ", " + RANK.format("back").replace("rk AS", "rk2 AS") + ", m AS (" + " UNION ALL ".join(f"SELECT '{x}' AS direction, * FROM ({METRIC.format('', 1, '').replace('FROM rk', 'FROM ' + t)})" for x, t in (("lr", "rk1"), ("rl", "rk2"))) + ") SELECT direction, metric, round(value, 9) AS value FROM (SELECT * FROM m UNION ALL SELECT 'mean', metric, avg(value) FROM m GROUP BY metric)")
def _bidirectional(s, d):
    a, b = stored(s, d)
    sides = [K.metrics(K.block_gold_ranks(x, y, gold(a), "cosine")).withColumn("direction", F.lit(n)) for n, x, y in (("lr", a, b), ("rl", b, a))]
    both = sides[0].unionByName(sides[1])
    return both.unionByName(both.groupBy("metric").agg(F.avg("value").alias("value")).withColumn("direction", F.lit("mean"))).withColumn("value", F.round("value", 9))


CAND = "cand AS (SELECT e1, e2, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS r FROM cosines) WHERE r <= 20)"


def _cand(s, d):
    return rounded(K.block_knn(*emb(s, d), 20, "cosine"), "score").drop("rank")


q("rank_strict_greater", " SELECT g.e1, g.e2, count(*) FILTER (c.score > g.score + CAST(1e-12 AS DOUBLE)) + 1 AS rank FROM cosines c JOIN cosines g ON g.e1 = g.e2 AND c.e1 = g.e1 AND c.e2 <> g.e2 GROUP BY 1, 2")(lambda s, d: (lambda a, b: K.block_gold_ranks(a, b, gold(a), "cosine", ties="top"))(*emb(s, d)))
FILTERED = "fl AS (SELECT c.* FROM cosines c, (SELECT count(*) AS n FROM v1) t WHERE e1 = e2 OR e2 NOT IN ((e1 + 1) % n, (e1 + 3) % n)), rk AS (SELECT g.e1, g.e2, count(*) FILTER (c.e2 <> g.e2 AND (c.score > g.score OR (c.score = g.score AND c.e2 < g.e2))) + 1 AS rank FROM fl c JOIN fl g ON g.e1 = g.e2 AND c.e1 = g.e1 GROUP BY 1, 2)"


def filtered(s, d):
    """Ranks among all right rows; a row's next and its third are further true answers."""
    a, b = emb(s, d)
    n = F.broadcast(a.agg(F.count(F.lit(1)).alias("n")))
    known = a.crossJoin(n).select(F.col("id").alias("e1"), F.explode(F.array((F.col("id") + 1) % F.col("n"), (F.col("id") + 3) % F.col("n"))).alias("e2"))
    return K.filtered_block_ranks(a, b, gold(a), known)


q("filtered_ranks", f", {FILTERED} SELECT * FROM rk")(filtered)
LINK = ", ".join(f"round(CAST(count(*) FILTER (rank <= {k}) AS DOUBLE) / count(*), 9)" for k in (1, 3, 10))
q("link_prediction_metrics", f", {FILTERED} SELECT unnest(['hits@1', 'hits@3', 'hits@10', 'mr', 'mrr']) AS metric, unnest([{LINK}, round(avg(rank), 9), round(avg(CAST(1 AS DOUBLE) / rank), 9)]) AS value FROM rk")(lambda s, d: K.metrics(filtered(s, d), ks=(1, 3, 10), digits=9))
SHIFT = f"""{CAND}, cand2 AS (SELECT e1, e2, round(score * CAST(2 AS DOUBLE) + (e2 % 7) * CAST(0.01 AS DOUBLE), 6) AS score FROM cand), b AS (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS rank FROM cand), a AS (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS rank FROM cand2),
 sh AS (SELECT coalesce(b.e1, a.e1) AS e1, coalesce(b.e2, a.e2) AS e2, coalesce(b.e1, a.e1) = coalesce(b.e2, a.e2) AS is_true, b.score AS score_before, a.score AS score_after, sign(md) * ((abs(md) + 50) // 100) / CAST(10000 AS DOUBLE) AS score_change, a.rank - b.rank AS rank_change FROM (SELECT * FROM b WHERE rank <= 3 OR e1 = e2) b FULL JOIN (SELECT * FROM a WHERE rank <= 3 OR e1 = e2) a ON a.e1 = b.e1 AND a.e2 = b.e2, LATERAL (SELECT CAST(round(a.score * 1000000) AS BIGINT) - CAST(round(b.score * 1000000) AS BIGINT) AS md))"""


def _shift(s, d):
    before = cut(_cand(s, d))
    after = before.withColumn("score", F.round(F.col("score") * 2.0 + (F.col("e2") % 7) * 0.01, 6))
    return K.score_shift(before, after, gold(emb(s, d)[0]), 3)


q("score_shift", f", {SHIFT} SELECT * FROM sh")(_shift)
q("score_shift_summary", f", {SHIFT} SELECT count(*) AS pairs, round(avg(score_change), 6) AS mean_change, count(*) FILTER (score_change > 0) AS improved_score, count(*) FILTER (rank_change < 0) AS improved_rank FROM sh WHERE is_true")(lambda s, d: K.score_shift_summary(_shift(s, d)))
q("hard_negatives", f", {CAND} SELECT e1, e1 AS e2, e2 AS negative, k FROM (SELECT e1, e2, row_number() OVER (PARTITION BY e1 ORDER BY md5('42|' || e1 || '|' || e1 || '|' || e2), e2) AS k FROM cand WHERE e1 <> e2) WHERE k <= 3")(lambda s, d: K.hard_negatives(gold(emb(s, d)[0]), _cand(s, d), 3))


SIDES = "tr AS (" + TOP.format("cosines", 10) + "), tl AS (SELECT e2, e1, rank FROM (SELECT *, row_number() OVER (PARTITION BY e2 ORDER BY score DESC, e1) AS rank FROM cosines) WHERE rank <= 10), dw AS (SELECT id AS e1, id AS e2, nth, CAST('0x' || substr(md5('42|' || id || '|' || id || '|' || nth), 1, 12) AS BIGINT) AS h FROM v1, range(1, 5) t(nth))"


@q("two_sided_negatives", f", {SIDES} SELECT dw.e1, dw.e2, CAST(nth AS INTEGER) AS nth, 'right' AS side, dw.e1 AS n1, tr.e2 AS n2 FROM dw JOIN tr ON h % 2 = 0 AND tr.e1 = dw.e1 AND tr.rank = (h // 2) % 10 + 1 WHERE tr.e2 <> dw.e2 UNION ALL SELECT dw.e1, dw.e2, CAST(nth AS INTEGER), 'left', tl.e1, dw.e2 FROM dw JOIN tl ON h % 2 = 1 AND tl.e2 = dw.e2 AND tl.rank = (h // 2) % 10 + 1 WHERE tl.e1 <> dw.e1")
def _two_sided(s, d):
    a, b = stored(s, d)
    back = K.block_knn(b, a, 10, "cosine").select(F.col("e1").alias("e2"), F.col("e2").alias("e1"), "rank")
    return K.two_sided_negatives(gold(a), K.block_knn(a, b, 10, "cosine"), back, 4, 10)


@q("discovered_ranks", f", {RANK.format('cosines')} SELECT e1, e1 AS e2, CASE WHEN e1 IN (SELECT a.e1 FROM ({BEST.format('e1', 'e2', 'dots')}) a JOIN ({BEST.format('e2', 'e1', 'dots')}) b ON a.e1 = b.e1 AND a.e2 = b.e2) THEN 1 ELSE rank END AS rank FROM rk")
def _discovered(s, d):
    a, b = stored(s, d)
    return K.discovered_ranks(K.block_gold_ranks(a, b, gold(a), "cosine"), K.block_mutual(a, b))


NEAR = "(SELECT b.id, n.v FROM v1 b JOIN {0} n ON n.id IN (b.id, (b.id + 1) % (SELECT count(*) FROM v1), (b.id + 2) % (SELECT count(*) FROM v1)))"


@q("dual_aggregation", f" SELECT a.id AS e1, a.id AS e2, CAST(k AS INTEGER) AS kernel, round(sum(exp(-(c - mu) * (c - mu) / CAST(0.01 AS DOUBLE))), 6) AS sum, round(max(exp(-(c - mu) * (c - mu) / CAST(0.01 AS DOUBLE))), 6) AS max FROM (SELECT x.id, list_cosine_similarity(x.v, y.v) AS c FROM {NEAR.format('v1')} x JOIN {NEAR.format('v2')} y USING (id)) a, (SELECT k, 1 - k * CAST(2 AS DOUBLE) / 20 AS mu FROM range(21) t(k)) GROUP BY ALL")
def _dual(s, d):
    a, b = emb(s, d)
    near = a.select("id").crossJoin(F.broadcast(a.agg(F.count(F.lit(1)).alias("m"))))
    near = near.select("id", F.explode(F.array(F.col("id"), (F.col("id") + 1) % F.col("m"), (F.col("id") + 2) % F.col("m"))).alias("n"))
    around = lambda v: near.join(v.select(F.col("id").alias("n"), "embedding"), "n").select("id", "embedding")
    return rounded(K.dual_aggregation(gold(a), around(a), around(b)), "sum", "max")


UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"
q("embedding_diversity", f""", u AS (SELECT id, {UNIT} AS w FROM v2), o AS (SELECT {UNIT} AS w FROM v1)
 SELECT 'pairwise_distance' AS metric, round(avg(1 - list_dot_product(a.w, b.w)), 6) AS value FROM u a, u b WHERE a.id <> b.id UNION ALL SELECT 'distance_to_original', round(avg(m), 6) FROM (SELECT min(1 - list_dot_product(u.w, o.w)) AS m FROM u, o GROUP BY u.id)""")(lambda s, d: rounded((lambda a, b: Q.embedding_diversity(b, a))(*emb(s, d)), "value"))
q("nndr", f""", u AS (SELECT id, {UNIT} AS w FROM v2), o AS (SELECT {UNIT} AS w FROM v1),
 r AS (SELECT d / e AS r FROM (SELECT u.id, min(1 - list_dot_product(u.w, o.w)) AS d FROM u, o GROUP BY u.id) JOIN (SELECT a.id, min(1 - list_dot_product(a.w, b.w)) AS e FROM u a, u b WHERE a.id <> b.id AND 1 - list_dot_product(a.w, b.w) > 1e-9 GROUP BY a.id) USING (id)) SELECT 'nndr_mean' AS metric, round(avg(r), 6) AS value FROM r UNION ALL SELECT 'nndr_std', round(stddev_pop(r), 6) FROM r""")(lambda s, d: rounded((lambda a, b: Q.nndr(b, a))(*emb(s, d)), "value"))
q("alignment_consistency", " SELECT 'consistency_mean' AS metric, round(avg(score), 6) AS value FROM cosines WHERE e1 = e2 UNION ALL SELECT 'consistency_std', round(stddev_pop(score), 6) FROM cosines WHERE e1 = e2")(lambda s, d: rounded((lambda a, b: Q.alignment_consistency(gold(a), a, b))(*emb(s, d)), "value"))
q("alignment_preservation", ", r AS (SELECT id, row_number() OVER (ORDER BY md5('42|' || id || '|' || id), id) AS rn, count(*) OVER () AS n FROM v1) SELECT 'preservation' AS metric, round(avg(CAST(own.score > away.score AS INTEGER)), 6) AS value FROM r JOIN r t ON t.rn = r.rn % r.n + 1 JOIN cosines own ON own.e1 = r.id AND own.e2 = r.id JOIN cosines away ON away.e1 = r.id AND away.e2 = t.id")(lambda s, d: rounded((lambda a, b: Q.alignment_preservation(gold(a), a, b))(*emb(s, d)), "value"))
q("semantic_coherence", ", g AS (SELECT a.id // 5 AS e, avg(list_cosine_similarity(a.v, b.v)) AS c FROM v1 a JOIN v1 b ON a.id // 5 = b.id // 5 AND a.id <> b.id GROUP BY 1) SELECT 'coherence_mean' AS metric, round(avg(c), 6) AS value FROM g UNION ALL SELECT 'coherence_std', round(stddev_pop(c), 6) FROM g")(lambda s, d: rounded(Q.semantic_coherence(emb(s, d)[0].select(F.floor(F.col("id") / 5).alias("entity"), "embedding")), "value"))
q("style_consistency", ", w AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM v1 a JOIN v1 b ON b.id BETWEEN a.id + 1 AND a.id + 9 UNION ALL SELECT list_cosine_similarity(a.v, b.v) FROM v2 a JOIN v2 b ON b.id BETWEEN a.id + 1 AND a.id + 9), m AS (SELECT (SELECT avg(c) FROM w) AS x, (SELECT avg(score) FROM cosines) AS y) SELECT unnest(['within', 'across', 'style']) AS metric, unnest([round(x, 6), round(y, 6), round(x - y, 6)]) AS value FROM m")(lambda s, d: rounded((lambda a, b: Q.style_consistency(*[v.select(F.col("id").alias("i"), "embedding") for v in (a, b)]))(*emb(s, d)), "value"))


@query("diverse_sample", graphs=False)
def _diverse(s, d):
    return Q.diverse_sample(emb(s, d)[0], 8)


@query("iterative_alignment", graphs=False)
def _iterative(s, d):
    a, b = emb(s, d)
    return K.iterative_alignment([K.block_knn(a, b, 1), K.block_knn(a, b, 1, "cosine"), K.csls_knn(a, b, 1)], 2)


@query("self_training", graphs=False)
def _self_training(s, d):
    """From a tenth of the gold pairs, chosen by hash, to the pairs that training adds."""
    a, b = emb(s, d)
    some = gold(a).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("n")).first()[0]
    return K.self_training(a, b, top_by_hash(gold(a), some, 42, ["e1", "e2"]))
