"""Queries of model-side splits, samples, negatives, names, provenance and rankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.functions import vectors as V
from twinweave.operators import ranking as K
from twinweave.operators import relational as R
from twinweave.operators import selection as C
from twinweave.operators import splits as S
from twinweave.plans.kg import derived
from twinweave.plans.queries_graph import T
from twinweave.plans.queries_ranking import emb, gold, q, rounded
from twinweave.plans.queries_values import G3, JAC, r6
from twinweave.plans.registry import query


def _split_sql(model):
    shares, shuffled, rest = C.MODEL_SPLITS[model]
    cuts, upto = [], "0"
    for name, share in shares:
        upto += f" + floor(n * CAST({share} AS DOUBLE))"
        cuts.append(f"WHEN rn <= {upto} THEN '{name}'")
    order = "md5('42|' || e1 || '|' || e2), e1, e2" if shuffled else "e1, e2"
    return f"SELECT '{model}' AS model, e1, e2, CASE {' '.join(cuts)} ELSE '{rest}' END AS split FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM alignment)"


@query("model_splits", " UNION ALL ".join(map(_split_sql, C.MODEL_SPLITS)))
def _model_splits(s, d):
    parts = [C.model_split(derived(s, d).alignment, m).select(F.lit(m).alias("model"), "e1", "e2", "split") for m in C.MODEL_SPLITS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LIT = "lit AS (SELECT kg, s AS e, p, o AS v FROM triples WHERE o_kind = 'lit')"
literals = lambda s, d: T(s, d).where("o_kind = 'lit'").select("kg", F.col("s").alias("e"), "p", F.col("o").alias("v"))


@query("stratified_sample", f"WITH {LIT}, c AS (SELECT p, count(*) AS n FROM lit GROUP BY p), t AS (SELECT p, n, CAST(greatest(10, least(1000, floor(sqrt(n) * sqrt((SELECT avg(n) FROM c))))) AS BIGINT) AS target FROM c), r AS (SELECT lit.*, n, target, row_number() OVER (PARTITION BY lit.p ORDER BY md5('42|' || lit.p || '|' || e || '|' || v), e, v) AS rk FROM lit JOIN t ON lit.p = t.p), k AS (SELECT *, CAST(target // n + CASE WHEN rk <= target % n THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r) SELECT p, e, v, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM k")
def _stratified(s, d):
    rows = literals(s, d).select("p", "e", "v")
    counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return C.stratified_sample(rows, S.stratified_targets(counts, "sqrt"), ["e", "v"])


BY_TYPE = " ".join(f"WHEN regexp_matches(lower(p), '{'|'.join(words)}') THEN '{kind}'" for kind, words in X.TYPE_KEYWORDS.items())
KIND = f"CASE {BY_TYPE} WHEN regexp_matches(regexp_replace(v, '[-/:]', '', 'g'), '^[0-9]+$') THEN 'date' WHEN regexp_matches(regexp_replace(v, '[.,]', '', 'g'), '^[0-9]+$') THEN 'number' WHEN len(list_filter(regexp_split_to_array(lower(v), '\\s+'), lambda w: w <> '')) > 10 THEN 'description' ELSE 'other' END"


def _negative(kind, part, fits):
    over = f"OVER ({part} ORDER BY h, e, p, v)"
    return f"SELECT e, p, v, '{kind}' AS kind, negative FROM (SELECT *, lead(v) {over} AS negative, lead(p) {over} AS p2 FROM ty) WHERE negative <> v AND {fits}"


query("contrastive_negatives", f"WITH {LIT}, ty AS (SELECT e, p, v, {KIND} AS type, md5('42|' || e || '|' || p || '|' || v) AS h FROM lit) " + " UNION ALL ".join([_negative("predicate", "PARTITION BY p", "true"), _negative("type", "PARTITION BY type", "p2 <> p"), _negative("random", "", "true")]))(lambda s, d: C.contrastive_negatives(literals(s, d).select("e", "p", "v")))

PROV = "nm AS (SELECT 1 AS kg, e1 AS e, max('set:' || e1 || '|' || e2) AS node FROM alignment GROUP BY e1 UNION ALL SELECT 2, e2, max('set:' || e1 || '|' || e2) FROM alignment GROUP BY e2), al AS (SELECT kg, s AS e, p, o AS other, o_kind AS other_kind, 'out' AS direction FROM triples UNION ALL SELECT kg, o, p, s, 'uri', 'in' FROM triples WHERE o_kind = 'uri')"
query("relation_provenance", f"WITH {PROV} SELECT DISTINCT nm.node, CASE al.kg WHEN 1 THEN 'source' ELSE 'target' END AS origin, p, coalesce(x.node, other) AS other, other_kind, direction FROM al JOIN nm ON nm.kg = al.kg AND nm.e = al.e LEFT JOIN nm x ON x.kg = al.kg AND x.e = al.other AND al.other_kind = 'uri'")(lambda s, d: C.relation_provenance(derived(s, d)))

CH = "string_split(' ' || lower({0}) || ' ', '')"
VALS = "mv AS (SELECT e1, e2, a.p AS p1, b.p AS p2, a.o AS o1, b.o AS o2 FROM alignment JOIN triples a ON a.kg = 1 AND a.s = e1 AND a.o_kind = 'lit' JOIN attr_match m ON m.p1 = a.p JOIN triples b ON b.kg = 2 AND b.s = e2 AND b.p = m.p2 AND b.o_kind = 'lit')"
query("cached_matches", f"WITH {VALS}, ch AS (SELECT *, {CH.format('o1')} AS a, {CH.format('o2')} AS b FROM mv), gr AS (SELECT e1, e2, p1, p2, {G3.format('a')} AS a, {G3.format('b')} AS b FROM ch), sc AS (SELECT e1, e2, p1, p2, max({JAC.format('a', 'b')}) AS v FROM gr GROUP BY ALL) SELECT e1, e2, p1, p2, round(CAST(0.7 AS DOUBLE) * 1.0 + CAST(0.3 AS DOUBLE) * v, 6) AS confidence FROM sc WHERE v >= 0.3")(lambda s, d: r6(C.cached_matches(R.matched_values(derived(s, d)), derived(s, d).attr_match.withColumn("combined", F.lit(1.0)))))

URL = "trim(regexp_replace(regexp_extract({0}, '([^#/:]*)$', 1), '[_\\-.,()]+', ' ', 'g'))"
CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(o, '<[^>]*>', '', 'g'), '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g'))"
NAMED, PREFERRED = ["ont/name", "ont/segment", "voc#label", "voc#market"], ["ont/name", "voc#label"]
IN = lambda words: ", ".join(f"'{w}'" for w in words)
NAMES = f"na AS (SELECT kg, s AS e, p, o AS value, {CLEAN} AS cleaned, {URL.format('s')} AS url_name FROM triples WHERE o_kind = 'lit' AND p IN ({IN(NAMED)}))"
query("name_attributes", f"WITH {NAMES} SELECT * FROM na")(lambda s, d: C.name_attributes(T(s, d), NAMED))
query("selected_names", f"WITH {NAMES}, pk AS (SELECT *, row_number() OVER (PARTITION BY kg, e ORDER BY p NOT IN ({IN(PREFERRED)}), md5('42|' || e || '|' || p || '|' || value), cleaned) AS rn FROM na) SELECT t.kg, t.s AS e, coalesce(cleaned, {URL.format('t.s')}) AS name, CASE WHEN pk.e IS NULL THEN 'url' WHEN p IN ({IN(PREFERRED)}) THEN 'prior' ELSE 'non_prior' END AS source FROM (SELECT DISTINCT kg, s FROM triples) t LEFT JOIN pk ON pk.kg = t.kg AND pk.e = t.s AND rn = 1")(lambda s, d: C.select_names(T(s, d).select("kg", F.col("s").alias("e")).distinct(), C.name_attributes(T(s, d), NAMED), PREFERRED))

q("pair_universe", ", back AS (SELECT e1, e2, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS rank FROM cosines) SELECT e1, e2 FROM back WHERE rank <= 5 UNION SELECT id, id FROM v1")(lambda s, d: (lambda a, b: C.pair_universe(K.block_knn(a, b, 5, "cosine"), gold(a)))(*emb(s, d)))

MEANS = "lb AS (SELECT vec_id AS id, label FROM embeddings), dim AS (SELECT unnest(range(1, 65)) AS i), " + ", ".join(f"m{k} AS (SELECT label AS id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(v[i] / sqrt(list_dot_product(v, v))) AS x FROM v{k} JOIN lb USING (id), dim GROUP BY label, i) GROUP BY label)" for k in (1, 2))


def predicate_vectors(vectors, labels):
    """id, embedding: the mean unit vector of each label, which stands for a predicate."""
    unit = vectors.join(labels, "id").select("label", F.posexplode(V.normalised(F.col("embedding"))).alias("i", "x"))
    means = unit.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("embedding"))


@q("predicate_embedding_matches", f", {MEANS}, sc AS (SELECT a.id AS p1, b.id AS p2, list_cosine_similarity(a.v, b.v) AS similarity FROM m1 a, m2 b) SELECT CAST(p1 AS BIGINT) AS p1, CAST(p2 AS BIGINT) AS p2, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY similarity DESC, p2) AS a, row_number() OVER (PARTITION BY p2 ORDER BY similarity DESC, p1) AS b FROM sc) WHERE a = 1 AND b = 1")
def _embedding_matches(s, d):
    labels = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    a, b = (predicate_vectors(v, labels) for v in emb(s, d))
    best, back = K.block_knn(a, b, 1, "cosine"), K.block_knn(b, a, 1, "cosine")
    both = best.join(back.select(F.col("e2").alias("e1"), F.col("e1").alias("e2")), ["e1", "e2"], "left_semi")
    return rounded(both.select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("score").alias("similarity")), "similarity")


RK = "g1 AS (SELECT g.e1, count(*) FILTER (c.score > g.score OR c.score = g.score AND c.e2 < g.e2) + 1 AS rank FROM cosines c JOIN cosines g ON g.e1 = g.e2 AND c.e1 = g.e1 GROUP BY 1), g2 AS (SELECT g.e1, count(*) FILTER (c.score > g.score OR c.score = g.score AND c.e2 < g.e2) + 1 AS rank FROM dots c JOIN dots g ON g.e1 = g.e2 AND c.e1 = g.e1 GROUP BY 1)"
q("fused_ranks", f", {RK} SELECT e1, e1 AS e2, greatest(g1.rank, g2.rank) AS rank FROM g1 JOIN g2 USING (e1)")(lambda s, d: (lambda a, b: K.fused_ranks(K.block_gold_ranks(a, b, gold(a), "cosine"), K.block_gold_ranks(a, b, gold(a))))(*emb(s, d)))
MODELS = "SELECT '{0}' AS model, e1, e2, round(score, 6) AS score, rank FROM (SELECT e1, e2, score, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS rank FROM {1}) WHERE rank <= 3"
q("model_rankings", " " + " UNION ALL ".join(MODELS.format(m, {"cosine": "cosines", "inner": "dots"}[K.MODEL_METRICS[m][0]]) for m in K.MODEL_METRICS if not K.MODEL_METRICS[m][1]))(lambda s, d: rounded(_rankings(s, d), "score"))


def _rankings(s, d):
    from twinweave.plans.registry import RANKERS

    parts = [RANKERS.get(m)(*emb(s, d), 3).withColumn("model", F.lit(m)) for m in K.MODEL_METRICS if not K.MODEL_METRICS[m][1]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("model", "e1", "e2", "score", "rank")


WORDS_OF = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"


def _parts(s, d):
    """Names and types of neighbouring parts, as pairs of values."""
    rows = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("o1"))
    return rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("o1").alias("o2")), "p_partkey")


PARTS = "mv AS (SELECT concat_ws(' ', a.p_name, a.p_type) AS o1, concat_ws(' ', b.p_name, b.p_type) AS o2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
query("learned_variations", f"WITH {PARTS}, tk AS (SELECT {WORDS_OF.format('o1')} AS x, {WORDS_OF.format('o2')} AS y FROM (SELECT DISTINCT o1, o2 FROM mv)), wd AS (SELECT unnest(x) AS a, unnest(y) AS b FROM tk WHERE len(x) = len(y)), df AS (SELECT a AS word, b AS variation FROM wd WHERE a <> b UNION ALL SELECT b, a FROM wd WHERE a <> b) SELECT word, variation, count(*) AS n FROM df GROUP BY ALL", graphs=False)(lambda s, d: C.learned_variations(_parts(s, d)))
q("adaptive_alpha", " SELECT e1, e2, round(greatest(0.05, least(0.95, CAST(0.5 AS DOUBLE) + CAST(0.3 AS DOUBLE) * score)), 6) AS alpha FROM cosines WHERE e1 = e2")(lambda s, d: (lambda a, b: rounded(K.score_pairs(a, b, gold(a)).select("e1", "e2", X.adaptive_alpha(F.col("score")).alias("alpha")), "alpha"))(*emb(s, d)))
