"""Queries over the derived graphs: relational operators, splits and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.operators import dictionary as D
from twinweave.operators import profile as P
from twinweave.operators import relational as R
from twinweave.operators import splits as S
from twinweave.plans.kg import augmented, derived
from twinweave.plans.registry import query
from twinweave.plans.storage import new_path
from twinweave.sources.turtle import read_turtle, write_turtle

T = lambda spark, sf: derived(spark, sf).triples
ENT = "SELECT kg, s AS entity FROM triples UNION SELECT kg, o FROM triples WHERE o_kind = 'uri'"

query("kg_statistics", f"""WITH ent AS ({ENT}) SELECT t.kg, count(*) AS triples, any_value(n) AS entities, count(DISTINCT p) FILTER (o_kind = 'uri') AS relations,
 count(DISTINCT p) FILTER (o_kind = 'lit') AS attributes FROM triples t JOIN (SELECT kg, count(*) AS n FROM ent GROUP BY kg) e ON t.kg = e.kg GROUP BY t.kg""")(lambda s, d: P.kg_statistics(T(s, d)))
query("stage_summary", f"""WITH ent AS ({ENT}) SELECT t.kg, count(*) AS triples, any_value(n) AS entities, count(DISTINCT p) FILTER (o_kind = 'uri') AS relations,
 count(DISTINCT p) FILTER (o_kind = 'lit') AS attributes, (SELECT count(*) FROM alignment) AS aligned_pairs FROM triples t JOIN (SELECT kg, count(*) AS n FROM ent GROUP BY kg) e ON t.kg = e.kg GROUP BY t.kg""")(lambda s, d: P.stage_summary(derived(s, d)))
query("relation_triples", "SELECT * FROM triples WHERE o_kind = 'uri'")(lambda s, d: R.relation_triples(T(s, d)))
query("attribute_triples", "SELECT * FROM triples WHERE o_kind = 'lit'")(lambda s, d: R.attribute_triples(T(s, d)))
query("subject_set", "SELECT DISTINCT kg, s AS entity FROM triples")(lambda s, d: R.subjects(T(s, d)))
query("entity_set", ENT)(lambda s, d: R.entities(T(s, d)))
LOCAL = "replace(regexp_extract(regexp_extract(p, '([^#/]*)$', 1), '([^:]*)$', 1), '_', ' ')"
query("predicate_local_names", f"SELECT DISTINCT kg, p, {LOCAL} AS name FROM triples")(lambda s, d: T(s, d).select("kg", "p").distinct().withColumn("name", R.local_name(F.col("p"))))
query("clean_predicates", f"SELECT t.kg, t.p, coalesce(nullif(trim(label), ''), {LOCAL.replace('(p,', '(t.p,')}) AS name FROM (SELECT DISTINCT kg, p FROM triples) t LEFT JOIN attr_names a ON a.kg = t.kg AND a.p = t.p")(lambda s, d: R.clean_predicates(T(s, d), derived(s, d).attr_names))
query("predicate_tokens", "SELECT DISTINCT p, lower(replace(regexp_replace(p, '[<>]', '', 'g'), ' ', '_')) AS token FROM triples")(lambda s, d: T(s, d).select("p").distinct().withColumn("token", R.predicate_token(F.col("p"))))
query("predicate_remap", "SELECT kg, s, CASE WHEN kg = 2 THEN coalesce(p1, p) ELSE p END AS p, o, o_kind FROM triples LEFT JOIN attr_match ON kg = 2 AND p = p2")(lambda s, d: R.remap_predicates(T(s, d), derived(s, d).attr_match))
query("canonical_predicates", "WITH m AS (SELECT kg, s, CASE WHEN kg = 2 THEN coalesce(p1, p) ELSE p END AS p, o, o_kind FROM triples LEFT JOIN attr_match ON kg = 2 AND p = p2) SELECT * FROM m WHERE o_kind = 'uri' OR kg = 1 OR p IN (SELECT p FROM triples WHERE kg = 1 AND o_kind = 'lit')")(lambda s, d: R.canonical_only(T(s, d), derived(s, d).attr_match))
query("noisy_attribute_clean", "WITH n AS (SELECT kg, s, p FROM aug_triples WHERE o_kind = 'lit' GROUP BY kg, s, p HAVING count(DISTINCT o) <= 1) SELECT t.* FROM aug_triples t SEMI JOIN n USING (kg, s, p) WHERE o_kind = 'lit'")(lambda s, d: R.clean_noisy_attributes(augmented(derived(s, d)).triples, 1).select("kg", "s", "p", "o", "o_kind"))
SCRUB = """trim(translate(regexp_replace(regexp_replace(o, '"(\\^\\^|@en).*$', ''), '[.(),"]', '', 'g'), '_-/', '   '))"""
query("rare_attribute_filter", f"WITH r AS (SELECT kg, s, p, {SCRUB} AS o, o_kind FROM triples WHERE o_kind = 'lit' AND (kg, p) IN (SELECT (kg, p) FROM triples WHERE o_kind = 'lit' GROUP BY kg, p HAVING count(*) >= 10)) SELECT * FROM r WHERE NOT contains(o, 'http')")(lambda s, d: R.frequent_attributes(T(s, d)))
query("numeric_token_filter", "SELECT * FROM triples WHERE o_kind = 'lit' AND len(list_filter(regexp_split_to_array(lower(o), '\\s+'), lambda t: length(t) >= 5 AND regexp_matches(t, '[0-9]'))) = 0")(lambda s, d: R.without_long_numbers(T(s, d)))


@query("turtle_triples", "SELECT DISTINCT * FROM triples")
def _turtle(spark, sf):
    """The derived graphs, written as Turtle and read again."""
    parts = []
    for kg in (1, 2):
        path = new_path(spark, "turtle")
        write_turtle(derived(spark, sf).graph(kg), path, {"ont": "ont/", "voc": "voc#", "c": "c:"})
        parts.append(read_turtle(spark, path, kg))
    return parts[0].unionByName(parts[1])


@query("priority_attribute", "WITH pr(p, priority) AS (VALUES ('ont/balance', 1), ('ont/name', 2), ('voc#market', 1), ('voc#label', 2)) SELECT kg, s, regexp_replace(o, '\\^\\^<.*$', '') AS value FROM (SELECT *, row_number() OVER (PARTITION BY kg, s ORDER BY priority, o) AS rn FROM triples JOIN pr USING (p) WHERE o_kind = 'lit') WHERE rn = 1")
def _priority(spark, sf):
    ranks = spark.createDataFrame([("ont/balance", 1), ("ont/name", 2), ("voc#market", 1), ("voc#label", 2)], "p string, priority int")
    return R.priority_attribute(T(spark, sf), ranks)


KNOWN = "known AS (SELECT 1 AS kg, e1 AS entity FROM alignment UNION ALL SELECT 1, 'n:' || n_nationkey FROM nation WHERE n_nationkey < 12)"


@query("endpoints_known", f"WITH {KNOWN} SELECT * FROM triples WHERE o_kind = 'uri' AND (kg, s) IN (SELECT (kg, entity) FROM known) AND (kg, o) IN (SELECT (kg, entity) FROM known)")
def _endpoints(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 12").select(F.lit(1).alias("kg"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("entity"))
    return R.endpoints_known(T(spark, sf), derived(spark, sf).alignment.select(F.lit(1).alias("kg"), F.col("e1").alias("entity")).unionByName(nations))


HASHED = "SELECT e1, e2, row_number() OVER (ORDER BY md5('42|' || e1 || '|' || e2), e1, e2) AS rn, count(*) OVER () AS n FROM alignment"
KEPT = f"kept AS (SELECT e1, e2 FROM ({HASHED}) WHERE rn <= greatest(1, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT)))"
PRUNED = f"{KEPT}, gone AS (SELECT 1 AS kg, e1 AS entity FROM alignment ANTI JOIN kept USING (e1, e2) UNION ALL SELECT 2, e2 FROM alignment ANTI JOIN kept USING (e1, e2)), left_triples AS (SELECT * FROM triples WHERE (kg, s) NOT IN (SELECT (kg, entity) FROM gone) AND (o_kind = 'lit' OR (kg, o) NOT IN (SELECT (kg, entity) FROM gone)))"
query("graph_prune", f"WITH {PRUNED} SELECT * FROM left_triples")(lambda s, d: S.reduce_random_entities(derived(s, d), 0.6).triples)
query("reduce_random_entities", f"WITH {PRUNED}, rel AS (SELECT kg, s AS e FROM left_triples WHERE o_kind = 'uri' UNION SELECT kg, o FROM left_triples WHERE o_kind = 'uri'), att AS (SELECT DISTINCT kg, s AS e FROM left_triples WHERE o_kind = 'lit') SELECT e1, e2 FROM kept WHERE (1, e1) IN (SELECT (kg, e) FROM rel) AND (1, e1) IN (SELECT (kg, e) FROM att) AND (2, e2) IN (SELECT (kg, e) FROM rel) AND (2, e2) IN (SELECT (kg, e) FROM att)")(lambda s, d: S.reduce_random_entities(derived(s, d), 0.6).alignment)
query("alignment_support", "WITH rel AS (SELECT kg, s AS e FROM triples WHERE o_kind = 'uri' UNION SELECT kg, o FROM triples WHERE o_kind = 'uri'), att AS (SELECT DISTINCT kg, s AS e FROM triples WHERE o_kind = 'lit') SELECT e1, e2 FROM alignment WHERE (1, e1) IN (SELECT (kg, e) FROM rel) AND (1, e1) IN (SELECT (kg, e) FROM att) AND (2, e2) IN (SELECT (kg, e) FROM rel) AND (2, e2) IN (SELECT (kg, e) FROM att)")(lambda s, d: R.supported_pairs(derived(s, d)))
query("reduce_alignment_only", f"WITH {KEPT} SELECT * FROM kept")(lambda s, d: S.reduce_alignment_only(derived(s, d), 0.6).alignment)
POOL = f"roles AS (SELECT e1, e2, CASE WHEN rn <= CAST(floor(n * CAST(0.3 AS DOUBLE)) AS BIGINT) THEN 'pool' ELSE 'test' END AS role FROM ({HASHED}))"
query("supervision_split", f"WITH {POOL} SELECT * FROM roles")(lambda s, d: S.supervision_split(derived(s, d).alignment))
level = lambda x: f"SELECT e1, e2, CAST({x} AS DOUBLE) AS level FROM (SELECT e1, e2, row_number() OVER (ORDER BY md5('{42 + int(x * 1000)}|' || e1 || '|' || e2), e1, e2) AS rn, count(*) OVER () AS n FROM roles WHERE role = 'pool') WHERE rn <= greatest(1, CAST(floor(n * CAST({x} AS DOUBLE)) AS BIGINT))"
query("supervision_levels", f"WITH {POOL} {level(0.1)} UNION ALL {level(0.5)} UNION ALL SELECT e1, e2, CAST(1 AS DOUBLE) FROM roles WHERE role = 'pool'")(lambda s, d: S.supervision_levels(S.supervision_split(derived(s, d).alignment).where("role = 'pool'"), [0.1, 0.5, 1.0]))
query("reduce_supervision", f"WITH {POOL} SELECT e1, e2 FROM ({level(0.5)})")(lambda s, d: S.reduce_supervision(derived(s, d), 0.5).alignment)
SPLIT = "splits AS (SELECT e1, e2, CASE WHEN rn <= CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) THEN 'sup' WHEN rn <= CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) THEN 'ref' ELSE 'valid' END AS split FROM (SELECT e1, e2, row_number() OVER (ORDER BY e1, e2) AS rn, count(*) OVER () AS n FROM alignment))"
query("split_20_70_10", f"WITH {SPLIT} SELECT * FROM splits")(lambda s, d: S.split_positions(derived(s, d).alignment))
query("split_augmented_only_train", f"WITH {SPLIT} SELECT * FROM splits UNION ALL SELECT e1, e2, 'sup' FROM aug_alignment WHERE contains(e1, '_aug')")(lambda s, d: S.split_augmented_only_train(augmented(derived(s, d)).alignment))
query("split_fixed_test", f"WITH {SPLIT}, rest AS (SELECT e1, e2, row_number() OVER (ORDER BY e1, e2) AS rn, count(*) OVER () AS n FROM splits WHERE split <> 'ref') SELECT e1, e2, CASE WHEN rn <= greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) THEN 'valid' ELSE 'sup' END AS split FROM rest UNION ALL SELECT e1, e2, 'ref' FROM splits WHERE split = 'ref' UNION ALL SELECT e1, e2, 'sup' FROM aug_alignment WHERE contains(e1, '_aug')")(lambda s, d: S.split_fixed_test(augmented(derived(s, d)).alignment, S.split_positions(derived(s, d).alignment).where("split = 'ref'").select("e1", "e2")))
query("reduce_forget_labels", f"WITH {SPLIT}, tr AS (SELECT e1, e2, row_number() OVER (ORDER BY md5('42|' || e1 || '|' || e2), e1, e2) AS rn, count(*) OVER () AS n FROM splits WHERE split = 'sup') SELECT e1, e2 FROM tr WHERE rn <= greatest(1, CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT))")(lambda s, d: S.forget_labels(derived(s, d), 0.5, S.split_positions(derived(s, d).alignment)).alignment)
query("training_mode_filter", "SELECT e1, e2 FROM aug_alignment EXCEPT SELECT e1, e2 FROM alignment")(lambda s, d: S.training_mode(derived(s, d).alignment, augmented(derived(s, d)).alignment, "synthetic_only"))
query("synthetic_entities", "SELECT kg, s AS entity FROM aug_triples EXCEPT SELECT kg, s FROM triples")(lambda s, d: R.subjects(augmented(derived(s, d)).triples).subtract(R.subjects(T(s, d))))
query("pair_union", "SELECT e1, e2 FROM alignment UNION SELECT e1, e2 FROM aug_alignment")(lambda s, d: derived(s, d).alignment.unionByName(augmented(derived(s, d)).alignment).distinct())
query("split_disjointness", f"WITH {SPLIT} SELECT e1, e2 FROM splits WHERE split = 'sup' INTERSECT SELECT e1, e2 FROM splits WHERE split = 'ref'")(lambda s, d: R.disjoint_violations(*[S.split_positions(derived(s, d).alignment).where(F.col("split") == x) for x in ("sup", "ref")]))
query("pair_budget", "SELECT CAST(least(greatest(1, ceil(count(*) * CAST(0.35 AS DOUBLE))), 500) AS BIGINT) AS budget, CAST(floor(count(*) * CAST(0.35 AS DOUBLE)) AS BIGINT) AS floor_budget FROM alignment")(lambda s, d: derived(s, d).alignment.agg(F.count(F.lit(1)).alias("n")).select(S.pair_budget(F.col("n"), 0.35, 500).alias("budget"), S.pair_budget(F.col("n"), 0.35, None, "floor").alias("floor_budget")))
query("epoch_batches", "SELECT e1, e2, CAST(floor((row_number() OVER (ORDER BY e1, e2) - 1) / 64) AS BIGINT) AS batch FROM alignment")(lambda s, d: S.batches(derived(s, d).alignment, ["e1", "e2"], 64))
query("seeded_shuffle", "SELECT e1, e2, row_number() OVER (ORDER BY md5('7|' || e1 || '|' || e2), e1, e2) AS rn FROM alignment")(lambda s, d: __import__("twinweave.plans.ranks", fromlist=["x"]).global_row_number(derived(s, d).alignment.withColumn("h", __import__("twinweave.plans.ranks", fromlist=["x"]).hash_key(7, "e1", "e2")), ["h", "e1", "e2"]).drop("h"))
query("stratified_targets", "WITH c AS (SELECT p, count(*) AS n FROM triples GROUP BY p) SELECT p, n, CAST(greatest(10, least(1000, floor(sqrt(n) * sqrt((SELECT avg(n) FROM c))))) AS BIGINT) AS target FROM c")(lambda s, d: S.stratified_targets(T(s, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"))))


@query("negative_sampling", """WITH rel AS (SELECT kg, s, p, o FROM triples WHERE o_kind = 'uri'), pool AS (SELECT kg, entity, row_number() OVER (PARTITION BY kg ORDER BY entity) AS i, count(*) OVER (PARTITION BY kg) AS n FROM (SELECT kg, s AS entity FROM rel UNION SELECT kg, o FROM rel)),
 r AS (SELECT rel.*, k, CAST('0x' || substr(md5('42|' || s || '|' || p || '|' || o || '|' || k), 1, 12) AS BIGINT) AS h FROM rel, range(1, 3) t(k)),
 m AS (SELECT r.kg, CASE WHEN h % 2 = 0 THEN entity ELSE s END AS s, p, CASE WHEN h % 2 = 0 THEN o ELSE entity END AS o, k FROM r JOIN pool ON pool.kg = r.kg AND pool.i = (h // 2) % pool.n + 1)
 SELECT kg, s, p, o, CAST(k AS INTEGER) AS k FROM m ANTI JOIN rel USING (kg, s, p, o)""")
def _negatives(spark, sf):
    return S.negative_triples(T(spark, sf), 2)


query("aligned_attributes", "WITH m AS (SELECT e1, l.p AS p1, l.o AS v1, e2, r.p AS p2, r.o AS v2 FROM alignment JOIN triples l ON l.s = e1 JOIN attr_match ON l.p = p1 JOIN triples r ON r.s = e2 AND r.p = p2) SELECT e1, p1, v1, p2, v2 FROM (SELECT *, row_number() OVER (PARTITION BY e1, p1, v1 ORDER BY e2, p2, v2) AS rn FROM m) WHERE rn = 1")(lambda s, d: R.aligned_attributes(derived(s, d)))


def _renamed(spark, sf):
    data = derived(spark, sf)
    return data.with_(triples=R.remap_predicates(data.triples, data.attr_match))


query("common_predicates", "WITH l AS (SELECT s AS e1, regexp_extract(p, '([^#/]*)$', 1) AS name, max(o) AS v1 FROM triples WHERE kg = 1 AND o_kind = 'lit' GROUP BY 1, 2), r AS (SELECT s AS e2, regexp_extract(p1, '([^#/]*)$', 1) AS name, max(o) AS v2 FROM triples JOIN attr_match ON p = p2 WHERE kg = 2 GROUP BY 1, 2) SELECT e1, e2, name, v1, v2 FROM alignment JOIN l USING (e1) JOIN r USING (e2, name)")(lambda s, d: R.common_predicates(_renamed(s, d)))
SIDE = "SELECT p, o, row_number() OVER (PARTITION BY p ORDER BY md5(o), o) AS r FROM (SELECT DISTINCT p, o FROM triples WHERE o_kind = 'lit' AND kg = {0})"
query("predicate_value_pairs", f"SELECT p1, p2, v1, v2 FROM (SELECT p1, p2, a.o AS v1, b.o AS v2, row_number() OVER (PARTITION BY p1, p2 ORDER BY md5(a.o || '|' || b.o), a.o, b.o) AS r FROM attr_match JOIN ({SIDE.format(1)}) a ON a.p = p1 AND a.r <= 50 JOIN ({SIDE.format(2)}) b ON b.p = p2 AND b.r <= 50) WHERE r <= 100")(lambda s, d: R.predicate_value_pairs(T(s, d), derived(s, d).attr_match, 50, 100))
SETKG = "setkg AS (SELECT DISTINCT coalesce('set:' || a.e1 || '|' || a.e2, t.s) AS s, p, coalesce('set:' || b.e1 || '|' || b.e2, t.o) AS o, o_kind FROM triples t LEFT JOIN alignment a ON (kg = 1 AND t.s = a.e1) OR (kg = 2 AND t.s = a.e2) LEFT JOIN alignment b ON o_kind = 'uri' AND ((kg = 1 AND t.o = b.e1) OR (kg = 2 AND t.o = b.e2)))"
query("set_kg", f"WITH {SETKG} SELECT * FROM setkg")(lambda s, d: R.set_graph(derived(s, d)))
query("neighbors", "SELECT * FROM edges")(lambda s, d: R.edges(T(s, d)))
query("bridged_neighbors", "WITH f AS (SELECT 1 AS kg, e1 AS node FROM alignment), i AS (SELECT DISTINCT kg, node, other FROM edges WHERE (kg, node) IN (SELECT (kg, node) FROM f) AND (kg, other) NOT IN (SELECT (kg, node) FROM f)) SELECT DISTINCT x.kg, x.node AS a, y.node AS b FROM i x JOIN i y ON x.kg = y.kg AND x.other = y.other AND x.node < y.node")(lambda s, d: R.bridged(T(s, d), derived(s, d).alignment.select(F.lit(1).alias("kg"), F.col("e1").alias("entity"))))
query("dictionary_sorted", "SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT DISTINCT s AS entity FROM triples)")(lambda s, d: R.sorted_ids(T(s, d).select(F.col("s").alias("entity")), "entity"))
query("dictionary_front_coded", """WITH n AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT DISTINCT s AS entity FROM triples)), l AS (SELECT *, id // 64 AS block, lag(entity) OVER (PARTITION BY id // 64 ORDER BY id) AS b FROM n),
 k AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE CAST(coalesce(list_max(list_filter(range(1, least(length(entity), length(b)) + 1), lambda i: left(entity, i) = left(b, i))), 0) AS INTEGER) END AS shared FROM l) SELECT block, id, shared, substr(entity, shared + 1) AS rest FROM k""")(lambda s, d: D.front_coded(T(s, d).select(F.col("s").alias("entity")), "entity"))
FIRST = "f AS (SELECT kg, entity, row_number() OVER (PARTITION BY kg ORDER BY min(pos)) - 1 AS i FROM (SELECT kg, s AS entity, 2 * rn AS pos FROM o UNION ALL SELECT kg, o, 2 * rn + 1 FROM o WHERE o_kind = 'uri') GROUP BY kg, entity)"
FIRST = "o AS (SELECT *, row_number() OVER (PARTITION BY kg ORDER BY s, p, o) AS rn FROM triples), " + FIRST
query("dictionary_first_seen", f"WITH {FIRST} SELECT kg, entity, CASE WHEN kg = 1 THEN i ELSE i + (SELECT count(*) FROM f WHERE kg = 1) END AS id FROM f")(lambda s, d: R.first_seen_ids(T(s, d)))
INTER = f"c AS (SELECT kg, entity, row_number() OVER (PARTITION BY kg ORDER BY n DESC, entity DESC) - 1 AS r FROM (SELECT kg, s AS entity, count(*) AS n FROM triples GROUP BY 1, 2)), m AS (SELECT least(count(*) FILTER (kg = 1), count(*) FILTER (kg = 2)) AS m FROM c), ids AS (SELECT kg, entity, CASE WHEN r < m THEN 2 * r + kg - 1 ELSE m + r END AS id FROM c, m)"


def _interleaved(spark, sf):
    return R.interleaved_ids(T(spark, sf).groupBy("kg", F.col("s").alias("entity")).agg(F.count(F.lit(1)).alias("n")))


query("ids_interleaved", f"WITH {INTER} SELECT * FROM ids")(_interleaved)
query("ids_sharing", f"WITH {INTER} SELECT kg, entity, coalesce((SELECT max(l.id) FROM alignment a JOIN ids l ON l.kg = 1 AND l.entity = a.e1 WHERE ids.kg = 2 AND a.e2 = ids.entity), id) AS id FROM ids")(lambda s, d: R.shared_ids(_interleaved(s, d), derived(s, d).alignment))
VOCAB = "w AS (SELECT s AS token, 1 AS k FROM triples WHERE o_kind = 'uri' UNION SELECT o, 1 FROM triples WHERE o_kind = 'uri' UNION SELECT p, 2 FROM triples WHERE o_kind = 'uri'), vocab AS (SELECT '[UNUSED' || i || ']' AS token, i AS id FROM range(100) t(i) UNION ALL SELECT token, row_number() OVER (ORDER BY k, token) + 99 FROM w)"
query("knowformer_vocab", f"WITH {VOCAB} SELECT * FROM vocab")(lambda s, d: R.vocabulary(T(s, d)))
query("vocabulary_limits", f"WITH {VOCAB}, e AS ({ENT}) SELECT kg, max(id) + 1 AS vocabulary_size FROM vocab JOIN e ON token = entity GROUP BY kg")(lambda s, d: P.vocabulary_limits(R.vocabulary(T(s, d)), R.entities(T(s, d))))

query("alignment_structure", f"WITH {SPLIT}, s AS (SELECT * FROM splits UNION ALL SELECT e1, e2, 'ref' FROM splits WHERE split = 'sup' AND right(e1, 1) = '3'), q AS (SELECT e1, e2, max(CAST(split = 'sup' AS INT)) a, max(CAST(split = 'ref' AS INT)) b, max(CAST(split = 'valid' AS INT)) c FROM s GROUP BY 1, 2) SELECT count(*) AS pairs, CAST(sum(a) AS BIGINT) AS sup, CAST(sum(b) AS BIGINT) AS ref, CAST(sum(c) AS BIGINT) AS valid, CAST(sum(a * b) AS BIGINT) AS sup_ref, CAST(sum(a * c) AS BIGINT) AS sup_valid, CAST(sum(b * c) AS BIGINT) AS ref_valid, CAST(sum(a * b * c) AS BIGINT) AS sup_ref_valid, count(DISTINCT e1) AS left_entities, count(DISTINCT e2) AS right_entities, min(e1) AS least_left, max(e2) AS greatest_right FROM q")(lambda s, d: P.alignment_structure((lambda x: x.unionByName(x.where("split = 'sup' and right(e1, 1) = '3'").withColumn("split", F.lit("ref"))))(S.split_positions(derived(s, d).alignment))))
query("alignment_coverage", "WITH a AS (SELECT 1 AS kg, e1 AS e FROM alignment UNION SELECT 2, e2 FROM alignment), t AS (SELECT kg, s AS e FROM triples WHERE o_kind = 'uri' UNION SELECT kg, o FROM triples WHERE o_kind = 'uri') SELECT coalesce(a.kg, t.kg) AS kg, count(a.e) AS aligned, count(*) FILTER (a.e IS NOT NULL AND t.e IS NOT NULL) AS in_triples, count(*) FILTER (t.e IS NULL) AS missing, count(*) FILTER (a.e IS NULL) AS not_aligned FROM a FULL JOIN t ON a.kg = t.kg AND a.e = t.e GROUP BY 1")(lambda s, d: P.alignment_coverage(derived(s, d)))
query("attribute_coverage", "WITH a AS (SELECT DISTINCT kg, s AS e FROM triples WHERE o_kind = 'lit'), t AS (SELECT kg, s AS e FROM triples WHERE o_kind = 'uri' UNION SELECT kg, o FROM triples WHERE o_kind = 'uri') SELECT coalesce(a.kg, t.kg) AS kg, count(*) FILTER (a.e IS NULL) AS only_triples, count(*) FILTER (t.e IS NULL) AS only_attributes, count(*) FILTER (a.e IS NOT NULL AND t.e IS NOT NULL) AS both FROM a FULL JOIN t ON a.kg = t.kg AND a.e = t.e GROUP BY 1")(lambda s, d: P.attribute_coverage(T(s, d)))
query("data_density", f"WITH {SPLIT}, e AS (SELECT split, 1 AS kg, e1 AS e FROM splits UNION ALL SELECT split, 2, e2 FROM splits), c AS (SELECT kg, s AS e, count(*) FILTER (o_kind = 'lit') AS a, count(*) FILTER (o_kind = 'uri') AS r FROM triples GROUP BY 1, 2) SELECT e.kg, split, avg(coalesce(a, 0)) AS avg_attributes, avg(coalesce(r, 0)) AS avg_relations, count(*) FILTER (coalesce(a, 0) = 0) AS without_attributes FROM e LEFT JOIN c ON c.kg = e.kg AND c.e = e.e GROUP BY 1, 2")(lambda s, d: P.data_density(T(s, d), S.split_positions(derived(s, d).alignment)))
query("functionality", "WITH r AS (SELECT kg, p, s FROM triples UNION ALL SELECT kg, p || '-', o FROM triples WHERE o_kind = 'uri') SELECT kg, p, count(DISTINCT s) / count(*) AS value FROM r GROUP BY 1, 2")(lambda s, d: P.functionality(T(s, d)))
query("padded_neighbors", "SELECT kg, node, array_to_string(list_resize(list_sort(list(DISTINCT other)), 5, ''), ',') AS neighbours FROM edges GROUP BY 1, 2")(lambda s, d: P.padded_neighbours(T(s, d), 5).withColumn("neighbours", F.array_join("neighbours", ",")))
query("relation_neighbors", "SELECT kg, node, array_to_string(list_slice(list_sort(list(DISTINCT (CASE direction WHEN 'in' THEN p || '-' ELSE p END) || '>' || other)), 1, 8), ',') AS facts FROM edges GROUP BY 1, 2")(lambda s, d: P.relation_neighbours(T(s, d), 8).withColumn("facts", F.array_join(F.transform("facts", lambda f: F.concat(f["p"], F.lit(">"), f["other"])), ",")))
query("entity_values", "SELECT kg, s, array_to_string(list_resize(list_sort(list(DISTINCT o)), 2, ''), ',') AS o_values FROM triples WHERE o_kind = 'lit' GROUP BY 1, 2")(lambda s, d: P.entity_values(T(s, d), 2).withColumn("o_values", F.array_join("o_values", ",")))
query("idf_weights", "WITH c AS (SELECT kg, p, count(*) AS n FROM triples WHERE o_kind = 'lit' GROUP BY 1, 2) SELECT kg, p, n, round(ln(1 + a / n) / ln(1 + a), 9) AS weight FROM c JOIN (SELECT kg, CAST(sum(n) AS DOUBLE) AS a FROM c GROUP BY 1) USING (kg)")(lambda s, d: P.idf_weights(T(s, d)).withColumn("weight", F.round("weight", 9)))
query("literal_blocks", "SELECT kg, o AS value, count(DISTINCT s) AS n FROM triples WHERE o_kind = 'lit' GROUP BY 1, 2")(lambda s, d: P.literal_blocks(T(s, d)))
query("word_blocks", "WITH w AS (SELECT kg, s, unnest(regexp_split_to_array(lower(o), '\\s+')) AS word FROM triples WHERE o_kind = 'lit') SELECT kg, word, count(DISTINCT s) AS n FROM w WHERE word <> '' GROUP BY 1, 2")(lambda s, d: P.word_blocks(T(s, d)))
query("char_vocabulary", "WITH c AS (SELECT DISTINCT unnest(string_split(o, '')) AS ch FROM triples WHERE o_kind = 'lit') SELECT ch, row_number() OVER (ORDER BY ch) AS id FROM c WHERE ch <> ''")(lambda s, d: P.char_vocabulary(T(s, d)))
query("typed_values", "WITH t AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS type FROM (SELECT DISTINCT p FROM triples WHERE o_kind = 'lit')) SELECT kg, s, string_agg(o, ',' ORDER BY type, o) AS o_values, string_agg(CAST(type AS VARCHAR), ',' ORDER BY type, o) AS types FROM triples JOIN t USING (p) WHERE o_kind = 'lit' GROUP BY 1, 2")(lambda s, d: P.typed_values(T(s, d)).select("kg", "s", F.array_join("o_values", ",").alias("o_values"), F.array_join(F.transform("types", lambda x: x.cast("string")), ",").alias("types")))
