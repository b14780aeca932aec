"""Queries over values and structure: quality, structure, validation, predicate matching, augmentation and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions import generators as G
from twinweave.functions import text as X
from twinweave.functions import variations as V
from twinweave.operators import augment as A
from twinweave.operators import frontier as N
from twinweave.operators import longtext as L
from twinweave.operators import predicates as P
from twinweave.operators import quality as Q
from twinweave.operators import relational as R
from twinweave.operators import splits as S
from twinweave.operators import structure as M
from twinweave.operators import validate as C
from twinweave.plans.kg import augmented, derived
from twinweave.plans.queries_graph import SPLIT, T
from twinweave.plans.registry import query
from twinweave.plans.storage import cut


def r6(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def parts(s, d):
    """Original triples and those of synthetic entities."""
    everything = augmented(derived(s, d)).triples
    return T(s, d), everything.where(F.col("s").contains("_aug"))


SYN = "syn AS (SELECT * FROM aug_triples WHERE contains(s, '_aug') AND o_kind = 'lit'), lit AS (SELECT * FROM triples WHERE o_kind = 'lit')"
q = lambda name, sql, f: query(name, f"WITH {SYN}{sql}")(f)
q("attribute_diversity", ", j AS (SELECT a.p AS a, b.p AS b FROM (SELECT DISTINCT p, o FROM lit) a FULL JOIN (SELECT DISTINCT p, o FROM syn) b ON a.p = b.p AND a.o = b.o) SELECT unnest(['unique_original', 'unique_synthetic', 'overlap', 'new', 'novelty']) AS metric, unnest([CAST(count(a) AS DOUBLE), count(b), count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), count(*) FILTER (a IS NULL), count(*) FILTER (a IS NULL) / count(b)]) AS value FROM j", lambda s, d: Q.attribute_diversity(*parts(s, d)))
q("structural_diversity", ", c AS (SELECT count(l.o) AS n FROM (SELECT kg, s AS e FROM triples UNION SELECT kg, o FROM triples WHERE o_kind = 'uri') e LEFT JOIN lit l ON l.kg = e.kg AND l.s = e.e GROUP BY e.kg, e.e) SELECT unnest(['variance', 'mean']) AS metric, unnest([round(var_pop(n), 6), round(avg(n), 6)]) AS value FROM c", lambda s, d: r6(Q.structural_diversity(T(s, d), __import__("twinweave.operators.relational", fromlist=["x"]).entities(T(s, d)))))
FACTS = "v AS (SELECT kg, s, lower(p) AS p, trim(o) AS v FROM lit UNION ALL SELECT 1, 'o:' || o_orderkey, 'ont/orderdate', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 1, 'o:' || o_orderkey, 'ont/pricenumber', CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) END FROM orders)"


def with_facts(s, d):
    """The derived graphs with dates and numbers of orders, of which some hold a text where a number belongs."""
    orders = s.read.parquet(f"{d}/orders.parquet")
    number = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(F.round("o_totalprice").cast("long").cast("string"))
    facts = [orders.select(F.lit(1).alias("kg"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("lit").alias("o_kind")) for p, o in (("ont/orderDate", F.date_format("o_orderdate", "yyyy-MM-dd")), ("ont/priceNumber", number))]
    return T(s, d).unionByName(facts[0]).unionByName(facts[1])


RATE = lambda words, form: f"round(CAST(count(*) FILTER (v <> '' AND regexp_matches(p, '{words}') AND regexp_matches(v, '{form}')) AS DOUBLE) / count(*) FILTER (v <> '' AND regexp_matches(p, '{words}')), 6)"
q("attribute_validity", f", {FACTS} SELECT unnest(['date_rate', 'number_rate', 'empty_rate', 'repetition_rate']) AS metric, unnest([{RATE('date|time', Q.DATE)}, {RATE('count|number|age|year', Q.NUMBER)}, round(count(*) FILTER (v = '') / count(*), 6), (SELECT round(sum(r) / sum(n), 6) FROM (SELECT count(*) - count(DISTINCT v) AS r, count(*) AS n FROM v GROUP BY kg, s))]) AS value FROM v", lambda s, d: r6(Q.attribute_validity(with_facts(s, d))))
query("sample_records")(lambda s, d: (lambda o, y: Q.sample_records(y, o, augmented(derived(s, d)).alignment, 20))(*parts(s, d)))
q("fluency", ", f AS (SELECT o, list_filter(regexp_split_to_array(lower(o), '\\s+'), lambda w: w <> '') AS w FROM lit WHERE NOT regexp_full_match(o, '[0-9.-]*')) SELECT 'fluency' AS metric, round(avg(CAST(length(o) >= 2 AND regexp_matches(o, '[A-Za-z0-9]') AND length(regexp_replace(o, '[A-Za-z0-9\\s]', '', 'g')) / length(o) <= 0.5 AND (len(w) <= 1 OR len(list_distinct(w)) / len(w) >= 0.5) AS INTEGER)), 6) AS value FROM f", lambda s, d: r6(Q.fluency(T(s, d))))
q("length_stats", " SELECT unnest(['original_mean', 'original_std', 'synthetic_mean', 'synthetic_std']) AS metric, unnest([(SELECT round(avg(length(o)), 6) FROM lit), (SELECT round(stddev_pop(length(o)), 6) FROM lit), (SELECT round(avg(length(o)), 6) FROM syn), (SELECT round(stddev_pop(length(o)), 6) FROM syn)]) AS value", lambda s, d: r6(Q.length_statistics(*parts(s, d))))
q("structural_consistency", """, h AS (SELECT coalesce(a.p, b.p) AS p, a.n AS a, b.n AS b FROM (SELECT p, count(*) AS n FROM lit GROUP BY 1) a FULL JOIN (SELECT p, count(*) AS n FROM syn GROUP BY 1) b ON a.p = b.p), t AS (SELECT sum(coalesce(a, 0)) AS ta, sum(coalesce(b, 0)) AS tb FROM h), sm AS (SELECT a, b, coalesce(a, 0) / ta + 1e-10 AS x, coalesce(b, 0) / tb + 1e-10 AS y FROM h, t), nn AS (SELECT a, b, x / sum(x) OVER () AS x, y / sum(y) OVER () AS y FROM sm),
 m AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) AS j, sum(x * ln(x / y)) AS kl, abs((SELECT count(*) / count(DISTINCT (kg, s)) FROM lit) - (SELECT count(*) / count(DISTINCT (kg, s)) FROM syn)) AS df FROM nn) SELECT unnest(['jaccard', 'kl', 'difference', 'score']) AS metric, unnest([round(j, 6), round(kl, 6), round(df, 6), round((j + 1 / (1 + kl) + 1 / (1 + df)) / 3, 6)]) AS value FROM m""", lambda s, d: r6(Q.structural_consistency(*parts(s, d))))
q("cooccurrence", ", pa AS (SELECT a.p AS p1, b.p AS p2, count(*) AS n FROM (SELECT DISTINCT kg, s, p FROM lit) a JOIN (SELECT DISTINCT kg, s, p FROM lit) b ON a.kg = b.kg AND a.s = b.s AND a.p < b.p GROUP BY 1, 2), pb AS (SELECT a.p AS p1, b.p AS p2, count(*) AS n FROM (SELECT DISTINCT kg, s, p FROM syn) a JOIN (SELECT DISTINCT kg, s, p FROM syn) b ON a.kg = b.kg AND a.s = b.s AND a.p < b.p GROUP BY 1, 2) SELECT 'cooccurrence' AS metric, round(CAST(sum(coalesce(pa.n, 0) * coalesce(pb.n, 0)) AS DOUBLE) / (sqrt(CAST(sum(coalesce(pa.n, 0) ** 2) AS DOUBLE)) * sqrt(CAST(sum(coalesce(pb.n, 0) ** 2) AS DOUBLE))), 6) AS value FROM pa FULL JOIN pb ON pa.p1 = pb.p1 AND pa.p2 = pb.p2", lambda s, d: r6(Q.cooccurrence(*parts(s, d))))
query("quality_report")(lambda s, d: (lambda o, y: Q.quality_report(o, y, o.select("kg", F.col("s").alias("entity")).distinct()))(*parts(s, d)))
query("quality_recommendations")(lambda s, d: (lambda o, y: Q.recommendations(Q.attribute_diversity(o, y).unionByName(Q.fluency(y))))(*parts(s, d)))


def docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')"
query("type_token_ratio", f"SELECT 'type_token_ratio' AS metric, round(count(DISTINCT w) / count(*), 6) AS value FROM (SELECT unnest({WORDS}) AS w FROM documents)", graphs=False)(lambda s, d: r6(Q.type_token_ratio(docs(s, d))))
query("self_bleu", f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS b FROM g), c AS (SELECT b, count(*) AS c FROM e GROUP BY 1) SELECT 'self_bleu' AS metric, round(sum((c - 1) / n) / ((SELECT count(*) FROM g) * ((SELECT count(*) FROM g) - 1)), 6) AS value FROM e JOIN c USING (b)", graphs=False)(lambda s, d: r6(Q.self_bleu(docs(s, d))))

for name, kind in (("swapped_relation_triples", "uri"), ("swapped_attribute_triples", "lit")):
    tail = "" if kind == "lit" else " UNION SELECT 3 - t.kg, s, p, b FROM triples t JOIN l ON l.kg = t.kg AND o = a WHERE o_kind = 'uri'"
    query(name, f"WITH {SPLIT}, l AS (SELECT 1 AS kg, e1 AS a, e2 AS b FROM splits WHERE split = 'sup' UNION ALL SELECT 2, e2, e1 FROM splits WHERE split = 'sup') SELECT 3 - t.kg AS kg, b AS s, p, o FROM triples t JOIN l ON l.kg = t.kg AND s = a WHERE o_kind = '{kind}' GROUP BY ALL{tail}")(lambda s, d, kind=kind: M.swapped(derived(s, d), S.split_positions(derived(s, d).alignment).where("split = 'sup'"), kind))
MERGED = "merged AS (SELECT s, p, o FROM triples WHERE kg = 1 AND o_kind = 'uri' UNION SELECT coalesce(a.e1, s), p, coalesce(b.e1, o) FROM triples LEFT JOIN alignment a ON a.e2 = s LEFT JOIN alignment b ON b.e2 = o WHERE kg = 2 AND o_kind = 'uri')"
query("merged_train_triples", f"WITH {MERGED} SELECT * FROM merged")(lambda s, d: M.merged_triples(derived(s, d)))
EXPANDED = f"{MERGED}, {SPLIT}, eq AS (SELECT e1 AS a, e2 AS b FROM splits WHERE split <> 'sup' UNION ALL SELECT e2, e1 FROM splits WHERE split <> 'sup'), big AS (SELECT * FROM merged UNION SELECT b, p, o FROM merged JOIN eq ON s = a UNION SELECT s, p, b FROM merged JOIN eq ON o = a)"
grown = lambda s, d: M.equivalence_expansion(M.merged_triples(derived(s, d)), S.split_positions(derived(s, d).alignment).where("split <> 'sup'"))
query("equivalence_expansion", f"WITH {EXPANDED} SELECT * FROM big")(grown)
query("masked_triples", f"WITH {EXPANDED} SELECT s, p, o, unnest(['MASK_0', 'MASK_2']) AS mask FROM big")(lambda s, d: M.masked(grown(s, d)))
LINKS = "links(p1, p2, similarity) AS (VALUES ('ont/name', 'voc#label', CAST(0.9 AS DOUBLE)), ('ont/segment', 'voc#market', CAST(0.6 AS DOUBLE)))"
links = lambda s: s.createDataFrame([("ont/name", "voc#label", 0.9), ("ont/segment", "voc#market", 0.6)], "p1 string, p2 string, similarity double")
query("weighted_triples", f"WITH {LINKS}, n AS (SELECT 1 AS kg, p1 AS p, p2 AS t, similarity AS w FROM links UNION ALL SELECT 2, p2, p1, similarity FROM links) SELECT t.kg, s, coalesce(n.t, t.p) AS p, o, round(coalesce(1 - (1 - w) * CAST(0.5 AS DOUBLE) / (1 - CAST(0.6 AS DOUBLE)), 0.2), 6) AS weight FROM triples t LEFT JOIN n ON n.kg = t.kg AND n.p = t.p")(lambda s, d: r6(M.weighted_predicates(T(s, d), links(s))))
query("predicate_match_update", f"WITH {LINKS} SELECT p1, p2, round(CAST(0.7 AS DOUBLE) * similarity + CAST(0.3 AS DOUBLE) * (1 - similarity), 6) AS similarity FROM links WHERE CAST(0.7 AS DOUBLE) * similarity + CAST(0.3 AS DOUBLE) * (1 - similarity) > 0.5")(lambda s, d: r6(M.updated_matches(links(s), links(s).withColumn("similarity", 1 - F.col("similarity")))))
query("stub_self_loops", "WITH l AS (SELECT 1 AS kg, e1 AS s FROM alignment UNION SELECT 2, e2 FROM alignment UNION SELECT 1, 'c:lonely') SELECT kg, s, 'stub' AS p, s AS o FROM l WHERE (kg, s) NOT IN (SELECT (kg, node) FROM edges)")(lambda s, d: (lambda x: M.stub_loops(x.with_(alignment=x.alignment.unionByName(s.createDataFrame([("c:lonely", x.alignment.first().e2)], "e1 string, e2 string")))))(derived(s, d)))
CELLS = "cells AS (SELECT kg, node AS row, other AS col FROM edges UNION SELECT kg, node, node FROM edges), dg AS (SELECT kg, row, count(*) AS d FROM cells GROUP BY 1, 2)"
query("normalized_adjacency", f"WITH {CELLS} SELECT c.kg, c.row, c.col, round(1 / (sqrt(a.d) * sqrt(b.d)), 6) AS val FROM cells c JOIN dg a ON a.kg = c.kg AND a.row = c.row JOIN dg b ON b.kg = c.kg AND b.row = c.col")(lambda s, d: r6(M.normalised_adjacency(T(s, d))))
query("relation_edge_index", "WITH e AS (SELECT DISTINCT kg, node AS head, other AS tail, CASE direction WHEN 'in' THEN p || '-' ELSE p END AS relation FROM edges) SELECT *, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY kg, head, tail), 6) AS weight FROM e")(lambda s, d: r6(M.relation_edge_index(T(s, d))))
KERNEL = ([0.5, -0.2, 0.1, 0.3], [0.2, 0.4, -0.3, 0.1], [0.3, -0.1, 0.2, -0.4])


def hashed_vectors(rows, name, out):
    """Vectors of a name's hash: four numbers in [-0.5, 0.5)."""
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(out), i.cast("string"))), 1, 6), 16, 10).cast("double") / 2.0**24 - 0.5
    return rows.select(F.col(name).alias(out)).distinct().withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(3)), number))


def reflection_parts(s, d):
    named = lambda c: F.concat_ws(":", F.col("kg").cast("string"), c)
    rows = M.relation_edge_index(T(s, d)).select(named("head").alias("node"), named("tail").alias("other"), F.col("relation").alias("p"), "weight")
    return rows, hashed_vectors(rows, "node", "id"), hashed_vectors(rows, "p", "p")


def reflected(s, d):
    rows, vectors, relations = reflection_parts(s, d)
    made = M.reflection_layer(cut(M.relation_directions(cut(rows), relations, 4)), cut(vectors), KERNEL)
    return made.select("id", F.posexplode("embedding").alias("i", "value")).withColumn("value", F.round("value", 6))


def stacked(s, d):
    rows, vectors, relations = reflection_parts(s, d)
    return M.reflection_stack(cut(rows), cut(vectors), relations, [KERNEL, KERNEL]).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


DOT = lambda v, w: " + ".join(f"{v}[{i + 1}] * CAST({x} AS DOUBLE)" for i, x in enumerate(w))
VECTOR = lambda c: f"list_transform(range(0, 4), lambda i: CAST('0x' || substr(md5({c} || '|' || i), 1, 6) AS BIGINT) / CAST(16777216 AS DOUBLE) - 0.5)"
REFLECTED = f"""ei AS (SELECT DISTINCT kg || ':' || node AS node, kg || ':' || other AS other, CASE direction WHEN 'in' THEN p || '-' ELSE p END AS p FROM edges), ew AS (SELECT *, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY node, other) AS w, {VECTOR('p')} AS v FROM ei),
 ev AS (SELECT DISTINCT node AS id, {VECTOR('node')} AS x FROM ei), rs AS (SELECT node, other, count(*) AS n, [{', '.join(f'sum(w * v[{i}])' for i in range(1, 5))}] AS r FROM ew GROUP BY 1, 2), rn AS (SELECT node, other, n, list_transform(r, lambda z: z / sqrt(list_dot_product(r, r))) AS r FROM rs),
 yy AS (SELECT rn.node, n, r, a.x AS own, list_transform(range(1, 5), lambda i: b.x[i] - 2 * list_dot_product(b.x, r) * r[i]) AS y FROM rn JOIN ev a ON a.id = rn.node JOIN ev b ON b.id = rn.other),
 sc AS (SELECT node, n, y, {DOT('own', KERNEL[0])} + {DOT('y', KERNEL[1])} + {DOT('r', KERNEL[2])} AS s FROM yy), ex AS (SELECT node, y, n * exp(s - (SELECT max(s) FROM sc)) AS e FROM sc)"""
query("reflection_layer", f"WITH {REFLECTED} SELECT node AS id, CAST(i - 1 AS INTEGER) AS i, round(sum(e * y[i]) / (sum(e) + CAST(1e-16 AS DOUBLE)), 6) AS value FROM ex, range(1, 5) t(i) GROUP BY node, i")(reflected)
query("reflection_stack")(stacked)
query("relation_in_out_features", "SELECT kg, node AS entity, p, direction, count(*) AS n FROM edges GROUP BY ALL")(lambda s, d: M.relation_features(T(s, d)))

SHAPES = [C.Constraint("voc#market", "minCount", 1), C.Constraint("ont/segment", "minLength", 9), C.Constraint("ont/name", "maxLength", 17, "Warning"), C.Constraint("ont/balance", "datatype", "^[0-9]+$"), C.Constraint("ont/name", "or", ["voc#label"])]
BROKEN = """viol AS (SELECT f.kg AS graph, f.s AS focus, 'voc#market' AS path, CAST(NULL AS VARCHAR) AS value, 'minCount' AS "constraint", 'Violation' AS severity FROM (SELECT DISTINCT kg, s FROM triples) f WHERE (kg, s) NOT IN (SELECT (kg, s) FROM triples WHERE p = 'voc#market')
 UNION ALL SELECT kg, s, p, o, 'minLength', 'Violation' FROM triples WHERE p = 'ont/segment' AND length(o) < 9 UNION ALL SELECT kg, s, p, o, 'maxLength', 'Warning' FROM triples WHERE p = 'ont/name' AND length(o) > 17
 UNION ALL SELECT kg, s, p, o, 'datatype', 'Violation' FROM triples WHERE p = 'ont/balance' AND NOT regexp_full_match(o, '[0-9]+') UNION ALL SELECT kg, s, 'ont/name', NULL, 'or', 'Violation' FROM (SELECT DISTINCT kg, s FROM triples) f WHERE (kg, s) NOT IN (SELECT (kg, s) FROM triples WHERE p IN ('ont/name', 'voc#label')))"""
query("shacl_violations", f"WITH {BROKEN} SELECT * FROM viol")(lambda s, d: C.violations(T(s, d), SHAPES))
query("shacl_summary", f"WITH {BROKEN} SELECT graph, severity, count(*) AS n FROM viol GROUP BY 1, 2")(lambda s, d: C.summary(C.violations(T(s, d), SHAPES)))
query("shacl_conformance", f"WITH {BROKEN} SELECT t.graph, coalesce(n, 0) AS n, n IS NULL AS conforms FROM (SELECT DISTINCT kg AS graph FROM triples) t LEFT JOIN (SELECT graph, count(*) AS n FROM viol WHERE severity = 'Warning' GROUP BY 1) USING (graph)")(lambda s, d: C.conformance(T(s, d), C.violations(T(s, d), SHAPES).where("severity = 'Warning'")))
query("shacl_remove", f"WITH {BROKEN} SELECT t.* FROM triples t WHERE NOT EXISTS (SELECT 1 FROM viol WHERE graph = kg AND focus = s AND path = p AND value = o)")(lambda s, d: C.apply_strategy(derived(s, d), SHAPES, "remove")[0].triples)
query("shacl_fix", f"WITH {BROKEN} SELECT t.* FROM triples t WHERE NOT EXISTS (SELECT 1 FROM viol WHERE graph = kg AND focus = s AND path = p AND value = o AND \"constraint\" = 'minLength')")(lambda s, d: C.apply_strategy(derived(s, d), SHAPES, "fix")[0].triples)

EXPAND = "lower(trim(regexp_replace(regexp_replace(regexp_extract(p, '([^#/:]*)$', 1), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g')))"
PREDS = f"pr AS (SELECT DISTINCT kg, p, {EXPAND} AS name FROM triples WHERE o_kind = 'lit'), sim AS (SELECT a.p AS p1, b.p AS p2, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS similarity FROM pr a JOIN pr b ON a.kg = 1 AND b.kg = 2)"
names = lambda s, d, t=0.0: P.name_similarity(P.predicate_table(T(s, d), 1), P.predicate_table(T(s, d), 2), t)
query("predicate_name_similarity", f"WITH {PREDS} SELECT p1, p2, round(similarity, 6) AS similarity FROM sim WHERE similarity > 0")(lambda s, d: r6(names(s, d)))
query("predicate_threshold_matches", f"WITH {PREDS} SELECT p1, p2, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.2")(lambda s, d: r6(P.threshold_matches(names(s, d, 0.2), 0.2)))
query("predicate_mutual_matches", f"WITH {PREDS} SELECT p1, p2, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY similarity DESC, p2) AS a, row_number() OVER (PARTITION BY p2 ORDER BY similarity DESC, p1) AS b FROM sim) WHERE a = 1 AND b = 1 AND similarity > 0.1")(lambda s, d: r6(P.mutual_matches(names(s, d, 0.1), 0.1)))
query("predicate_match_statistics", f"WITH {PREDS} SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max, round(stddev_pop(similarity), 6) AS std, count(*) FILTER (similarity >= 0.85) AS high FROM sim WHERE similarity > 0")(lambda s, d: r6(P.match_statistics(names(s, d))))
PARTS = "string_split(replace(o, '/', '-'), '-')"
NUMBER = "^\\s*[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|(?i)(nan|inf|infinity))\\s*$"
TYPE = f"CASE WHEN o = '' THEN 'unknown' WHEN len({PARTS}) >= 2 AND len(list_filter({PARTS}, lambda x: regexp_matches(x, '^[0-9]{{4,}}$'))) > 0 THEN 'date' WHEN regexp_matches(replace(o, ',', ''), '{NUMBER}') THEN 'number' WHEN length(o) < 20 AND NOT contains(o, ' ') AND regexp_matches(o, '[0-9]') THEN 'id' ELSE 'text' END"
TYPES = f"ty AS (SELECT kg, p, CASE WHEN max(n) / sum(n) >= 0.6 THEN arg_max(t, (n, t)) ELSE 'mixed' END AS type FROM (SELECT kg, p, {TYPE} AS t, count(*) AS n FROM triples WHERE o_kind = 'lit' GROUP BY 1, 2, 3) GROUP BY 1, 2)"
query("value_types", f"WITH {TYPES} SELECT * FROM ty")(lambda s, d: P.value_types(T(s, d)))
VALUES = f"""{TYPES}, vv AS (SELECT DISTINCT kg, p, lower(o) AS v FROM triples WHERE o_kind = 'lit'), ww AS (SELECT DISTINCT kg, p, w FROM (SELECT kg, p, unnest(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> '')) AS w FROM vv)),
 inf AS (SELECT kg, p, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, any_value(type) AS type, any_value(nw) AS nw FROM (SELECT *, try_cast(nullif(regexp_extract(regexp_replace(v, '[, ]', '', 'g'), '(-?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS x FROM vv) JOIN ty USING (kg, p) JOIN (SELECT kg, p, count(*) AS nw FROM ww GROUP BY 1, 2) USING (kg, p) GROUP BY 1, 2),
 vs AS (SELECT p1, p2, CASE WHEN n1 < 3 OR n2 < 3 THEN 0 WHEN t1 <> t2 THEN 0.1 WHEN t1 = 'text' THEN CAST(0.4 AS DOUBLE) * same / least(n1, n2) + CAST(0.6 AS DOUBLE) * shared / (nw1 + nw2 - shared) WHEN t1 = 'number' THEN CAST(0.5 AS DOUBLE) * same / least(n1, n2) + CAST(0.5 AS DOUBLE) * (1 - least(1, abs(m1 - m2) / greatest(abs(m1), abs(m2)))) * least(sd1, sd2) / greatest(sd1, sd2) ELSE CAST(same AS DOUBLE) / least(n1, n2) END AS similarity
 FROM (SELECT a.p AS p1, b.p AS p2, a.n AS n1, b.n AS n2, a.type AS t1, b.type AS t2, a.nw AS nw1, b.nw AS nw2, a.m AS m1, b.m AS m2, a.sd AS sd1, b.sd AS sd2, (SELECT count(*) FROM vv x JOIN vv y ON x.v = y.v WHERE x.kg = 1 AND y.kg = 2 AND x.p = a.p AND y.p = b.p) AS same, (SELECT count(*) FROM ww x JOIN ww y ON x.w = y.w WHERE x.kg = 1 AND y.kg = 2 AND x.p = a.p AND y.p = b.p) AS shared FROM inf a JOIN inf b ON a.kg = 1 AND b.kg = 2))"""
query("value_similarity", f"WITH {PREDS}, {VALUES} SELECT p1, p2, round(similarity, 6) AS similarity FROM vs SEMI JOIN (SELECT p1, p2 FROM sim WHERE similarity > 0) USING (p1, p2)")(lambda s, d: r6(P.value_similarity(T(s, d), names(s, d))))


def hybrid(s, d):
    data, named = derived(s, d), names(s, d, 0.1)
    pairs = named.select("p1", "p2").unionByName(data.attr_match.select("p1", "p2"))
    return r6(P.hybrid_alignment(named, P.value_similarity(data.triples, pairs), data.attr_match, threshold=0.1))



query("hybrid_predicate_alignment", f"WITH {PREDS}, {VALUES}, nm AS (SELECT p1, p2, 1.0 AS name FROM attr_match UNION ALL SELECT p1, p2, similarity FROM sim ANTI JOIN attr_match USING (p1, p2) WHERE similarity >= 0.1) SELECT p1, p2, round(CAST(0.6 AS DOUBLE) * name + CAST(0.4 AS DOUBLE) * coalesce(similarity, 0), 6) AS combined FROM nm LEFT JOIN vs USING (p1, p2)")(hybrid)

query("augment_relations", "WITH ends AS (SELECT 1 AS kg, e1 AS e, e1 || '_aug' || n AS a FROM (SELECT *, row_number() OVER (ORDER BY e1, e2) AS n FROM alignment) UNION ALL SELECT 2, e2, e2 || '_aug' || n FROM (SELECT *, row_number() OVER (ORDER BY e1, e2) AS n FROM alignment)) SELECT DISTINCT t.kg, coalesce(x.a, s) AS s, p, coalesce(y.a, o) AS o, o_kind FROM triples t LEFT JOIN ends x ON x.kg = t.kg AND x.e = s LEFT JOIN ends y ON y.kg = t.kg AND y.e = o WHERE o_kind = 'uri' AND (x.a IS NOT NULL OR y.a IS NOT NULL)")(lambda s, d: A.mirrored_relations(T(s, d), A.expand_pairs(derived(s, d).alignment)))
query("augment_literals", "WITH n AS (SELECT e1, e2, e1 || '_aug' || row_number() OVER (ORDER BY e1, e2) AS a1, e2 || '_aug' || row_number() OVER (ORDER BY e1, e2) AS a2 FROM alignment), l AS (SELECT a1, a2, p, o FROM triples JOIN n ON (kg = 1 AND s = e1) OR (kg = 2 AND s = e2) WHERE o_kind = 'lit') SELECT 1 AS kg, a1 AS s, p, o, 'lit' AS o_kind FROM l UNION SELECT 2, a2, p, o, 'lit' FROM l")(lambda s, d: A.copied_literals(T(s, d), A.expand_pairs(derived(s, d).alignment)))
query("augment_expand", "SELECT e1, e2, e1 || '_aug' || n AS a1, e2 || '_aug' || n AS a2, n FROM (SELECT *, row_number() OVER (ORDER BY e1, e2) AS n FROM alignment)")(lambda s, d: A.expand_pairs(derived(s, d).alignment))
query("augment_bfs")(lambda s, d: A.bfs_seeds(derived(s, d), 60, 2))
ENDS = "ends AS (SELECT 1 AS kg, e1 AS e, e1 || '_aug' || n AS a FROM (SELECT *, row_number() OVER (ORDER BY e1, e2) AS n FROM alignment) UNION ALL SELECT 2, e2, e2 || '_aug' || n FROM (SELECT *, row_number() OVER (ORDER BY e1, e2) AS n FROM alignment))"
query("augment_non_set", f"WITH {ENDS}, nr AS (SELECT x.kg, x.p, x.other, x.direction, ends.a FROM edges x JOIN ends ON ends.kg = x.kg AND ends.e = x.node WHERE NOT EXISTS (SELECT 1 FROM ends y WHERE y.kg = x.kg AND y.e = x.other)), no AS (SELECT other, row_number() OVER (ORDER BY other) AS n FROM (SELECT DISTINCT other FROM nr)), tw AS (SELECT DISTINCT nr.kg, nr.other, nr.other || '_aug' || (n + nr.kg - 1) AS twin FROM nr JOIN no ON no.other = nr.other) SELECT nr.kg, CASE WHEN direction = 'out' THEN a ELSE twin END AS s, p, CASE WHEN direction = 'out' THEN twin ELSE a END AS o, 'uri' AS o_kind FROM nr JOIN tw ON tw.kg = nr.kg AND tw.other = nr.other UNION SELECT t.kg, twin, p, o, 'lit' FROM triples t JOIN tw ON tw.kg = t.kg AND tw.other = t.s WHERE o_kind = 'lit'")(lambda s, d: A.non_set_expansion(derived(s, d), A.expand_pairs(derived(s, d).alignment), A.keep_value))
query("augment_frontier")(lambda s, d: N.expansion_frontier(derived(s, d), derived(s, d).alignment.agg(F.count(F.lit(1)).alias("n")).select(S.pair_budget(F.col("n"), 0.2)).first()[0], 2))
query("augment_plm")(lambda s, d: A.augment(derived(s, d), 0.2).triples)
query("augment_eda")(lambda s, d: A.augment_eda(derived(s, d), 0.2).triples)
query("mixup_training_rows")(lambda s, d: A.training_rows(derived(s, d)))
query("mixup_rows")(lambda s, d: A.mixup_rows(derived(s, d)))
query("context_training_rows")(lambda s, d: A.training_rows(derived(s, d), with_context=True))
query("predicate_token_map", "SELECT DISTINCT kg, p, '<' || upper(regexp_extract(coalesce(p1, p), '([^#/]*)$', 1)) || '>' AS token FROM triples LEFT JOIN attr_match ON kg = 2 AND p = p2 WHERE o_kind = 'lit'")(lambda s, d: A.predicate_token_map(derived(s, d)))
query("entity_context", "WITH h AS (SELECT kg, s, regexp_extract(p, '([^#/]*)$', 1) || ': ' || o AS c, md5('42|' || s || '|' || p || '|' || o) AS h FROM triples WHERE o_kind = 'lit' AND length(o) < 50), r AS (SELECT *, row_number() OVER (PARTITION BY kg, s ORDER BY h) AS rn FROM (SELECT DISTINCT * FROM h)) SELECT t.kg, t.s, coalesce(string_agg(c, '; ' ORDER BY h) FILTER (rn <= 2), 'generic') AS context FROM (SELECT DISTINCT kg, s FROM triples) t LEFT JOIN r ON r.kg = t.kg AND r.s = t.s GROUP BY 1, 2")(lambda s, d: A.context_text(T(s, d), 2))


def two(s, d):
    """Neighbouring texts: each document and the next, whole."""
    t = docs(s, d).select("doc_id", F.col("text").alias("a"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


query("long_text_map", graphs=False)(lambda s, d: L.interpolate_long(two(s, d), "a", "b", L.alternate_words).select("doc_id", "first", "second"))
TWO = "tw AS (SELECT a.doc_id, coalesce(a.text, '') AS a, coalesce(b.text, '') AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"
TOK = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
tw = lambda name, sql, f: query(name, f"WITH {TWO} SELECT doc_id, {sql} AS v FROM tw", graphs=False)(lambda s, d: r6(two(s, d).select("doc_id", f(F.col("a"), F.col("b")).alias("v"))))
CHARS = "string_split(' ' || lower({0}) || ' ', '')"
JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1}))) END"
ASCII = "regexp_replace({0}, '[^ -~]', '', 'g')"
G3 = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 2)), lambda i: {0}[i] || {0}[i + 1] || coalesce({0}[i + 2], '')))"


def trigrams(s, d):
    """The grams of each document are made once, and stored: they are the first text of one pair and the second of another."""
    made = cut(docs(s, d).select("doc_id", X.grams(F.col("text")).alias("a")))
    pairs = made.join(made.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return r6(pairs.select("doc_id", X.jaccard(F.col("a"), F.col("b")).alias("v")))


query("trigram_jaccard", f"WITH {TWO}, ch AS (SELECT doc_id, {CHARS.format('a')} AS a, {CHARS.format('b')} AS b FROM tw), gr AS (SELECT doc_id, {G3.format('a')} AS a, {G3.format('b')} AS b FROM ch) SELECT doc_id, round({JAC.format('a', 'b')}, 6) AS v FROM gr", graphs=False)(trigrams)
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
CONTENT = "list_distinct(list_filter(" + TOK + ", lambda w: NOT list_contains(" + STOP + ", w)))"
tw("token_jaccard", f"round({JAC.format(CONTENT.format('a'), CONTENT.format('b'))}, 6)", X.token_jaccard)
DT = "list_distinct(" + TOK + ")"
LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
MADE = "list_filter(" + TOK.format("b") + f", lambda w: NOT list_contains({STOP}, w))"
query("token_overlap", f"WITH {TWO}, tk AS (SELECT doc_id, list_distinct({TOK.format('a')}) AS x, {MADE} AS y FROM tw) SELECT doc_id, round(CASE WHEN len(y) = 0 THEN 0 ELSE CAST(len(list_filter(y, lambda w: list_contains(x, w))) AS DOUBLE) / len(y) END, 6) AS v FROM tk", graphs=False)(lambda s, d: r6(two(s, d).select("doc_id", X.token_overlap(F.col("a"), F.col("b")).alias("v"))))
DT = "list_distinct(" + TOK + ")"
VAL = STRIP.format("CASE WHEN contains(a, ': ') THEN substr(a, instr(a, ': ') + 2) ELSE a END")
tw("token_swap", f"lower({VAL}) <> lower({STRIP.format('b')}) AND list_sort({DT.format(VAL)}) = list_sort({DT.format('b')})", X.is_token_swap)
REST = "list_filter(" + TOK + f", lambda w: NOT list_contains({LIST(X.FILLERS)}, w))"
tw("filler_difference", f"lower({VAL}) <> lower({STRIP.format('b')}) AND {REST.format(VAL)} = {REST.format('b')}", X.differs_by_fillers)
one = lambda name, sql, f: query(name, f"SELECT doc_id, {sql} AS v FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)", graphs=False)(lambda s, d: docs(s, d).select("doc_id", f(F.col("text")).alias("v")))
query("levenshtein_ratio", "SELECT e1, e2, a.p AS p1, b.p AS p2, a.o AS o1, b.o AS o2, round(1 - CAST(levenshtein(a.o, b.o) AS DOUBLE) / greatest(1, length(a.o), length(b.o)), 6) AS v FROM alignment JOIN triples a ON a.kg = 1 AND a.s = e1 AND a.o_kind = 'lit' JOIN attr_match m ON m.p1 = a.p JOIN triples b ON b.kg = 2 AND b.s = e2 AND b.p = m.p2 AND b.o_kind = 'lit'")(lambda s, d: r6(R.matched_values(derived(s, d)).withColumn("v", X.levenshtein_ratio(F.col("o1"), F.col("o2")))))
one("eda_clean", "trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text, '[''\"’]', '', 'g'), '[-\\t\\n]', ' ', 'g')), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))", X.eda_clean)
one("cache_key", "array_to_string(list_sort(" + TOK.format("text") + "), ' ')", X.cache_key)
ST, WORDS = STRIP.format("text"), TOK.format("text")
DATED = f"len(list_filter({WORDS}, lambda w: list_contains({LIST(X.MONTHS)}, w))) > 0 AND len(list_filter({WORDS}, lambda w: regexp_matches(w, '^[0-9]{{4}}$'))) > 0"
NUMERIC = f"regexp_matches({ST}, '^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}|^[0-9]{{2}}[-/][0-9]{{2}}[-/][0-9]{{4}}|^[0-9\\s\\-/:.]+$|^https?://|@') OR {DATED} OR regexp_matches({ST}, '^[A-Za-z0-9\\-_]{{5,}}$') AND regexp_matches(text, '[0-9]')"
one("content_type", f"CASE WHEN list_contains({LIST(X.INVARIANT_VALUES)}, lower({ST})) THEN 'invariant' WHEN {NUMERIC} THEN 'numeric' WHEN len({WORDS}) <= 3 THEN 'short' ELSE 'long' END", X.content_type)
PLAUSIBLE = f"length(n) < 2 OR regexp_matches(n, '[aeiou]') AND NOT regexp_matches(regexp_replace(n, '[aeiou]', ' ', 'g'), '\\p{{L}}{{4}}') AND NOT list_contains({LIST(X.IMPOSSIBLE_STARTS)}, left(n, 2))"
query("plausible_name", f"SELECT DISTINCT w AS name, {PLAUSIBLE} AS v FROM (SELECT w, lower(w) AS n FROM (SELECT unnest({WORDS}) AS w FROM (SELECT coalesce(text, '') AS text FROM documents)))", graphs=False)(lambda s, d: docs(s, d).select(F.explode(X.tokens(F.col("text"))).alias("name")).distinct().withColumn("v", X.is_plausible_name(F.col("name"))))
one("clean_markup", "trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g'))", X.clean_markup)
HELD = f"regexp_replace(regexp_replace(regexp_replace(text, '({'|'.join(X.ABBREVIATIONS)})\\.', '\\1' || chr(1), 'g'), 'e\\.g\\.', 'e' || chr(1) || 'g' || chr(1), 'g'), 'i\\.e\\.', 'i' || chr(1) || 'e' || chr(1), 'g')"
BROKEN = f"regexp_split_to_array(regexp_replace(regexp_replace({HELD}, '([.!?])\\s+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), '\\n+', chr(2), 'g'), chr(2))"
SENTENCES = f"list_filter(list_transform({BROKEN}, lambda s: {STRIP.format('replace(s, chr(1), chr(46))')}), lambda s: s <> '')"
one("sentence_count", f"len({SENTENCES})", lambda t: F.size(X.sentences(t)).cast("long"))
query("sentences", f"SELECT doc_id, CAST(i AS INTEGER) AS n, x[i] AS sentence FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, {SENTENCES} AS x FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))", graphs=False)(lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n") + 1))
one("latex_escape", "regexp_replace(text, '([&%$#_{}])', '\\\\\\1', 'g')", X.latex_escape)
RUNS = "(SELECT doc_id, w, list_concat(list_concat([false], list_transform(w, lambda x: regexp_matches(x, '^\\p{Lu}'))), [false]) AS c FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents))"
query("entity_runs", f"SELECT doc_id, array_to_string(list_transform(list_zip(list_filter(range(1, len(w) + 1), lambda i: c[i + 1] AND NOT c[i]), list_filter(range(1, len(w) + 1), lambda i: c[i + 1] AND NOT c[i + 2])), lambda z: (z[1] - 1) || '-' || z[2]), ',') AS runs FROM {RUNS}", graphs=False)(lambda s, d: docs(s, d).select("doc_id", F.array_join(F.transform(X.entity_runs(F.col("text")), lambda r: F.concat_ws("-", r["first"].cast("string"), r["behind"].cast("string"))), ",").alias("runs")))
MASKED = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
query("mask_entities", f"SELECT doc_id, CASE WHEN len(w) < 2 THEN text ELSE array_to_string(list_transform(w, lambda x, i: CASE WHEN CAST('0x' || substr(md5(k || '|' || (i - 1)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CASE WHEN regexp_matches(x, '^\\p{{Lu}}') THEN 0.5 ELSE 0.15 END THEN '<mask>' ELSE x END), ' ') END AS v FROM (SELECT doc_id, text, md5(text) AS k, {MASKED} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))", graphs=False)(lambda s, d: docs(s, d).select("doc_id", X.mask_entities(F.col("text"), F.md5("text")).alias("v")))
query("sentence_chunks")(lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("n", "chunk")))
query("simple_clean")(lambda s, d: docs(s, d).select("doc_id", X.simple_clean(F.col("text")).alias("v")))
BY_WORD = " ".join(f"WHEN regexp_matches(lower(p), '{'|'.join(words)}') THEN '{kind}'" for kind, words in X.TYPE_KEYWORDS.items())
query("attribute_type", f"SELECT DISTINCT p, CASE {BY_WORD} WHEN regexp_matches(regexp_replace(o, '[-/:]', '', 'g'), '^[0-9]+$') THEN 'date' WHEN regexp_matches(regexp_replace(o, '[.,]', '', 'g'), '^[0-9]+$') THEN 'number' WHEN len({TOK.format('o')}) > 10 THEN 'description' ELSE 'other' END AS v FROM triples WHERE o_kind = 'lit'")(lambda s, d: T(s, d).where("o_kind = 'lit'").select("p", X.attribute_type(F.col("p"), F.col("o")).alias("v")).distinct())
WO = TOK.format("o")
query("token_reorder", f"SELECT DISTINCT o, CASE WHEN len({WO}) = 0 THEN '' ELSE array_to_string(list_transform({WO}, lambda w: upper(w)), ' ') END AS v FROM triples WHERE o_kind = 'lit'")(lambda s, d: T(s, d).where("o_kind = 'lit'").select("o").distinct().withColumn("v", X.reordered(F.col("o"), F.upper(X.cache_key(F.col("o"))))))
query("long_text_predicates", f"SELECT DISTINCT kg, p, regexp_matches(lower(p), '{'|'.join(X.LONG_TEXT_KEYWORDS)}') AS v FROM triples")(lambda s, d: T(s, d).select("kg", "p", X.is_long_text_predicate(F.col("p")).alias("v")).distinct())
query("duration_text", "SELECT event_id, CASE WHEN h > 0 THEN h || 'h ' || lpad(CAST(m AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(x AS VARCHAR), 2, '0') || 's' WHEN m > 0 THEN m || 'm ' || lpad(CAST(x AS VARCHAR), 2, '0') || 's' ELSE x || 's' END AS v FROM (SELECT event_id, s // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS x FROM (SELECT event_id, CAST(event_id * 7 AS BIGINT) AS s FROM events))", graphs=False)(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", X.duration(F.col("event_id") * 7).alias("v")))
query("json_metrics", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events", graphs=False)(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "map<string,double>").alias("m")).select("event_id", F.explode("m").alias("metric", "k")).where("metric = 'k'").select("event_id", "k"))
SPAN = f"SELECT doc_id, CASE WHEN n < 2 THEN text ELSE array_to_string(list_concat(list_concat(w[1:h % greatest(1, n - k + 1)], ['<mask>']), w[h % greatest(1, n - k + 1) + k + 1:]), ' ') END AS v FROM (SELECT *, greatest(1, CAST(floor(n * CAST(0.3 AS DOUBLE)) AS BIGINT)) AS k FROM (SELECT doc_id, text, w, len(w) AS n, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, text, {MASKED} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))))"
for name, f, sql in (("creative_variation", lambda t: G.variation(t, F.md5(t)), None), ("noise", lambda t: G.noise(t, F.md5(t)), None), ("mask_span", lambda t: G.mask_span(t, F.md5(t)), SPAN)):
    query(name, sql, graphs=False)(lambda s, d, f=f: docs(s, d).select("doc_id", f(F.col("text")).alias("v")))
query("friendly_names", "SELECT DISTINCT kg, s, replace(regexp_extract(s, '([^/]*)$', 1), '_', ' ') AS name FROM triples")(lambda s, d: T(s, d).select("kg", "s").distinct().withColumn("name", X.friendly_name(F.col("s"), "other")))
query("creative_strategies")(lambda s, d: T(s, d).where("o_kind = 'lit'").select("p", "o").distinct().withColumn("v", V.creative(F.col("o"), F.concat_ws("|", "p", "o"))))
MATCHED = ["e1", "e2", "p1", "p2", "o1", "o2"]
query("sequence_ratio")(lambda s, d: r6(R.matched_values(derived(s, d)).withColumn("v", G.sequence_ratio("o1", "o2"))))
query("creativity_score")(lambda s, d: r6(R.matched_values(derived(s, d)).withColumn("x", G.creativity_score("o1", "o2")).select(*MATCHED, "x.score", "x.reason")))
query("pair_score")(lambda s, d: r6(R.matched_values(derived(s, d)).withColumns({"m1": V.creative(F.col("o1"), F.col("o1"), F.col("o2")), "m2": V.creative(F.col("o2"), F.col("o2"), F.col("o1"))}).withColumn("v", G.pair_score("o1", "o2", "m1", "m2"))))
query("nfc", "SELECT doc_id, nfc_normalize(coalesce(text, '')) AS v FROM documents", graphs=False)(lambda s, d: docs(s, d).select("doc_id", G.nfc("text").alias("v")))
