"""Predicate candidates, reflection layers, self-training and long values, held against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.operators import longtext as L
from twinweave.operators import predicates as P
from twinweave.operators import ranking as K
from twinweave.operators import structure as M
from twinweave.plans import catalog, ranks
from twinweave.plans.queries_ranking import emb


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.85])
def test_candidates_lose_no_pair(spark, threshold):
    rng = random.Random(5)
    names = ["", "name", "birth place", "place of birth", "birthplace", "aaaa", "aaab", "zzz", "Éa", "label"]
    names += ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 14))).strip() or "q" for _ in range(60)]
    names += [n[:-1] + "x" for n in names[12:40] if len(n) > 3]
    one, two = ([(f"{s}{i}", n) for i, n in enumerate(names) if i % 3 != k] for s, k in (("p", 0), ("q", 1)))
    want = {}
    for p, a in one:
        for q, b in two:
            ratio = 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))
            if ratio > 0 and ratio >= threshold:
                want[p, q] = ratio
    frames = [spark.createDataFrame(rows, "p string, name string") for rows in (one, two)]
    found = P.name_similarity(*frames, threshold)
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(r.p1, r.p2): r.similarity for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    if threshold == 0.85:
        assert P.candidate_pairs(*frames, threshold).count() < len(one) * len(two) / 10


def reflected_by_hand(edge_list, vectors, relations, kernel):
    width = len(kernel[0])
    sums, count = {}, {}
    for a, b, p, w in edge_list:
        sums[a, b] = sums.get((a, b), np.zeros(width)) + w * relations[p]
        count[a, b] = count.get((a, b), 0) + 1
    out = {x: np.zeros(width) for x in vectors}
    scored = []
    for (a, b), r in sums.items():
        r = r / np.linalg.norm(r) if r.any() else r
        y = vectors[b] - 2 * (vectors[b] @ r) * r
        scored.append((a, count[a, b], y, np.concatenate([vectors[a], y, r]) @ np.concatenate(kernel)))
    top = max(s for *_, s in scored)
    total = {}
    for a, n, y, s in scored:
        out[a] = out[a] + n * np.exp(s - top) * y
        total[a] = total.get(a, 0) + n * np.exp(s - top)
    return {x: v / (total[x] + 1e-16) if x in total else v for x, v in out.items()}


def test_reflection_stack_by_hand(spark):
    """A hub with most edges, an edge with two relations, relations that cancel out, and a node without edges."""
    rng = np.random.default_rng(2)
    nodes = [f"n{i}" for i in range(30)]
    vectors = {x: rng.normal(size=3) for x in nodes}
    relations = {"r": rng.normal(size=3), "s": rng.normal(size=3)}
    relations["t"] = -relations["r"]
    edge_list = [("n0", x, "r", 0.5) for x in nodes[1:25]] + [("n0", "n3", "s", 0.5), ("n1", "n2", "r", 0.5), ("n1", "n2", "t", 0.5), ("n4", "n0", "s", 1.0), ("n4", "n4", "r", 1.0)]
    kernels = [tuple(rng.normal(size=3).tolist() for _ in range(3)) for _ in range(2)]
    frames = spark.createDataFrame(edge_list, "node string, other string, p string, weight double"), *[spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], f"{c} string, embedding array<double>") for d, c in ((vectors, "id"), (relations, "p"))]
    got = {r.id: np.array(r.embedding) for r in M.reflection_stack(*frames, kernels).collect()}
    current = {k: np.tanh(v) for k, v in vectors.items()}
    want = dict(current)
    for kernel in kernels:
        current = {k: np.tanh(v) for k, v in reflected_by_hand(edge_list, current, relations, kernel).items()}
        want = {k: np.concatenate([want[k], current[k]]) for k in want}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_hybrid_has_no_product(spark, sf_dir):
    plan = catalog.queries()["hybrid_predicate_alignment"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def trained_by_hand(left, right, seeds, rounds=10):
    known, turns = dict(seeds), dict.fromkeys(seeds, 0)
    for turn in range(1, rounds + 1):
        x, y = left[list(known)], right[list(known.values())]
        mapped = left @ np.linalg.solve(x.T @ x + np.eye(left.shape[1]), x.T @ y)
        scores = unit(mapped) @ unit(right).T
        there, back = scores.argmax(1), scores.argmax(0)
        new = {i: int(j) for i, j in enumerate(there) if back[j] == i and i not in known and scores[i, j] >= 0}
        if not new:
            break
        known |= new
        turns |= dict.fromkeys(new, turn)
    return {(i, known[i], turns[i]) for i in known}


def test_self_training_by_hand(spark, sf_dir):
    a, b = emb(spark, sf_dir)
    sides = [np.array([r.embedding for r in v.orderBy("id").collect()]) for v in (a, b)]
    n = len(sides[0])
    gold = a.select(F.col("id").alias("e1"), F.col("id").alias("e2"))
    seeds = {r.e1: r.e2 for r in ranks.top_by_hash(gold, n // 10, 42, ["e1", "e2"]).collect()}
    want = trained_by_hand(*sides, seeds)
    got = {tuple(r) for r in catalog.queries()["self_training"](spark, sf_dir).collect()}
    assert got == want and max(t for *_, t in got) > 1
    fewer = {tuple(r) for r in K.self_training(a, b, gold.where("e1 < 5"), rounds=1).collect()}
    assert fewer == trained_by_hand(*sides, {i: i for i in range(5)}, rounds=1) and fewer != {x for x in want if x[2] < 2}


def test_long_text_map_by_hand(spark, sf_dir):
    """Chunks of both sides by place; what only one side has stays; short texts go whole."""
    got = {r.doc_id: (r.first, r.second) for r in catalog.queries()["long_text_map"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = {r.doc_id: (r.text, r.c) for r in docs.select("doc_id", "text", X.chunks(F.col("text"), 80).alias("c")).collect()}
    turn = lambda a, b: " ".join((p if i < len(a) else q) if i % 2 == 0 else (q if i < len(b) else p) for i, (p, q) in enumerate((a[k] if k < len(a) else b[k], b[k] if k < len(b) else a[k]) for k in range(max(len(a), len(b)))))
    made = ragged = 0
    for i, (first, second) in got.items():
        (a, x), (b, y) = cut[i], cut[i + 1]
        if max(len(a.split()), len(b.split())) < 60:
            x, y = [a], [b]
        both = [(p.split(), q.split()) for p, q in zip(x, y)]  # noqa: B905
        n = len(both)
        assert first == " ".join([turn(p, q) for p, q in both] + x[n:]) and second == " ".join([turn(q, p) for p, q in both] + y[n:]), i
        made, ragged = made + (n > 1), ragged + (len(x) != len(y))
    assert made > 10 and ragged > 10


def test_long_text_map_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, 1), ("a b", None, 2), ("a b", None, 2), ("", "", 3)], "a string, b string, first_ int")
    got = sorted(map(tuple, L.interpolate_long(rows, "a", "b", L.alternate_words).collect()), key=repr)
    assert got == sorted([(None, None, 1, "", ""), ("a b", None, 2, "a b", "a b"), ("a b", None, 2, "a b", "a b"), ("", "", 3, "", "")], key=repr)


def test_sample_records_by_hand(spark, sf_dir):
    """Attributes by local name, the closest original among all, and the counterpart of every sampled entity."""
    import zlib

    from twinweave.plans.kg import augmented, derived

    data = derived(spark, sf_dir)
    grown = augmented(data)
    lit = [tuple(r) for r in grown.triples.where("o_kind = 'lit'").select("kg", "s", "p", "o").collect()]
    held = {}
    for kg, s, p, o in sorted(lit):
        held.setdefault((kg, s), []).append((p, o))

    def vector(facts):
        v = np.zeros(64)
        for w in " ".join(o for _, o in facts[:10]).lower().split():
            v[zlib.crc32(w.encode()) % 64] += 1
        return v / np.linalg.norm(v)

    line = lambda facts: "; ".join(f"{n}: {o}" for n, o in sorted({p.split("/")[-1].split("#")[-1]: o for p, o in facts}.items()))
    partner = {(1, a): b for a, b in grown.alignment.collect()} | {(2, b): a for a, b in grown.alignment.collect()}
    originals = {k: vector(f) for k, f in held.items() if "_aug" not in k[1]}
    got = catalog.queries()["sample_records"](spark, sf_dir).collect()
    assert len(got) == 20
    for r in got:
        kg = 1 if (1, r.synthetic_uri) in held else 2
        own = held[kg, r.synthetic_uri]
        best = max(float(vector(own) @ v) for (g, _), v in originals.items() if g == kg)
        assert r.synthetic_attributes == line(own) and r.aligned_counterpart_uri == partner[kg, r.synthetic_uri]
        assert abs(float(vector(own) @ originals[kg, r.closest_original_uri]) - best) < 1e-9
        assert r.closest_original_attributes == line(held[kg, r.closest_original_uri]) and r.notes == ""


def test_entities_at_the_edges(spark):
    rows = spark.createDataFrame([("",), ("New York is big",), ("we saw Anna Bell",), ("A",), ("a b",), ("Éa Zz x Q",)], "t string")
    got = {r.t: [tuple(x) for x in r.e] for r in rows.select("t", X.entity_runs(F.col("t")).alias("e")).collect()}
    assert got == {"": [], "New York is big": [(0, 2)], "we saw Anna Bell": [(2, 4)], "A": [(0, 1)], "a b": [], "Éa Zz x Q": [(0, 2), (3, 4)]}
    masked = spark.range(2000).select(X.mask_entities(F.lit("Anna went home"), F.col("id").cast("string")).alias("m")).collect()
    shares = [sum(r.m.split()[i] == "<mask>" for r in masked) / 2000 for i in range(3)]
    assert abs(shares[0] - 0.5) < 0.05 and all(abs(s - 0.15) < 0.04 for s in shares[1:])


def test_masks_of_long_texts(spark):
    """The key is hashed once a text, not once a word: a text of 60,000 words took a minute, and its words' draws are those of plain Python."""
    import hashlib
    import time

    def masked(text, key):
        words = text.split()
        share = lambda i: int(hashlib.md5(f"{key}|{i}".encode()).hexdigest()[:8], 16) / 2**32
        return " ".join("<mask>" if share(i) < (0.5 if w[0].isupper() else 0.15) else w for i, w in enumerate(words)) if len(words) > 1 else text

    texts = [" ".join(("Capital" if i % 3 else "small") + str(i) for i in range(60_000)), "", " one ", "Anna  went\nhome ", "Éa zz"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1)
    began = time.time()
    got = {r.t: r.m for r in rows.select("t", X.mask_entities(F.col("t"), F.md5("t")).alias("m")).collect()}
    assert time.time() - began < 20
    assert got == {t: masked(t, hashlib.md5(t.encode()).hexdigest()) for t in texts} | {None: None}
    whole = rows.select(X.mask_entities(F.col("t"), F.md5("t"), 1.0, 0.0).alias("m")).collect()
    assert {r.m for r in whole} >= {"<mask> went home", "<mask> zz", " one ", "", None}


def test_self_bleu_takes_one_pass(spark):
    """Equal to the mean over ordered pairs in plain Python; texts are split once, and bigrams are grouped without a join."""
    import random

    from twinweave.operators import quality

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["A", "b", "c", "d e", "É"]) for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 13, 13)] + [None, "b  b\tb b", " a b "]
    grams = [{*zip(w, w[1:], strict=False)} for w in ((t or "").lower().split() for t in texts) if len(w) > 1]
    want = sum(len(x & y) / len(x) for i, x in enumerate(grams) for j, y in enumerate(grams) if i != j) / (len(grams) * (len(grams) - 1))
    found = quality.self_bleu(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert abs(found.first().value - want) < 1e-12
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("split(") == 1


def test_long_runs_do_not_recurse(spark):
    """Repeated words, escapes and blank lines by the ten thousand."""
    from twinweave.sources import files

    run = "the " * 50_000
    row = spark.range(1).select(X.simple_clean(F.concat(F.lit("on "), F.lit(run), F.lit("end the The"))).alias("v"), (F.lit("\n" * 50_000 + "@prefix a: <b> .").rlike(r"(?i)^(?:\s|#[^\n]*\n)*+@?(?:prefix|base)\b")).alias("p"), F.lit('<a> <b> "' + "\\\\" * 50_000 + '" .').rlike(files.NT).alias("n")).first()
    assert row.v == "on the end the" and row.p and row.n
