"""Every query against its SQL, and invariants that hold for any data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.parity import compare, duck
from twinweave.functions import generators as G
from twinweave.functions import text as X
from twinweave.operators import profile, relational, splits, validate
from twinweave.operators import ranking as K
from twinweave.operators import stats as S
from twinweave.plans import catalog
from twinweave.plans.kg import Dataset, derived
from twinweave.plans.ranks import global_row_number

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, con, sf_dir, name):
    assert compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], sf_dir) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.kg for r in rows} == {1, 2}


def pairs(spark, n):
    return spark.createDataFrame([(f"e1/{i:02}", f"e2/{i:02}") for i in range(n)], "e1 string, e2 string")


def test_positional_split(spark):
    got = {r.e1: r.split for r in splits.split_positions(pairs(spark, 10)).collect()}
    assert [got[f"e1/{i:02}"] for i in range(10)] == ["sup"] * 2 + ["ref"] * 7 + ["valid"]
    some = pairs(spark, 2).unionByName(pairs(spark, 2).select(*[F.concat(c, F.lit("_aug1")).alias(c) for c in ("e1", "e2")]))
    assert all(r.split == "sup" for r in splits.split_augmented_only_train(some).collect() if "_aug" in r.e1)


def test_row_numbers_are_global(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = global_row_number(rows, ["k"]).collect()
    assert all(r.rn == r.k + 1 for r in got) and len(got) == 1000
    # Half of the rows tie in the first key: the next one splits them, and they stand in several ranges.
    ties = rows.select(F.when(F.col("k") < 500, 0).otherwise(F.col("k")).alias("a"), "k").repartition(5)
    got = global_row_number(ties, ["a", F.col("k").desc()]).collect()
    assert all(r.rn == (500 - r.k if r.k < 500 else r.k + 1) for r in got) and len(got) == 1000
    assert global_row_number(rows.where("false"), ["k"]).count() == 0
    nulls = spark.createDataFrame([(None,), ("b",), ("a",), (None,)], "k string")
    assert [r.k for r in global_row_number(nulls, ["k"]).orderBy("rn").collect()] == [None, None, "a", "b"]


def test_reductions_keep_invariants(spark, sf_dir):
    data = derived(spark, sf_dir)
    less = splits.forget_labels(data, 0.5, splits.split_positions(data.alignment))
    assert less.alignment.join(less.fixed_test, ["e1", "e2"]).count() == 0
    small, large = (splits.reduce_alignment_only(data, r).alignment for r in (0.2, 0.6))
    assert small.subtract(large).count() == 0
    assert splits.training_mode(data.alignment, data.alignment, "synthetic_only").count() == data.alignment.count()
    with pytest.raises(ValueError):
        splits.supervision_level(data.alignment, 0)


def test_fused_node_keeps_provenance(spark):
    rows = [(1, "A", "rel", "B", "uri"), (2, "A2", "rel", "C", "uri"), (2, "D", "back", "A2", "uri"), (1, "A", "name", "a", "lit"), (2, "A2", "name", "b", "lit")]
    data = Dataset(spark.createDataFrame(rows, "kg int, s string, p string, o string, o_kind string"), spark.createDataFrame([("A", "A2")], "e1 string, e2 string"), None)
    fused = {tuple(r) for r in relational.set_graph(data).collect()}
    assert ("set:A|A2", "rel", "B", "uri") in fused and ("D", "back", "set:A|A2", "uri") in fused and ("set:A|A2", "name", "b", "lit") in fused
    stats = {r.kg: r.triples for r in profile.kg_statistics(data.triples).collect()}
    assert stats == {1: 2, 2: 3}


def test_ranks_and_metrics(spark):
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.5), (2, 2, 0.1), (2, 1, 0.1)], "e1 long, e2 long, score double")
    gold = spark.createDataFrame([(1, 1), (2, 2)], "e1 long, e2 long")
    for ties, want in (("ordinal", [2, 2]), ("top", [2, 1]), ("bottom", [3, 2])):
        assert [r["rank"] for r in K.gold_ranks(scores, gold, ties).orderBy("e1").collect()] == want
    values = {r.metric: r.value for r in K.metrics(K.gold_ranks(scores, gold)).collect()}
    assert values == {"hits@1": 0.0, "hits@5": 1.0, "hits@10": 1.0, "mr": 2.0, "mrr": 0.5}


def test_blocks_do_not_change_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    frames = [spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(n)], "id long, embedding array<double>") for n in (40, 70)]
    want = [tuple(r) for r in K.block_knn(*frames, 4, "cosine").orderBy("e1", "rank").collect()]
    got = [tuple(r) for r in K.block_knn(*frames, 4, "cosine", block_rows=9).orderBy("e1", "rank").collect()]
    assert [(a, b) for a, b, *_ in got] == [(a, b) for a, b, *_ in want]
    gold = spark.createDataFrame([(i, i) for i in range(40)], "e1 long, e2 long")
    one, two = (sorted(map(tuple, K.block_gold_ranks(*frames, gold, "cosine", b).collect())) for b in (9, 1000))
    assert one == two


@pytest.mark.parametrize("metric", ["inner", "cosine", "euclidean", "manhattan"])
def test_neighbours_by_brute_force(spark, metric):
    """Equal rows tie exactly and go by id, with biases and a scale, whatever the size of a block."""
    import numpy as np

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(150, 33)), rng.normal(size=(40, 33))
    y = np.concatenate([y] * 15)
    bias = {"a": np.round(rng.random(len(x)), 2), "b": np.tile(np.round(rng.random(40), 2), 15)}
    frame = lambda m, c: spark.createDataFrame([(i, r.tolist(), float(b)) for i, (r, b) in enumerate(zip(m, c, strict=True))], "id long, embedding array<double>, bias double")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    apart = x[:, None] - y[None]
    score = {"inner": lambda: x @ y.T, "cosine": lambda: unit(x) @ unit(y).T, "euclidean": lambda: 1 - np.sqrt((apart**2).sum(2)), "manhattan": lambda: 1 - np.abs(apart).sum(2)}[metric]()
    score = np.round(2 * score - bias["a"][:, None] - bias["b"][None], 9)
    want = [(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(y)), -score[i]))[:20]]
    for rows in (7, 8192):
        got = [tuple(r) for r in K.block_knn(frame(x, bias["a"]), frame(y, bias["b"]), 20, metric, rows, 2.0).orderBy("e1", "rank").collect()]
        assert [r[:2] for r in got] == want and np.allclose([r[2] for r in got], [score[p] for p in want])
        gold = spark.createDataFrame([(i, i + 80) for i in range(len(x))], "e1 long, e2 long")
        ranks = {r.e1: r["rank"] for r in K.block_gold_ranks(frame(x, bias["a"]), frame(y, bias["b"]), gold, metric, rows, 2.0).collect()}
        better = lambda i: (score[i] > score[i, i + 80]) | ((score[i] == score[i, i + 80]) & (np.arange(len(y)) < i + 80))
        assert ranks == {i: 1 + int(better(i).sum()) for i in range(len(x))}


def test_right_rows_are_sent_a_fixed_number_of_times(spark):
    """Smaller blocks send no more rows, and CSLS makes its biases once, not again for each count and ranking."""
    import numpy as np

    rng = np.random.default_rng(1)
    frames = [spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(n)], "id long, embedding array<double>") for n in (300, 500)]
    read = lambda df: df.where("spark_partition_id() >= 0")._jdf.queryExecution().toRdd().count() and df._jdf.queryExecution().executedPlan().toString()
    for rows in (2, 1000):
        plan = read(K.block_knn(*frames, 3, "cosine", rows))
        assert plan.count("MapInArrow") == 1 and "FlatMapCoGroups" not in plan
    assert K._dealt(*frames).count() == 300 + 500 * min(spark.sparkContext.defaultParallelism, 300 // 64)
    assert read(K.csls_knn(*frames, 3)).count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["iterative_alignment", "score_shift"])
def test_tables_of_scores_are_made_once(spark, sf_dir, name):
    """What the query gives reads stored scores; it doesn't score all rows again for each part that uses them."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapCoGroups" not in plan


def test_few_pairs_are_settled_in_doubles(monkeypatch):
    """Tiles are as large as what was met before, so a row settles a few pairs each time that number doubles, not those of a
    whole batch that pass a floor from 512 rows."""
    import numpy as np

    from twinweave.functions import nearest as N

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(64, 16)), rng.normal(size=(8192, 16))
    count, settled = [], N.settled
    monkeypatch.setattr(N, "settled", lambda x, y, rows, cols, metric: count.append(len(rows)) or settled(x, y, rows, cols, metric))
    for metric in ("inner", "cosine", "euclidean", "manhattan"):
        count.clear()
        state = N.Nearest(np.arange(64), x, np.zeros(64), 5, metric)
        state.add(np.arange(8192), y, np.zeros(8192))
        whole = np.concatenate([settled(N.prepared(x, metric), N.prepared(y, metric), np.full(8192, i), np.arange(8192), metric) for i in range(64)]).reshape(64, -1)
        assert np.array_equal(state.best_ids, np.argsort(-whole, axis=1, kind="stable")[:, :5])
        assert sum(count) < 64 * (250 if metric == "manhattan" else 45)
    marks = rng.random((5, 13)) < 0.2
    assert [list(v) for v in N._marked(marks)] == [list(v) for v in np.nonzero(marks)]


@pytest.mark.parametrize("metric", ["inner", "cosine", "euclidean"])
def test_scores_at_a_time_fit_a_cache(metric):
    """No more than 2 ** 18 scores stand at a time, and parts of tiles give the ranks of whole ones, whether
    few or many right rows are better than the answer."""
    import numpy as np

    from twinweave.functions import nearest as N

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(512, 16)), rng.normal(size=(9000, 16))
    y[:300] = x[:300] + 0.1 * rng.normal(size=(300, 16))
    y[4000:4100], golds = y[:100], np.arange(512)
    score = np.stack([N.pair_scores(np.broadcast_to(r, y.shape), N.prepared(y, metric), metric) for r in N.prepared(x, metric)])
    own = score[golds, golds][:, None]
    sizes, marked = [], N._marked
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(N, "_marked", lambda marks: sizes.append(marks.size) or marked(marks))
        better = N.Better(x, golds, y[golds], np.zeros(512), metric, 1.0, True)
        better.add(np.arange(9000), y, np.zeros(9000))
        nearest = N.Nearest(golds, x, np.zeros(512), 10, metric)
        nearest.add(np.arange(9000), y, np.zeros(9000))
    assert np.array_equal(better.n, ((score > own + 1e-12) | ((np.abs(score - own) <= 1e-12) & (np.arange(9000) < golds[:, None]))).sum(1))
    assert np.array_equal(nearest.best_ids, np.argsort(-score, axis=1, kind="stable")[:, :10])
    assert max(sizes) <= 1 << 18


def test_manhattan_settles_what_float32_leaves():
    """Of the pairs that whole steps of a component leave, doubles settle those that float32 leaves too; steps are added up right
    for widths that eight does not divide, and for rows far from zero or far apart."""
    import numpy as np

    from twinweave.functions import nearest as N

    rng = np.random.default_rng(6)
    for width, far in ((64, 0.0), (13, 1e4), (3, 0.0)):
        x, y = rng.normal(size=(70, width)) + far, rng.normal(size=(9000, width)) + far
        y[5], y[17] = y[5] + 1e6, x[3]
        whole = 1 - np.abs(x[:, None] - y[None]).sum(2)
        count, settled = [], N.settled
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(N, "settled", lambda x, y, rows, cols, metric, count=count: count.append(len(rows)) or settled(x, y, rows, cols, metric))
            state = N.Nearest(np.arange(70), x, np.zeros(70), 5, "manhattan")
            state.add(np.arange(9000), y, np.zeros(9000))
        assert np.array_equal(state.best_ids, np.argsort(-whole, axis=1, kind="stable")[:, :5])
        assert far or sum(count) < 70 * 60


@pytest.mark.parametrize("metric", ["inner", "cosine"])
def test_mutual_best_by_brute_force(spark, metric):
    """Both directions, with ties by id, from one pass; copies on both sides settle few pairs, and rows that are not finite take
    no part."""
    import numpy as np

    from twinweave.functions import nearest as N

    rng = np.random.default_rng(8)
    x, y = np.concatenate([rng.normal(size=(40, 9))] * 3 + [rng.normal(size=(90, 9))]), np.concatenate([rng.normal(size=(60, 9))] * 4 + [rng.normal(size=(70, 9))])
    x[50], y[7] = np.nan, np.nan
    y[100:200:3] = x[60:94]
    score = np.stack([N.pair_scores(np.broadcast_to(r, y.shape), N.prepared(y, metric), metric) for r in N.prepared(x, metric)])
    score = np.where(np.isnan(score), -np.inf, score)
    there, back = score.argmax(1), score.argmax(0)
    want = [(i, int(j)) for i, j in enumerate(there) if back[j] == i and np.isfinite(score[i, j])]
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, embedding array<double>")
    for rows in (7, 8192):
        assert sorted(map(tuple, K.block_mutual(frame(x), frame(y), metric, rows).collect())) == want
    count, settled = [], N.settled
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(N, "settled", lambda x, y, rows, cols, metric: count.append(len(rows)) or settled(x, y, rows, cols, metric))
        state = N.Mutual(np.arange(4000), np.repeat(x[:40], 100, axis=0), metric)
        state.add(np.arange(6000), np.repeat(y[10:40], 200, axis=0))
    assert sum(count) <= 40 + 30 and len(state.result()[0]) == 4000 + 6000


@pytest.mark.parametrize("name, passes", [("mutual_best", 1), ("discovered_ranks", 2)])
def test_both_directions_take_one_pass(spark, sf_dir, name, passes):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == passes


@pytest.mark.parametrize("name", ["two_sided_negatives", "discovered_ranks", "mutual_best", "hits_bidirectional", "knn_bidirectional", "reciprocal_pairs"])
def test_second_side_is_joined_once(spark, sf_dir, name):
    """Passes after the first read the stored second side; none joins the vectors with the following ones anew."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_next" not in plan and "MapInArrow" in plan


def test_equal_values_tie_wherever_they_are_stored(spark, tmp_path):
    """Two users with the same values rank by number, though one's rows lie in two files: 0.1 + 0.2 + 0.3 depends on the order."""
    import pandas as pd

    values = [0.1, 0.5, 0.2, 0.4, 0.3]
    row = lambda user, n, event_id: {"event_id": event_id, "ts": pd.Timestamp("2024-01-01"), "user_id": user, "event_type": "click", "value": values[n], "props": "{}"}
    ids = [0, 1, 3, 4, 6]
    first, second = ([row(u, n, 9 * u + i) for n, i in enumerate(ids)] for u in (1, 2))
    (tmp_path / "events.parquet").mkdir()
    for n, part in enumerate((first, second[:1], second[1:])):
        pd.DataFrame(part).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet" / f"{n}.parquet", index=False)
    con = duck(str(tmp_path))
    con.execute("SET threads = 1")
    assert compare(spark, con, catalog.queries()["improvement_ranking"], catalog.oracle_sql()["improvement_ranking"], str(tmp_path)) == ""
    assert [r.experiment for r in catalog.queries()["improvement_ranking"](spark, str(tmp_path)).orderBy("rank").collect()] == [1, 2]


def test_bridges_in_blocks(spark, monkeypatch):
    """Pairs are whole in small blocks; nodes of one neighbour each are paired without making their pairs distinct."""
    import random
    from itertools import combinations

    monkeypatch.setattr(relational, "BRIDGE_ROWS", 3, raising=False)
    rng = random.Random(4)
    nodes = [f"a{i}" for i in range(30)]
    frame = lambda links: spark.createDataFrame([(1, n, "p", o, "uri") for n, o in links], "kg int, s string, p string, o string, o_kind string")
    inside = spark.createDataFrame([(1, n) for n in nodes], "kg int, entity string")
    shared = {(n, f"h{rng.randrange(6)}") for n in nodes for _ in range(rng.randrange(4))} | {("a1", "a2"), ("z", "h1")}
    around = {n: {o for m, o in shared if m == n and o[0] == "h"} for n in nodes}
    want = sorted((1, *sorted(p)) for p in combinations(nodes, 2) if around[p[0]] & around[p[1]])
    assert sorted(map(tuple, relational.bridged(frame(shared), inside).collect())) == want
    single = relational.bridged(frame([(n, f"h{i % 2}") for i, n in enumerate(nodes)]), inside)
    assert single.count() == 2 * 15 * 14 // 2
    assert "Aggregate" not in single._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_text_functions(spark):
    row = spark.createDataFrame([("Dr. Smith went home. He slept! Is this it?\nNew line", "a b c", "c b a", "ont/birthPlace", "1,234.5 km")], "t string, a string, b string, p string, n string")
    r = row.select(X.sentences(F.col("t")).alias("s"), X.chunks(F.col("t"), 6).alias("c"), X.is_token_swap(F.col("a"), F.col("b")).alias("w"), X.expand_predicate(F.col("p")).alias("e"), X.first_number(F.col("n")).alias("n"), X.simple_clean(F.lit("see http://x the the a cat.. ")).alias("k"), X.set_members(X.set_uri(F.lit("x"), F.lit("y"))).alias("m"), X.char_ids(F.lit("abz"), F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.lit(2).cast("long")), 5).alias("i")).first()
    assert r.s == ["Dr. Smith went home.", "He slept!", "Is this it?", "New line"]
    assert r.c == ["Dr. Smith went home. He slept!", "Is this it? New line"]
    assert r.w and r.e == "birth place" and r.n == 1234.5 and r.k == "see the cat" and r.m == ["x", "y"] and r.i == [1, 2, 0, 0, 0]


def test_generators_are_seeded(spark):
    rows = spark.createDataFrame([("Springfield Street",), ("true",), ("41",), (None,)], "v string")
    made = rows.select("v", G.variation("v", F.md5(F.coalesce("v", F.lit("")))).alias("w"), G.noise(F.col("v"), F.md5(F.coalesce("v", F.lit("")))).alias("n"))
    first, second = (sorted(map(tuple, made.collect()), key=repr) for _ in range(2))
    assert first == second and ("true", "false") in {r[:2] for r in first} and {r[1] for r in first if r[0] == "41"} <= {"40", "42"}
    score = rows.limit(1).select(G.creativity_score(F.lit("big red house"), F.lit("big red house")).alias("x")).first().x
    assert tuple(score) == (0.0, "identity")
    assert spark.range(1).select(G.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("r")).first().r == 0.75
    assert spark.range(1).select(G.nfc(F.lit("é")).alias("r")).first().r == "é"


@pytest.mark.parametrize("name", ["creative_variation", "noise", "mask_span"])
def test_generators_take_whole_texts(spark, tmp_path, name):
    texts = [" ".join(f"word{i}x{k}" for k in range(200)) for i in range(4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.v for r in catalog.queries()[name](spark, f"file://{tmp_path}").collect()}
    assert len(got) == 4 and all(len(got[i]) > 0.6 * len(t) and got[i] != t for i, t in enumerate(texts))


def test_statistics_edges(spark):
    runs = spark.createDataFrame([("d", "baseline", 1.0), ("d", "augmented", 2.0)], "dataset string, stage string, value double")
    assert S.cohens_d(runs, "baseline", "augmented", "dataset").first().d is None
    assert S.outliers_iqr(runs, "dataset").count() == 0
    p = spark.createDataFrame([(0.0, float(i % 5)) for i in range(40)], "a double, b double").withColumn("k", F.lit(1))
    r = S.paired_t_test(p, "k").first()
    assert abs(r.t - 2 / (2**0.5 / 40**0.5)) < 1e-9 and r.p < 1e-6


def test_reject_strategy(spark, sf_dir):
    data = derived(spark, sf_dir)
    with pytest.raises(validate.ShapeError):
        validate.apply_strategy(data, [validate.Constraint("ont/name", "maxLength", 1)], "reject")
    assert validate.apply_strategy(data, [validate.Constraint("ont/name", "maxLength", 1000)], "reject")[1].count() == 0


def test_text_rules(spark):
    """Hand-worked values of the fixed rules."""
    rows = [
        ("a", "The Smith and Sons Ltd of London", "by Smith the sons of LONDON"),
        ("b", "name: john smith", "Smith John"),
        ("c", "name: the house", "house by"),
        ("d", "", ""),
    ]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    got = {r.k: r for r in df.select("k", X.token_overlap(F.col("a"), F.col("b")).alias("overlap"), X.token_jaccard(F.col("a"), F.col("b")).alias("jaccard"), X.is_token_swap(F.col("a"), F.col("b")).alias("swap"), X.differs_by_fillers(F.col("a"), F.col("b")).alias("filler")).collect()}
    assert (got["a"].overlap, got["a"].jaccard) == (1.0, 0.75)
    assert (got["b"].swap, got["b"].filler) == (True, False)
    assert (got["c"].swap, got["c"].filler) == (False, True)
    assert (got["d"].overlap, got["d"].jaccard, got["d"].swap, got["d"].filler) == (0.0, 0.0, False, False)


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (X.content_type, {"Yes": "invariant", "n/a": "invariant", "2023-01-15x": "numeric", "15/01/2023": "numeric", "12:30 - 14": "numeric", "15 March 2020": "numeric", "march parade": "short", "ABC123": "numeric", "supertramp": "short", "https://a.b": "numeric", "me@x.y z": "numeric", "one two three four": "long", "": "short"}),
        (X.value_type, {"2020/1": "date", "1-2": "id", "1,234.5": "number", "-1e5": "number", "X12": "id", "x 12": "text", "plain": "text", "": "unknown", "nan": "number"}),
        (X.is_plausible_name, {"a": True, "z": True, "Anna": True, "lynn": False, "Smith": True, "nguyen": False, "strngth": False, "Schwarz": False, "éa": True}),
        (lambda v: F.array_join(X.sentences(v), "|"), {"This is sentence one. This is sentence two! Is this sentence three?": "This is sentence one.|This is sentence two!|Is this sentence three?", "Dr. Who met Mrs. Jones, e.g. Ann i.e. Bob. Then Inc. Ltd. left": "Dr. Who met Mrs. Jones, e.g. Ann i.e. Bob.|Then Inc. Ltd. left", "a\n\n b ": "a|b", "St. Paul": "St.|Paul", " ": ""}),
        (X.is_long_text_predicate, {"http://x/Biography": True, "noteOf": True, "name": False}),
        (X.simple_clean, {"Mu00e9nchen http://a.b  the the x big-": "Ménchen the big", "Zürich & é": "Zürich é"}),
        (lambda v: X.attribute_type(F.lit("p"), v), {"12:30": "date", "1,234.5": "number", "a b c d e f g h i j k": "description", "x": "other"}),
    ],
)
def test_value_rules(spark, rule, cases):
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    assert {r.v: r.x for r in df.select("v", rule(F.col("v")).alias("x")).collect()} == cases


def test_reordered_words(spark):
    rows = [("martin ain eric", "Arms Rdy Osmond", "Osmond Arms Rdy"), ("eric ain martin", "Arms Rdy", "Rdy Arms"), ("", "x y", "x y")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", X.reordered(F.col("a"), F.col("b")).alias("got")).collect())


@pytest.mark.parametrize(
    ("given", "made", "other", "score", "reason"),
    [
        ("john smith", "j", "", -1.0, "empty"),
        ("john smith", "Rewrite this", "", -1.0, "leaked"),
        ("jose perez", "josu00e9 pu00e9rez", "", 0.05, "garbage"),
        ("john smith", "jhn smith", "", 0.0, "unpronounceable"),
        ("john smith", "John Smith ", "", 0.0, "identity"),
        ("john smith", "john smith jr", "", 0.1, "lazy suffix"),
        ("sprocket toad wet", "sprocket toad", "", 0.15, "removal"),
        ("john smith", "johnny smithe", "", 1.0, "all modified"),
        ("david hidalgo", "david hdialgo", "", 0.4, "swap"),
        ("smith", "smiht", "", 0.7, "swap"),
        ("rollins band", "rollins the band", "", 0.15, "filler"),
        ("rollins big band", "band rollins big", "", 1.0, "all modified"),
        ("rollins big band", "rollins band big", "", 0.15, "shuffle"),
        ("mary smith", "mary jonson", "john jones", 1.0, "mix"),
        ("mary smith", "mary osmond", "", 0.7, "partial"),
        ("a b c d e f g", "one two three four five six", "", 0.1, "garbage"),
        ("the quick brown fox jumps high", "the quick brown fox jumps high", "", 0.0, "identity"),
    ],
)
def test_scores_of_texts(given, made, other, score, reason):
    assert G.score_text(given, made, other) == (score, reason)


def test_pair_scores(spark):
    rows = [("mary smith", "john smith", "mery smithson", "jon smithson"), ("x y", "", None, "a")]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string, c string, d string").select(G.pair_score("a", "b", "c", "d").alias("v")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0
    assert G.coherence("mary smith", "john smith", "mery smithson", "jon smithson") == 0.15


def test_noise_is_bounded():
    import random

    text = "The old house, on the hill; has 12 rooms."
    for seed in range(50):
        made = G._noise(text, random.Random(seed), 0.3)
        assert [c for c in made if c in G.KEPT] == [c for c in text if c in G.KEPT]
    assert G._noise("ab", random.Random(1), 1.0) == "ab" and G._noise(text, random.Random(1), 0.0) == text


def test_nearest_distance(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=(30, 5))
    x[7] = x[3]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, embedding array<double>")
    got = {r.id: r.distance for r in K.nearest_distance(frame(x), frame(y), block_rows=7).collect()}
    assert np.allclose([got[i] for i in range(40)], (1 - unit(x) @ unit(y).T).min(axis=1))
    own = 1 - unit(x) @ unit(x).T
    own[own <= 1e-9] = np.inf
    got = {r.id: r.distance for r in K.nearest_distance(frame(x), frame(x), True, block_rows=7).collect()}
    assert np.allclose([got[i] for i in range(40)], own.min(axis=1))


def small_dataset(spark, triples, aligned):
    return Dataset(spark.createDataFrame(triples, "kg int, s string, p string, o string, o_kind string"), spark.createDataFrame(aligned, "e1 string, e2 string"), spark.createDataFrame([], "p1 string, p2 string"))


def test_bridges_start_anew(spark):
    """a-b are set neighbours; b and c share the hub h outside the alignment, c-d are set neighbours again; z is apart."""
    from twinweave.operators import augment as A

    triples = [(1, "a", "r", "b", "uri"), (1, "b", "r", "h", "uri"), (1, "c", "r", "h", "uri"), (1, "c", "r", "d", "uri"), (2, "a2", "n", "v", "lit"), (1, "z", "n", "v", "lit")]
    data = small_dataset(spark, triples, [(x, f"{x}2") for x in "abcdz"])
    order = [r.e1 for r in splits.keep_by_hash(data.alignment, 42, lambda n: F.lit(5)).withColumn("h", F.md5(F.concat_ws("|", F.lit("42"), "e1", "e2"))).orderBy("h").collect()]
    links = {"a": {"b"}, "b": {"a"}, "c": {"d"}, "d": {"c"}, "z": set()}
    bridge = {"b": {"c"}, "c": {"b"}}
    for budget, depth in ((4, 3), (4, 1), (5, 3)):
        seen, frontier = {order[0]: 0}, {order[0]: 0}
        while len(seen) < budget and frontier:
            new = {}
            for x, at in frontier.items():
                for y in links[x] if at < depth else ():
                    new[y] = min(new.get(y, 99), at + 1)
                for y in bridge.get(x, ()) if at + 2 <= depth else ():
                    new[y] = 0
            frontier = {y: at for y, at in new.items() if y not in seen}
            seen |= frontier
        got = {r.e1: r.depth for r in A.bfs_seeds(data, budget, depth).collect()}
        assert len(got) == budget and all(got[x] == (seen[x] if x in seen else depth + 1) for x in got)


def test_provenance_of_fused_relations(spark):
    from twinweave.operators import selection as C

    triples = [(1, "A", "rel", "B", "uri"), (1, "A", "name", "Alpha", "lit"), (2, "a", "rel2", "C", "uri"), (2, "D", "back", "a", "uri"), (2, "a", "name2", "Alfa", "lit")]
    got = {(r.node, r.origin, r.p, r.other, r.direction) for r in C.relation_provenance(small_dataset(spark, triples, [("A", "a")])).collect()}
    node = "set:A|a"
    assert got == {(node, "source", "rel", "B", "out"), (node, "source", "name", "Alpha", "out"), (node, "target", "rel2", "C", "out"), (node, "target", "back", "D", "in"), (node, "target", "name2", "Alfa", "out")}


def test_twins_of_neighbours_outside(spark):
    from twinweave.operators import augment as A

    triples = [(1, "A", "rel", "B", "uri"), (1, "B", "name", "bee", "lit"), (2, "D", "back", "a", "uri"), (2, "a", "rel", "B", "uri")]
    data = small_dataset(spark, triples, [("A", "a")])
    got = {(r.kg, r.s, r.p, r.o) for r in A.non_set_expansion(data, A.expand_pairs(data.alignment), A.keep_value).collect()}
    assert got == {(1, "A_aug1", "rel", "B_aug1"), (1, "B_aug1", "name", "bee"), (2, "D_aug3", "back", "a_aug1"), (2, "a_aug1", "rel", "B_aug2")}


def test_rankers_by_model_and_open_hits(spark):
    from twinweave.plans.registry import RANKERS, autoload

    autoload()
    assert "rrea" in RANKERS.list() and "multiKE" in RANKERS.list()
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "id long, embedding array<double>")
    for model in RANKERS.list():
        best = {r.e1: r.e2 for r in RANKERS.get(model)(vectors, vectors, 1).collect()}
        assert best == {i: i for i in range(4)}, model
    ranks = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), ("c", "z", None)], "e1 string, e2 string, rank long")
    got = {r.metric: r.value for r in K.metrics(ranks, ks=(1, 3, 10), candidates=5).collect()}
    assert got["hits@1"] == pytest.approx(1 / 3) and got["hits@3"] == pytest.approx(2 / 3) and got["hits@10"] == 0
    scores = spark.createDataFrame([("a", x, 1.0) for x in "pqrs"], "e1 string, e2 string, score double")
    gold = spark.createDataFrame([("a", "r")], "e1 string, e2 string")
    rank = {t: K.gold_ranks(scores, gold, t).first()["rank"] for t in ("ordinal", "top", "bottom", "random")}
    assert (rank["ordinal"], rank["top"], rank["bottom"]) == (3, 1, 4) and 1 <= rank["random"] <= 4


def test_mixup_rows(spark, sf_dir):
    """With a generator that appends, every row follows from its kind's rule, and the shares are near theirs."""
    from collections import Counter

    from twinweave.operators import augment as A

    data = derived(spark, sf_dir)
    rows = A.mixup_rows(data, lambda v, k: F.concat(v, F.lit("son"))).collect()
    kinds = Counter(r.kind for r in rows)
    assert set(kinds) == {"aligned", "synthetic", "orphan", "flip", "name"} and kinds["flip"] == 2 * 3 * len(A.FLIP_PAIRS)
    ways = {(r.v1, r.v2) for r in relational.aligned_attributes(data).collect()}
    ways = {w for a, b in ways for w in ((a, b), (b, a)) if a.strip().lower() != b.strip().lower()}
    aligned = Counter((r.source, r.target) for r in rows if r.kind == "aligned")
    assert set(aligned) <= ways and all(n % 3 == 0 for n in aligned.values())
    assert all(r.target == r.source + "son" for r in rows if r.kind in ("synthetic", "orphan", "name"))
    literals = {r.o.strip() for r in data.triples.where("o_kind = 'lit'").collect()}
    orphans = [r for r in rows if r.kind == "orphan"]
    assert {r.source for r in orphans} <= literals and max(Counter(r.token for r in orphans).values()) <= 100
    assert 0.1 < kinds["synthetic"] / sum(aligned.values()) * 3 < 0.5
    assert sorted(map(tuple, rows)) == sorted(map(tuple, A.mixup_rows(data, lambda v, k: F.concat(v, F.lit("son"))).collect()))


def test_retries_keep_the_best():
    from twinweave.operators.selection import improve_until

    made = [0.4, 0.7, 0.55, 0.9]
    assert improve_until(lambda i: made[i], lambda x: x, 0.5, 0.1, 4) == (0.7, 0.7, 2)
    assert improve_until(lambda i: made[i], lambda x: x, 0.8, 0.2, 3) == (0.7, 0.7, 3)
    assert improve_until(lambda i: made[i], lambda x: x, 0.0, attempts=0) == (None, None, 0)
