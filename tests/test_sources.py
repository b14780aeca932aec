import json

import pytest
from pyspark.sql import functions as F

from twinweave.plans.kg import augmented, derived
from twinweave.plans.registry import AUGMENTERS, READERS, REDUCERS, WRITERS, Registry, autoload
from twinweave.sources import files
from twinweave.streaming import ingest


autoload()


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("form", ["openea", "bert_int", "rdf"])
def test_round_trip(spark, sf_dir, tmp_path, form):
    data = derived(spark, sf_dir)
    WRITERS.get(form)(data, f"file://{tmp_path}/d")
    again = READERS.get(form)(spark, f"file://{tmp_path}/d")
    assert rows(again.triples) == rows(data.triples.distinct())
    assert rows(again.alignment) == rows(data.alignment)
    if form != "rdf":
        assert rows(again.attr_match) == rows(data.attr_match)


def test_layout_details(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    (d / "match").write_text("# note\na,b\tc, d\nbroken\n")
    assert rows(files.read_attr_match(spark, f"file://{d}/match")) == [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]
    (d / "names").write_text("http://x/pop \t \nhttp://x/name\t full name \n")
    assert rows(files.read_attr_names(spark, f"file://{d}/names", 1)) == [(1, "full name", "http://x/name"), (1, "pop", "http://x/pop")]
    (d / "a.nt").write_text('<a> <p> <b> .\n# c\n<a> <q> "x \\"y\\"\\n"@en .\n<a> <q> "5"^^<int> .\nbad\n')
    assert rows(files.read_ntriples(spark, f"file://{d}/a.nt", 2)) == sorted([(2, "b", "uri", "p", "a"), (2, 'x "y"\n', "lit", "q", "a"), (2, "5", "lit", "q", "a")], key=repr)
    (d / "vec").write_text("2 2\nking 0.5 -1\nbad x y\n")
    assert rows(files.read_word_vectors(spark, f"file://{d}/vec")) == [([0.5, -1.0], "king")]
    (d / "attrs").write_text('<http://e/1>\t<http://p/name>\t"Bob"@en .\nshort\tline\n')
    assert rows(files.read_attribute_lines(spark, f"file://{d}/attrs")) == [("Bob", "name", "http://e/1")]


def test_json_and_metadata(spark, tmp_path):
    run = tmp_path / "exp" / "run1"
    run.mkdir(parents=True)
    (run / "results.json").write_text(json.dumps({"m": {"hits@1": 0.5, "note": "x", "mr": 3}}))
    assert [r[1:] for r in rows(files.read_results(spark, f"file://{tmp_path}/exp/*/results.json").select("metric", "path", "value").drop("path"))] == [(0.5,), (3.0,)]
    assert files.file_times(spark, f"file://{tmp_path}/exp/*/*").first().seconds == 0
    expected = spark.createDataFrame([("run1/results.json",), ("run2/results.json",)], "path string")
    assert rows(files.missing_files(expected, spark, f"file://{tmp_path}/exp/*/*")) == [("run2/results.json",)]
    roles = spark.createDataFrame([("a", "b", "pool"), ("c", "d", "test")], "e1 string, e2 string, role string")
    files.write_supervision(roles, f"file://{tmp_path}/roles", 7)
    assert rows(files.read_supervision(spark, f"file://{tmp_path}/roles")) == rows(roles)
    files.write_supervision(roles.unionByName(roles.withColumn("role", F.lit("test"))), f"file://{tmp_path}/bad", 7)
    with pytest.raises(ValueError):
        files.read_supervision(spark, f"file://{tmp_path}/bad")
    files.write_pairs_json(roles, f"file://{tmp_path}/fixed", {"seed": 1})
    assert rows(files.read_fixed_test(spark, f"file://{tmp_path}/fixed")) == [("a", "b"), ("c", "d")]
    for form in ("csv", "tsv", "md"):
        files.write_table(roles, f"file://{tmp_path}/t_{form}", form)
        assert spark.read.text(f"file://{tmp_path}/t_{form}").count() == (4 if form == "md" else 2 + spark.read.text(f"file://{tmp_path}/t_{form}").where("value like 'e1%'").count())


def test_registries():
    assert REDUCERS.list() == ["alignment_only", "forget_labels", "random_entities", "stub"]
    assert AUGMENTERS.list() == ["eda", "plm", "stub"] and READERS.list() == ["bert_int", "openea", "rdf"]
    own = Registry("thing")
    own.register("x")(len)
    assert own.get("x") is len
    with pytest.raises(ValueError):
        own.add("x", len)
    with pytest.raises(KeyError):
        own.get("y")


def test_augmentation_is_additive_and_stable(spark, sf_dir):
    data = derived(spark, sf_dir)
    grown = AUGMENTERS.get("plm")(data, 0.1)
    assert grown.alignment.count() == data.alignment.count() + -(-data.alignment.count() // 10)
    assert rows(grown.triples) == rows(AUGMENTERS.get("plm")(data, 0.1).triples)
    assert data.triples.distinct().subtract(grown.triples).isEmpty()
    eda = AUGMENTERS.get("eda")(data, 0.1)
    assert eda.alignment.count() == data.alignment.count() + data.alignment.count() // 10
    assert augmented(data).alignment.count() > data.alignment.count()


def test_streaming(spark, tmp_path):
    schema = "ts timestamp, kg int, s string, p string, o string, o_kind string"
    batch = spark.createDataFrame([(1, "a", "p", "b", "uri"), (1, "a", "p", "b", "uri"), (2, "c", "q", "v", "lit")], "kg int, s string, p string, o string, o_kind string").withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:01:00")))
    batch.select("ts", "kg", "s", "p", "o", "o_kind").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    for name, df, mode in (("once", ingest.stream_triples(stream), "append"), ("stats", ingest.windowed_statistics(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.sql("select * from once").count() == 2
    assert rows(spark.sql("select kg, triples, relations from stats")) == [(1, 2, 2), (2, 0, 1)]


def test_latex_table(spark, tmp_path):
    from twinweave.sources.files import write_table

    write_table(spark.createDataFrame([("a_b", 1.5), ("50 % & more", None)], "name_x string, v double").coalesce(1), f"{tmp_path}/t", "tex")
    lines = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert lines == ["\\begin{tabular}{ll}", "\\toprule", "name\\_x & v \\\\", "\\midrule", "a\\_b & 1.5 \\\\", "50 \\% \\& more &  \\\\", "\\bottomrule", "\\end{tabular}"]


def test_stage_times(spark, tmp_path):
    """The result ends a stage, the first file begins it, and a copied stage takes no time."""
    import os

    for folder, times in {"a": {"log": 100, "results.json": 160, "late": 400}, "b": {"x": 50, "y": 70}, "c": {"results.json": 10, "other": 90}}.items():
        (tmp_path / folder).mkdir()
        for name, at in times.items():
            (tmp_path / folder / name).write_text("x")
            os.utime(tmp_path / folder / name, (at, at))
    got = {r.folder.rsplit("/", 1)[1]: (r.start.timestamp(), r.end.timestamp(), r.seconds) for r in files.stage_times(spark, f"file://{tmp_path}/*/*").collect()}
    assert got == {"a": (100, 160, 60), "b": (50, 70, 20), "c": (10, 10, 0)}
    plan = files.stage_times(spark, f"file://{tmp_path}/*/*")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_re_encode(spark, tmp_path):
    """Relations of the second graph follow the first's; what has no number is left out."""
    d = tmp_path / "in"
    d.mkdir()
    for name, text in {"ent_ids_1": "0\tA\n1\tB\nbad\n", "ent_ids_2": "2\ta\n3\tB\n", "rel_ids_1": "0\tr\n4\ts\n", "rel_ids_2": "0\tr\n1\tt\n", "triples_1": "A\tr\tB\nA\ts\tA\nA\tx\tB\n", "triples_2": "a\tt\ta\na\tr\tB\nZ\tt\ta\n", "sup_pairs": "0\t2\n"}.items():
        (d / name).write_text(text)
    files.re_encode(spark, f"file://{d}", f"file://{tmp_path}/out")
    lines = lambda name: sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out/{name}").collect())
    assert lines("triples_1") == ["0 0 3", "0 4 0"] and lines("triples_2") == ["2 5 3", "2 6 2"] and lines("sup_pairs") == ["0 2"]
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/out/vocab.txt").collect()] == ["0\tA", "2\ta", "3\tB", "4\ts", "5\tr", "6\tt"]


def test_friendly_names(spark):
    from twinweave.functions import text as X

    cases = [("http://dbpedia.org/resource/A_b/c", "EN_JA_15K", "A b/c"), ("http://ja.dbpedia.org/resource/x_y", "EN_JA_15K", "x y"), ("http://z/Q_1", "D_W_15K", "http://z/Q 1"), ("http://www.wikidata.org/entity/Q1", "D_W_15K", "Q1"), ("a/dbp:Z_z", "bbc", "Z z"), ("a/b_c", "bbc", "b c"), ("http://yago/A_b", "D_Y", "http://yago/A b"), ("http://x/y_z", "other", "y z")]
    row = spark.range(1).select(*[X.friendly_name(F.lit(u), d).alias(f"c{i}") for i, (u, d, _) in enumerate(cases)]).first()
    assert list(row) == [w for *_, w in cases]
