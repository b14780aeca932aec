import os

from pyspark.sql import functions as F

from twinweave.operators import dictionary as D
from twinweave.plans import catalog
from twinweave.plans.kg import derived


def test_front_coding(spark):
    names = ["", "a", "ab", "abc", "abd", "b", "é", "éa", "𝒳y", "𝒳z", None, "ab"]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(3)
    coded = D.front_coded(df, "n", 4)
    rows = {r.id: (r.block, r.shared, r.rest) for r in coded.collect()}
    want, before = {}, ""
    for i, n in enumerate(sorted({n for n in names if n is not None}, key=lambda s: s.encode())):
        k = 0 if i % 4 == 0 else len(os.path.commonprefix([n, before]))
        want[i], before = (i // 4, k, n[k:]), n
    assert rows == want
    assert {r.n for r in D.decoded(coded, "n").collect()} == {n for n in names if n is not None}


def test_dictionary_of_entities(spark, sf_dir):
    """It is shorter than the names, and gives them back under the ids of the sorted dictionary."""
    names = derived(spark, sf_dir).triples.select(F.col("s").alias("entity"))
    coded = D.front_coded(names, "entity")
    kept, whole = coded.agg(F.sum(F.length("rest"))).first()[0], names.distinct().agg(F.sum(F.length("entity"))).first()[0]
    assert kept < 0.6 * whole
    want = {(r.entity, r.id) for r in catalog.queries()["dictionary_sorted"](spark, sf_dir).collect()}
    assert {(r.entity, r.id) for r in D.decoded(coded, "entity").collect()} == want
    assert catalog.queries()["dictionary_front_coded"](spark, sf_dir).count() == len(want)
