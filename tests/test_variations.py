"""Each strategy by example, and the choice among them over all values."""

import pytest
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.functions import variations as V
from twinweave.plans import catalog


def values_of(spark, f, value, count=40):
    rows = spark.range(count).select(f(F.lit(value), F.col("id")).alias("v"))
    return {r.v for r in rows.collect()}


@pytest.mark.parametrize("f,value,want", [
    (V.flipped, "Yes", {"no", "Yes"}), (V.flipped, "maybe", {"maybe"}),
    (V.other_date, "2010-09-05", {"5 Sep 2010", "05/09/2010", "09/05/2010", "20100905"}), (V.other_date, "2010-13-05", {None}),
    (V.other_digits, "1299", {"2199", "1929"}), (V.other_digits, "777", {"778"}), (V.other_digits, "x9", {"x0"}), (V.other_digits, "none", {None}),
    (V.turned_code, "AB12", {"B12A", "12AB", "2AB1"}),
    (V.doubled, "banana", {"bannana"}), (V.other_vowel, "smith", {"smoth", "smuth", "smath", "smeth"}), (V.other_vowel, "fly", {"fly"}),
    (V.other_spelling, "philip", {"filip"}), (V.other_spelling, "jack", {"jak"}), (V.other_spelling, "Anna", {"Anna"}),
    (V.other_ending, "Anna", {"Annae", "Annao", "Annas", "Annaer"}), (V.swapped_letters, "john", {"jhon"}),
])
def test_strategies_by_example(spark, f, value, want):
    assert values_of(spark, f, value) == want


def test_months_move(spark):
    got = values_of(spark, V.other_month, "5 September 2010", 200)
    assert all(g.startswith("5 ") and "Sep" not in g and 2007 <= int(g[-4:]) <= 2013 and g[-4:] != "2010" for g in got)
    assert len({g.split()[1] for g in got}) == 11 and values_of(spark, V.other_month, "september") == {None}


def test_word_lists(spark):
    words, key = F.array(F.lit("glen"), F.lit("buxton")), F.lit("k")
    row = spark.range(1).select(V.abbreviated(words, key).alias("a"), V.turned(words, key).alias("t"), V.expanded(words, key).alias("e"), V.combined(words, key).alias("c"), V.mixed(words, F.lit("mary ann jones")).alias("m"), V.mixed(words, F.lit("")).alias("n")).first()
    assert sum(w in ("g.", "b.") for w in row.a) == 1 and len(row.t) == 2 and row.t[0][0] == "b"
    assert row.e[1:] == ["the", "buxton"] and len(row.c) == 2 and row.m == ["glen", "ann", "jones"] and row.n == ["glen"]


def test_long_texts_are_rearranged(spark):
    got = values_of(spark, V.long_variation, "a b c d e")
    assert got == {"a b e d c", "a b c d", "c d e a b"}


def test_creative_over_all_values(spark, sf_dir):
    rows = catalog.queries()["creative_strategies"](spark, sf_dir)
    first, again = (sorted(map(tuple, rows.collect())) for _ in range(2))
    assert first == again and len(first) > 100
    changed = [r for r in first if r[1].lower() != r[2].lower()]
    assert len(changed) > 0.9 * len(first)
    kinds = {r.kind: r.n for r in rows.groupBy(X.content_type(F.col("o")).alias("kind")).agg(F.count("*").alias("n")).collect()}
    assert len(kinds) > 1


def test_creative_on_odd_values(spark):
    rows = [(None,), ("",), ("x",), ("  ",), ("true",), ("2010-09-05",), ("é日",), ("New York",), ("a" * 5000,), ("?!",)]
    df = spark.createDataFrame(rows, "v string")
    got = {r.v: r.w for r in df.select("v", V.creative(F.col("v"), F.coalesce("v", F.lit("")), F.lit("Los Angeles")).alias("w")).collect()}
    assert got[None] is None and got[""] == "" and got["x"] == "x" and got["true"] in ("true", "false") and got["2010-09-05"] != "2010-09-05"
    assert all(isinstance(w, str) for v, w in got.items() if v is not None) and got["New York"] != "New York"


def test_implausible_attempts_are_turned_down(spark):
    row = spark.range(1).select(V.plausible(F.lit("xqzt"), F.lit("a")).alias("a"), V.plausible(F.lit("Anna"), F.lit("anna")).alias("b"), V.plausible(F.lit("Jhon Smyth"), F.lit("John Smith")).alias("c")).first()
    assert not row.a and not row.b
    made = spark.range(300).select(V.creative(F.lit("glen buxton"), F.col("id").cast("string")).alias("v")).distinct().collect()
    assert len(made) > 20 and all(r.v.lower() == "glen buxton" or spark.range(1).select(V.plausible(F.lit(r.v), F.lit("glen buxton")).alias("p")).first().p for r in made[:5])
