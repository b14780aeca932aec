"""Data model: triples, alignment and attribute matches as DataFrames, and a pair of graphs derived from the star schema."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLES = "kg int, s string, p string, o string, o_kind string"
ALIGNMENT = "e1 string, e2 string"


@dataclass(frozen=True)
class Dataset:
    """Two graphs (``triples`` by kg 1 and 2), aligned pairs, matched attributes and predicate names."""

    triples: DataFrame
    alignment: DataFrame
    attr_match: DataFrame
    attr_names: DataFrame | None = None
    fixed_test: DataFrame | None = None

    def graph(self, kg: int) -> DataFrame:
        return self.triples.where(F.col("kg") == kg)

    def with_(self, **changes: DataFrame) -> Dataset:
        return replace(self, **changes)


def _t(kg: int, df: DataFrame, s, p: str, o, kind: str) -> DataFrame:
    return df.select(F.lit(kg).alias("kg"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))


def _uri(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def derived(spark: SparkSession, sf_dir: str) -> Dataset:
    """Graph 1: customers, nations, regions. Graph 2: a perturbed copy of four customers in five."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    c, n = _uri("c:", "c_custkey"), _uri("n:", "c_nationkey")
    copy = customer.where("c_custkey % 5 <> 0")
    x, y = _uri("x:", "c_custkey"), _uri("y:", "c_nationkey")
    parts = [
        _t(1, customer, c, "ont/name", F.col("c_name"), "lit"),
        _t(1, customer, c, "ont/segment", F.col("c_mktsegment"), "lit"),
        _t(1, customer, c, "ont/balance", F.round("c_acctbal").cast("long").cast("string"), "lit"),
        _t(1, customer, c, "ont/inNation", n, "uri"),
        _t(1, nation, _uri("n:", "n_nationkey"), "ont/inRegion", _uri("r:", "n_regionkey"), "uri"),
        _t(2, copy, x, "voc#label", F.lower(F.translate("c_name", "#", " ")), "lit"),
        _t(2, copy.where("c_custkey % 7 <> 0"), x, "voc#market", F.lower("c_mktsegment"), "lit"),
        _t(2, copy, x, "voc#locatedIn", y, "uri"),
    ]
    triples = parts[0]
    for part in parts[1:]:
        triples = triples.unionByName(part)
    alignment = copy.select(c.alias("e1"), x.alias("e2"))
    match = spark.createDataFrame([("ont/name", "voc#label"), ("ont/segment", "voc#market")], "p1 string, p2 string")
    names = spark.createDataFrame([(1, "ont/name", "name"), (1, "ont/segment", "market segment"), (2, "voc#label", "label")], "kg int, p string, label string")
    return Dataset(triples, alignment, match, names)


def augmented(data: Dataset) -> Dataset:
    """Adds a copy ``<uri>_aug1`` of the aligned pairs whose number ends in 3, with their triples."""
    pairs = data.alignment.where(F.substring("e1", -1, 1) == "3")
    twin = lambda c: F.concat(F.col(c), F.lit("_aug1"))
    seeds = pairs.select(F.col("e1").alias("s")).unionByName(pairs.select(F.col("e2").alias("s")))
    more = data.triples.join(seeds, "s", "left_semi").select("kg", twin("s").alias("s"), "p", "o", "o_kind")
    return data.with_(triples=data.triples.unionByName(more), alignment=data.alignment.unionByName(pairs.select(twin("e1").alias("e1"), twin("e2").alias("e2"))))


#: The same derivation for DuckDB, as common table expressions.
SQL = """
triples AS (
  SELECT 1 AS kg, 'c:' || c_custkey AS s, 'ont/name' AS p, c_name AS o, 'lit' AS o_kind FROM customer
  UNION ALL SELECT 1, 'c:' || c_custkey, 'ont/segment', c_mktsegment, 'lit' FROM customer
  UNION ALL SELECT 1, 'c:' || c_custkey, 'ont/balance', CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR), 'lit' FROM customer
  UNION ALL SELECT 1, 'c:' || c_custkey, 'ont/inNation', 'n:' || c_nationkey, 'uri' FROM customer
  UNION ALL SELECT 1, 'n:' || n_nationkey, 'ont/inRegion', 'r:' || n_regionkey, 'uri' FROM nation
  UNION ALL SELECT 2, 'x:' || c_custkey, 'voc#label', lower(translate(c_name, '#', ' ')), 'lit' FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT 2, 'x:' || c_custkey, 'voc#market', lower(c_mktsegment), 'lit' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0
  UNION ALL SELECT 2, 'x:' || c_custkey, 'voc#locatedIn', 'y:' || c_nationkey, 'uri' FROM customer WHERE c_custkey % 5 <> 0),
alignment AS (SELECT 'c:' || c_custkey AS e1, 'x:' || c_custkey AS e2 FROM customer WHERE c_custkey % 5 <> 0),
attr_match(p1, p2) AS (VALUES ('ont/name', 'voc#label'), ('ont/segment', 'voc#market')),
attr_names(kg, p, label) AS (VALUES (1, 'ont/name', 'name'), (1, 'ont/segment', 'market segment'), (2, 'voc#label', 'label')),
aug_pairs AS (SELECT * FROM alignment WHERE right(e1, 1) = '3'),
aug_alignment AS (SELECT e1, e2 FROM alignment UNION ALL SELECT e1 || '_aug1', e2 || '_aug1' FROM aug_pairs),
aug_triples AS (SELECT * FROM triples UNION ALL SELECT kg, s || '_aug1', p, o, o_kind FROM triples WHERE s IN (SELECT e1 FROM aug_pairs UNION SELECT e2 FROM aug_pairs)),
edges AS (SELECT kg, s AS node, p, o AS other, 'out' AS direction FROM triples WHERE o_kind = 'uri' UNION ALL SELECT kg, o, p, s, 'in' FROM triples WHERE o_kind = 'uri')
"""
