"""Shape constraints over literals: one violation row for each break, never an abort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators.relational import attribute_triples
from twinweave.plans.kg import Dataset


@dataclass(frozen=True)
class Constraint:
    """``kind``: minCount, minLength, maxLength, datatype (a pattern) or or (alternative predicates)."""

    path: str
    kind: str
    value: object
    severity: str = "Violation"


class ShapeError(ValueError):
    """Raised by the reject strategy."""


def violations(triples: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """graph, focus, path, value, constraint, severity."""
    literals = attribute_triples(triples)
    focus = triples.select("kg", "s").distinct()
    parts = []
    for c in constraints:
        rows = literals.where(F.col("p") == c.path)
        if c.kind == "minCount":
            counts = rows.groupBy("kg", "s").agg(F.count(F.lit(1)).alias("n"))
            bad = focus.join(counts, ["kg", "s"], "left").where(F.coalesce("n", F.lit(0)) < c.value).withColumn("o", F.lit(None).cast("string"))
        elif c.kind == "or":
            held = literals.where(F.col("p").isin([c.path, *c.value])).select("kg", "s").distinct()
            bad = focus.join(held, ["kg", "s"], "left_anti").withColumn("o", F.lit(None).cast("string"))
        else:
            test = {"minLength": lambda v: F.length("o") < v, "maxLength": lambda v: F.length("o") > v, "datatype": lambda v: ~F.col("o").rlike(v)}[c.kind]
            bad = rows.where(test(c.value))
        parts.append(bad.select(F.col("kg").alias("graph"), F.col("s").alias("focus"), F.lit(c.path).alias("path"), F.col("o").alias("value"), F.lit(c.kind).alias("constraint"), F.lit(c.severity).alias("severity")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(found: DataFrame) -> DataFrame:
    """graph, severity, n."""
    return found.groupBy("graph", "severity").agg(F.count(F.lit(1)).alias("n"))


def conformance(triples: DataFrame, found: DataFrame) -> DataFrame:
    """graph, n and whether the graph conforms."""
    graphs = triples.select(F.col("kg").alias("graph")).distinct()
    counts = found.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    return graphs.join(counts, "graph", "left").select("graph", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("conforms"))


def remove(triples: DataFrame, found: DataFrame, kinds: tuple[str, ...] = ("minLength", "maxLength", "datatype")) -> DataFrame:
    """Triples without those that a violation names exactly."""
    named = found.where(F.col("constraint").isin(list(kinds)) & F.col("value").isNotNull()).select(F.col("graph").alias("kg"), F.col("focus").alias("s"), F.col("path").alias("p"), F.col("value").alias("o")).distinct()
    return triples.join(named, ["kg", "s", "p", "o"], "left_anti").select(triples.columns)


def apply_strategy(data: Dataset, constraints: list[Constraint], strategy: str = "ignore", fixers: dict | None = None) -> tuple[Dataset, DataFrame]:
    """ignore, reject (raises), remove, or fix: custom fixers by kind, and too short values go."""
    found = violations(data.triples, constraints)
    if strategy == "reject" and not found.isEmpty():
        raise ShapeError(f"{found.count()} violations")
    if strategy == "remove":
        return data.with_(triples=remove(data.triples, found)), found
    if strategy == "fix":
        triples = remove(data.triples, found, ("minLength",))
        for kind, fixer in (fixers or {}).items():
            triples = fixer(triples, found.where(F.col("constraint") == kind))
        return data.with_(triples=triples), found
    return data, found
