"""Connected components: nodes hook to their least neighbour, pointers jump to their roots, edges are renamed, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import lookup_join, materialise


def _named(rows: DataFrame, key: str, by: str, names: DataFrame, name: str, into: str) -> DataFrame:
    """``rows`` with ``into``, the ``name`` of their ``key`` in ``names`` (node, name), or the key itself. ``names`` has one row a
    node, so only ``rows`` can be skewed, and its keys are counted first."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = often.join(names.select(F.col("node").alias(key), F.col(name).alias(into)), key, "left").withColumn(into, F.coalesce(into, key))
    known = materialise(known, "names")
    return lookup_join(rows, known, key, "_n", by).drop("_n")


def _jumped(parents: DataFrame) -> tuple[DataFrame, bool]:
    """Each node's parent's parent, and whether any pointer moved."""
    up = _named(parents, "root", "node", parents, "root", "above")
    moved = materialise(up.select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jumps")
    return moved.select("node", "root"), not moved.where("moved").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); root is the least node of the component.

    Hooking leaves at most half of the nodes in each round, and jumping halves the depth of the trees in each step, so a
    chain of any order ends in a logarithmic number of steps. Each step is written to the shared folder. A root or a node
    that very many rows name is dealt to many tasks. Null ends are not edges; an empty table gives an empty table.
    """
    current = edges.where("a <> b").select("a", "b")
    found = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "parents")
        again = True
        while again:
            parents, again = _jumped(parents)
        if found is None:
            found = parents
        else:
            found = materialise(_named(found, "root", "node", parents, "root", "next").select("node", F.col("next").alias("root")), "roots")
        renamed = _named(_named(current, "a", "b", parents, "root", "pa"), "b", "a", parents, "root", "pb").where("pa <> pb")
        current = materialise(renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if current.isEmpty():
            return found
