"""The frontier of augmentation over two kinds of nodes: fused pairs of the alignment, and entities outside it.

Pairs are expanded, at most ``budget`` of them; entities outside get a twin when a pair or another such entity leads to
them. Rounds run over one stored adjacency and one table of visited nodes, so a node is entered once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.operators.relational import edges
from twinweave.plans.kg import Dataset
from twinweave.plans.ranks import top_by_hash
from twinweave.plans.storage import cut

SET, PLAIN = "set", "plain"


def fused_adjacency(data: Dataset) -> tuple[DataFrame, DataFrame]:
    """(node, kind) of both graphs and (a, a_kind, b, b_kind), each tie seen from both ends; members of a pair are its fused
    node, other entities are nodes by their name, also where both graphs have them."""
    pairs = data.alignment.select("e1", "e2").withColumn("node", X.set_uri(F.col("e1"), F.col("e2")))
    ends = pairs.select(F.lit(1).alias("kg"), F.col("e1").alias("e"), "node").unionByName(pairs.select(F.lit(2).alias("kg"), F.col("e2").alias("e"), "node"))
    ties = edges(data.triples).select("kg", "node", "other").distinct()
    for side, name in (("node", "a"), ("other", "b")):
        ties = ties.join(ends.toDF("kg", side, f"_{name}"), ["kg", side], "left")
        ties = ties.withColumn(name, F.coalesce(f"_{name}", side)).withColumn(f"{name}_kind", F.when(F.col(f"_{name}").isNotNull(), SET).otherwise(PLAIN))
    links = ties.where("a <> b").select("a", "a_kind", "b", "b_kind").distinct()
    return pairs.select("node").distinct(), links


def expansion_frontier(data: Dataset, budget: int, depth: int, seed: int = 42) -> DataFrame:
    """node, kind, depth, turn: the pairs that are expanded, at most ``budget``, and the entities outside that get a twin.

    Seeds are a quarter of the budget, first in hash order, at depth 0. In each round, nodes reached for the first time in
    the round before lead on. From a pair at depth d: pairs next to it, at d + 1 up to ``depth``; every entity outside next
    to it, which leads on itself only if d + 1 < ``depth``; and where d + 2 <= ``depth``, pairs on the other side of such an
    entity, which start anew at depth 0. From an entity outside at depth d, both kinds at d + 1, if that is below ``depth``.
    A node reached more than once in a round takes the least depth. When a round reaches more pairs than the budget has
    left, hash order decides and no round follows; when it reaches nothing, the next quarter of the budget of unvisited
    pairs are seeds. Depth is null for an entity outside that has a twin but leads nowhere.
    """
    nodes, links = fused_adjacency(data)
    nodes, links = cut(nodes), cut(links)
    some = max(1, budget // 4)
    first = lambda rows, n: top_by_hash(rows.select("node"), n, seed, ["node"])
    found = first(nodes, min(some, budget)).withColumns({"kind": F.lit(SET), "depth": F.lit(0)})
    visited, taken, turn = None, 0, 0
    while True:
        fresh = cut(found.withColumn("turn", F.lit(turn)).select("node", "kind", F.col("depth").cast("int").alias("depth"), "turn"))
        pairs, rows = fresh.agg(F.count(F.when(F.col("kind") == SET, 1)), F.count(F.lit(1))).first()
        if taken + pairs > budget:
            kept = first(fresh.where(F.col("kind") == SET), budget - taken)
            fresh = cut(fresh.join(kept.select("node"), "node", "left_semi").unionByName(fresh.where(F.col("kind") == PLAIN)))
            pairs = budget - taken
        visited, taken, turn = (fresh if visited is None else cut(visited.unionByName(fresh))), taken + pairs, turn + 1
        if taken >= budget:
            return visited
        if not rows:
            found = first(nodes.join(visited.select("node"), "node", "left_anti"), min(some, budget - taken)).withColumns({"kind": F.lit(SET), "depth": F.lit(0)})
            if found.isEmpty():
                return visited
            continue
        step = links.join(fresh.where("depth is not null").select(F.col("node").alias("a"), "depth"), "a")
        near = step.where(((F.col("a_kind") == SET) & ((F.col("b_kind") == PLAIN) | (F.col("depth") < depth))) | ((F.col("a_kind") == PLAIN) & (F.col("depth") + 1 < depth)))
        leads = (F.col("b_kind") == SET) | (F.col("depth") + 1 < depth)
        near = near.select(F.col("b").alias("node"), F.col("b_kind").alias("kind"), F.when(leads, F.col("depth") + 1).alias("depth"))
        across = step.where((F.col("a_kind") == SET) & (F.col("b_kind") == PLAIN) & (F.col("depth") + 2 <= depth)).select(F.col("b").alias("a")).distinct()
        bridged = links.where((F.col("a_kind") == PLAIN) & (F.col("b_kind") == SET)).join(across, "a", "left_semi").select(F.col("b").alias("node"), F.lit(SET).alias("kind"), F.lit(0).alias("depth"))
        found = near.unionByName(bridged).groupBy("node", "kind").agg(F.min("depth").alias("depth")).join(visited.select("node"), "node", "left_anti")


def expanded_nodes(data: Dataset, budget: int, depth: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The expanded pairs (e1, e2) and the outside entities with a twin (e)."""
    visited = expansion_frontier(data, budget, depth, seed)
    pairs = data.alignment.select("e1", "e2").withColumn("node", X.set_uri(F.col("e1"), F.col("e2")))
    chosen = pairs.join(visited.where(F.col("kind") == SET).select("node"), "node", "left_semi").select("e1", "e2")
    return chosen, visited.where(F.col("kind") == PLAIN).select(F.col("node").alias("e"))

