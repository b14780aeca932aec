"""The augmenter over both kinds of nodes, held against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_queries import small_dataset
from twinweave.operators import augment as A
from twinweave.operators import frontier as N
from twinweave.operators.relational import edges
from twinweave.plans import catalog
from twinweave.plans.kg import derived


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def frontier_by_hand(triples, aligned, budget, depth, seed=42):
    """node to (kind, depth, turn)."""
    name = {(1, a): f"set:{a}|{b}" for a, b in aligned} | {(2, b): f"set:{a}|{b}" for a, b in aligned}
    sets = sorted(set(name.values()))
    ties = {}
    for kg, s, _, o, kind in triples:
        if kind == "uri":
            a, b = name.get((kg, s), s), name.get((kg, o), o)
            if a != b:
                ties.setdefault(a, set()).add(b)
                ties.setdefault(b, set()).add(a)
    is_set = set(sets).__contains__
    order = lambda nodes: sorted(nodes, key=lambda x: (md5(f"{seed}|{x}"), x))
    visited, turn, taken, some = {}, 0, 0, max(1, budget // 4)
    found = {x: 0 for x in order(sets)[: min(some, budget)]}
    while True:
        pairs = [x for x in found if is_set(x)]
        if taken + len(pairs) > budget:
            pairs = order(pairs)[: budget - taken]
            found = {x: d for x, d in found.items() if x in pairs or not is_set(x)}
        visited |= {x: ("set" if is_set(x) else "plain", d, turn) for x, d in found.items()}
        taken, turn = taken + len(pairs), turn + 1
        if taken >= budget:
            return visited
        if not found:
            rest = [x for x in sets if x not in visited]
            if not rest:
                return visited
            found = {x: 0 for x in order(rest)[: min(some, budget - taken)]}
            continue
        reached = {}

        def reach(x, d, reached=reached):
            old = reached.get(x)
            reached[x] = d if old is None else old if d is None else min(old, d)

        for x, d in found.items():
            if d is None:
                continue
            for y in ties.get(x, ()):
                if is_set(x):
                    if is_set(y):
                        if d < depth:
                            reach(y, d + 1)
                    else:
                        reach(y, d + 1 if d + 1 < depth else None)
                        if d + 2 <= depth:
                            for z in ties[y]:
                                if is_set(z):
                                    reach(z, 0)
                elif d + 1 < depth:
                    reach(y, d + 1)
        found = {x: d for x, d in reached.items() if x not in visited}


def random_graph(seed):
    rng = random.Random(seed)
    aligned = [(f"a{i}", f"b{i}") for i in range(40)]
    triples = []
    for _ in range(45):
        kg = rng.choice([1, 2])
        pick = lambda kg=kg: rng.choice([f"{'ab'[kg - 1]}{rng.randrange(40)}", f"h{rng.randrange(12)}"])
        triples.append((kg, pick(), "r", pick(), "uri"))
    return triples, aligned


@pytest.mark.parametrize("budget,depth", [(30, 2), (40, 3), (9, 1), (17, 4)])
def test_frontier_by_hand(spark, budget, depth):
    triples, aligned = random_graph(budget)
    got = {r.node: (r.kind, r.depth, r.turn) for r in N.expansion_frontier(small_dataset(spark, triples, aligned), budget, depth).collect()}
    want = frontier_by_hand(triples, aligned, budget, depth)
    assert got == want
    assert sum(k == "set" for k, _, _ in got.values()) == budget and any(k == "plain" for k, _, _ in got.values())


def test_frontier_of_derived_graphs(spark, sf_dir):
    data = derived(spark, sf_dir)
    triples, aligned = [tuple(r) for r in data.triples.collect()], [tuple(r) for r in data.alignment.collect()]
    got = {r.node: (r.kind, r.depth, r.turn) for r in catalog.queries()["augment_frontier"](spark, sf_dir).collect()}
    assert got == frontier_by_hand(triples, aligned, math.ceil(0.2 * len(aligned)), 2)


def test_augment_connects_twins(spark):
    """A pair, its neighbour pair, a hub outside both graphs' alignment and one behind it."""
    triples = [(1, "A", "r", "B", "uri"), (1, "B", "r", "h", "uri"), (1, "h", "deep", "k", "uri"), (1, "h", "name", "hub", "lit"), (2, "a", "s", "h", "uri"), (1, "A", "name", "alpha", "lit"), (1, "k", "name", "end", "lit")]
    # A third pair, alone and last in hash order, keeps the budget open until the others have led on.
    c = max((f"C{i}" for i in range(50)), key=lambda x: md5(f"42|set:{x}|x"))
    data = small_dataset(spark, triples, [("A", "a"), ("B", "b"), (c, "x")])
    grown = A.augment(data, 1.0, depth=3, generator=A.keep_value, derived_from="from")
    new = {(r.kg, r.s, r.p, r.o) for r in grown.triples.collect()} - {(k, s, p, o) for k, s, p, o, _ in triples}
    assert {tuple(r) for r in grown.alignment.collect()} == {("A", "a"), ("B", "b"), (c, "x"), ("A_aug1", "a_aug1"), ("B_aug2", "b_aug2"), (f"{c}_aug3", "x_aug3")}
    assert new == {
        (1, "A_aug1", "r", "B_aug2"), (1, "B_aug2", "r", "h_aug1"), (1, "h_aug1", "deep", "k_aug2"), (2, "a_aug1", "s", "h_aug2"),
        (1, "h_aug1", "name", "hub"), (1, "k_aug2", "name", "end"), (1, "A_aug1", "name", "alpha"),
        (1, "A_aug1", "from", "A"), (1, "B_aug2", "from", "B"), (2, "a_aug1", "from", "a"), (2, "b_aug2", "from", "b"), (1, f"{c}_aug3", "from", c), (2, "x_aug3", "from", "x"),
    }
    shallow = A.augment(data, 1.0, depth=1, generator=A.keep_value)
    new = {(r.kg, r.s, r.p, r.o) for r in shallow.triples.collect()}
    assert (1, "B_aug2", "r", "h_aug1") in new and not any("k_aug" in s + o for _, s, _, o in new)


def test_cached_matches_choose_values(spark):
    """A known alignment holds for a pair only if its values bear it out; the best partner wins; the rest vary their own."""
    triples = [(1, "A", "name", "alpha beta", "lit"), (1, "A", "town", "Rome", "lit"), (2, "a", "label", "alpha beta gamma", "lit"), (2, "a", "title", "alpha bet", "lit"), (2, "a", "place", "zzzz", "lit"), (1, "B", "name", "x", "lit")]
    data = small_dataset(spark, triples, [("A", "a"), ("B", "b")])
    known = spark.createDataFrame([("name", "label", 0.9), ("name", "title", 0.8), ("town", "place", 1.0)], "p1 string, p2 string, combined double")
    got = [tuple(r) for r in A.cached_values(data, known).collect()]
    assert got == [("A", "name", "alpha beta", "a", "title", "alpha bet")] or got == [("A", "name", "alpha beta", "a", "label", "alpha beta gamma")]
    expanded = A.expand_pairs(data.alignment)
    every = A.generated_literals(data, expanded, A.keep_value, known).count()
    none = A.generated_literals(data, expanded, A.keep_value, known, unmatched=0.0)
    assert every == 6 and {(r.kg, r.s, r.p) for r in none.collect()} == {(1, "A_aug1", "name"), (2, "a_aug1", got[0][4])}


def test_augment_on_odd_data(spark):
    data = small_dataset(spark, [(1, "A", "r", "A", "uri")], [("A", "a")])
    assert A.augment(data, 0.5, generator=A.keep_value).alignment.count() == 2
    assert edges(data.triples).count() == 2
    none = small_dataset(spark, [(1, "A", "r", "B", "uri")], [("A", "a")])
    none = none.with_(alignment=none.alignment.where(F.lit(False)))
    assert N.expansion_frontier(none, 3, 2).count() == 0
