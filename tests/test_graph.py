import random

import pytest
from lodeweave.operators import graph as G
from lodeweave.operators.components import connected_components

EDGE = "src string, dst string, relation string, count bigint, confidence double, weight double, stage string, sources array<string>"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, r, c, 0.5, w, "deterministic", []) for a, b, r, c, w in rows], EDGE)


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    df = spark.createDataFrame(pairs + pairs[:3] + [(None, 1)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == brute_components(pairs)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def kruskal(rows):
    chosen, parent = set(), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, r, c, w in sorted((x for x in rows if x[2] == "calls" and x[0] != x[1]), key=lambda x: (-x[4], -x[3], x[0], x[1])):
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            chosen.add((a, b))
    return chosen


def test_spanning_forest_is_kruskals(spark):
    rng = random.Random(3)
    rows = {}
    for _ in range(60):
        a, b = f"n{rng.randrange(20):02}", f"n{rng.randrange(20):02}"
        rows[a, b] = (a, b, "calls", rng.randrange(1, 4), rng.randrange(1, 5) / 4)
    rows = list(rows.values())
    got = {(r.src, r.dst) for r in G.spanning_forest(edges(spark, rows)).collect()}
    assert got == kruskal(rows)


def test_budget_holds_and_edges_are_distinct(spark):
    rng = random.Random(4)
    rows = {}
    for _ in range(80):
        a, b, r = f"function:c{rng.randrange(3)}:f{rng.randrange(9)}", f"register:X:r{rng.randrange(6)}", rng.choice(["reads", "writes"])
        rows[a, b, r] = (a, b, r, 1, rng.random())
        c, d = f"function:c{rng.randrange(3)}:f{rng.randrange(9)}", f"function:c{rng.randrange(3)}:f{rng.randrange(9)}"
        rows[c, d, "calls"] = (c, d, "calls", 1, rng.random())
    for budget in (1, 7, 30):
        got = [(r.src, r.dst, r.relation) for r in G.budgeted(edges(spark, list(rows.values())), budget).collect()]
        assert len(got) == budget == len(set(got))


def test_expansion_by_hand(spark):
    e = edges(spark, [("a", "b", "calls", 1, 1.0), ("c", "b", "calls", 1, 1.0), ("c", "d", "calls", 1, 1.0), ("x", "y", "calls", 1, 1.0)])
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.hop for r in G.expand(e, seeds, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert {(r.src, r.dst) for r in G.induced_edges(e, G.expand(e, seeds, 2)).collect()} == {("a", "b"), ("c", "b")}
