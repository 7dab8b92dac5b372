"""Shortest routes against a heap whose labels carry their whole routes."""

import heapq
import random

import pytest

from sightline.operators import navigation

LINKS, ASKS = "from_id string, to_id string, link_id string, cost double", "request_id string, start_id string, goal_id string"
EDGES = "edge_id string, from_node_id string, to_node_id string, polyline array<struct<x:double,y:double,z:double>>, walkable boolean"


def by_heap(links, start):
    out = {}
    for a, b, link, cost in links:
        out.setdefault(a, []).append((b, link, cost))
    best, queue = {}, [(0.0, (), start)]
    while queue:
        cost, ids, node = heapq.heappop(queue)
        if node not in best:
            best[node] = (cost, ids)
            for b, link, step in out.get(node, []):
                heapq.heappush(queue, (cost + step, (*ids, link), b))
    return best


def held(spark, links, asks):
    found = navigation.best_routes(spark.createDataFrame(asks, ASKS), spark.createDataFrame(links, LINKS))
    trees = {start: by_heap(links, start) for start in {a[1] for a in asks}}
    want = {r: trees[s][g] for r, s, g in asks if g in trees[s]}
    assert {r["request_id"]: (r["cost"], tuple(r["link_ids"])) for r in found.collect()} == want
    return want


@pytest.mark.parametrize("costs", [(1.0,), (1.0, 2.0, 3.0), (0.1, 0.2, 0.3, 0.7)])
def test_ties_go_to_the_least_ids(spark, costs):
    rng = random.Random(len(costs))
    nodes = [f"n{i}" for i in range(40)]
    links = [(rng.choice(nodes), rng.choice(nodes), f"e{rng.randrange(10**6):06d}.{i}", rng.choice(costs)) for i in range(160)]
    asks = [(f"r{i}", rng.choice(nodes), rng.choice(nodes)) for i in range(60)]
    asks += [("again", *asks[0][1:]), ("same", "n0", "n0"), ("nowhere", "n0", "other"), ("unknown", "other", "n0")]
    want = held(spark, links, asks)
    assert want["same"] == (0.0, ()) and "nowhere" not in want and len(want) > 30


def test_a_long_chain_takes_few_jumps(spark):
    links = [(f"n{i}", f"n{i + 1}", f"e{i}", 0.1) for i in range(19)] + [("n0", "n18", "far", 100.0)]
    held(spark, links, [("all", "n0", "n19"), ("most", "n1", "n18"), ("one", "n5", "n6")])


def test_a_large_graph(spark):
    rng = random.Random(7)
    nodes = [f"n{i}" for i in range(20_000)]
    links = [(rng.choice(nodes), rng.choice(nodes), f"e{i:06d}", float(rng.randint(1, 9))) for i in range(100_000)]
    asks = [(f"r{i}", f"n{i % 3}", rng.choice(nodes)) for i in range(200)]
    assert len(held(spark, links, asks)) > 150


def test_costs_that_add_nothing_fail(spark):
    for bad in (0.0, -1.0, float("inf"), float("nan"), 1e-20):
        links = [("a", "b", "e1", 1.0), ("b", "c", "e2", bad)]
        with pytest.raises(Exception, match="a link's cost must add"):
            navigation.best_routes(spark.createDataFrame([("r", "a", "c")], ASKS), spark.createDataFrame(links, LINKS)).collect()


def test_unknown_nodes_and_missing_ways_are_named(spark):
    p = lambda x: (float(x), 0.0, 0.0)
    edges = spark.createDataFrame([("e1", "A", "B", [p(0), p(1)], True), ("e2", "B", "C", [p(0), p(1)], False)], EDGES)
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node_id string")
    asks = spark.createDataFrame([("ab", "A", "B"), ("ac", "A", "C"), ("ax", "A", "X"), ("xx", "X", "X"), ("cc", "C", "C")], ASKS)
    got = {r["request_id"]: (r["distance"], r["edge_ids"], r["failure"]) for r in navigation.shortest_paths(asks, edges, nodes).collect()}
    assert got == {"ab": (1.0, ["e1"], None), "ac": (None, None, "NO_PATH"), "ax": (None, None, "UNKNOWN_NODE"), "xx": (None, None, "UNKNOWN_NODE"), "cc": (0.0, [], None)}


def test_no_requests_and_no_edges(spark):
    none = spark.createDataFrame([], ASKS)
    links = spark.createDataFrame([("a", "b", "e", 1.0)], LINKS)
    assert navigation.best_routes(none, links).count() == 0
    assert navigation.best_routes(spark.createDataFrame([("r", "a", "b")], ASKS), links.limit(0)).count() == 0
