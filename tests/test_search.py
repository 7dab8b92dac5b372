"""The search against a heap that expands one state at a time, and candidates against their contract."""

import hashlib
import heapq
import json
import math
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F

from sightline.operators import constraints, search
from sightline.plans import queries, scene

SF = "/root/testdata/sf0.001"


def more(value, limit):
    return value > limit and value - limit > max(1e-12, 4 * max(math.ulp(value), math.ulp(limit)))


def graph(spark):
    lengths = {r["edge_id"]: math.dist(*r["polyline"]) for r in scene.edges(spark, SF).collect()}
    out = {}
    for r in sorted(scene.transitions(spark, SF).collect(), key=lambda r: r["transition_id"]):
        out.setdefault((r["from_camera_id"], r["navigation_from_node_id"]), []).append((r["transition_id"], r["to_camera_id"], r["navigation_to_node_id"], r["navigation_edge_ids"][0], lengths[r["navigation_edge_ids"][0]]))
    return out


def heap_search(out, start, end, top, reach, k, nodes, branch, ratio):
    queue, seen, routes, shortest, expanded, fast, far = [(0.0, (), (), *start)], {(*start, ())}, [], None, 0, False, False

    def ended(reason, complete=False):
        return reason, expanded, complete, tuple(r[:2] for r in routes[:k]), ""

    while queue:
        if expanded >= nodes:
            return ended("MAX_SEARCH_NODES")
        length, edges, ids, camera, node = heapq.heappop(queue)
        expanded += 1
        limit = None if shortest is None else top if shortest == 0 else shortest * ratio
        if limit is not None and more(length, limit):
            break
        if (camera, node) == end:
            routes.append((edges, length))
            if shortest is None:
                shortest = length
                limit = top if shortest == 0 else shortest * ratio
            if len(routes) > k:
                return ended("MAX_PATHS_REACHED")
        ways = out.get((camera, node), [])
        if len(ways) > branch:
            return ended("MAX_BRANCH_FACTOR")
        for id_, to_camera, to_node, edge, step in ways:
            there = length + step
            if more(there, top):
                far = True
            elif more(there, reach):
                fast = True
            elif not (limit is not None and more(there, limit)) and (to_camera, to_node, (*edges, edge)) not in seen:
                seen.add((to_camera, to_node, (*edges, edge)))
                heapq.heappush(queue, (there, (*edges, edge), (*ids, id_), to_camera, to_node))
    if routes:
        return ended("COMPLETE", True)
    return "NO_FEASIBLE_PATH", expanded, True, (), ",".join(["NO_FEASIBLE_AUTHORIZED_ROUTE", *["PHYSICALLY_IMPOSSIBLE_SPEED"] * fast, *["MAX_PATH_LENGTH_EXCEEDED"] * far])


@pytest.mark.parametrize("bounds", ["default", "small"])
def test_search_is_a_heap(spark, bounds):
    out = graph(spark)
    requests, results, routes = queries._searched(spark, SF, **(queries._small_bounds() if bounds == "small" else {}))
    found = {}
    for r in routes.orderBy("request_id", "rank").collect():
        found.setdefault(r["request_id"], []).append((tuple(r["edge_ids"]), r["distance"]))
    asked = cache(lambda *a: heap_search(out, *a))
    reasons, by_id = Counter(), {r["request_id"]: r for r in requests.collect()}
    for r in results.collect():
        q = by_id.pop(r["request_id"])
        # beyond 200 m no bound of reach shows within the budget
        want = asked((q["start_camera"], q["start_node"]), (q["end_camera"], q["end_node"]), q["max_path_length_m"], min(q["max_speed_m_s"] * q["gap_s"], 200.0), min(q["max_paths"], q["max_candidate_paths"]), q["max_search_nodes"], q["max_branch_factor"], q["max_detour_ratio"])
        assert (r["termination_reason"], r["expanded_nodes"], r["complete"], tuple(found.get(r["request_id"], ())), r["rejections"]) == want, q
        assert r["n_candidates"] == len(want[3])
        reasons[r["termination_reason"]] += 1
    assert not by_id
    assert set(reasons) >= ({"MAX_PATHS_REACHED", "MAX_SEARCH_NODES"} if bounds == "default" else {"COMPLETE", "NO_FEASIBLE_PATH", "MAX_PATHS_REACHED", "MAX_SEARCH_NODES", "MAX_BRANCH_FACTOR"}), reasons


def test_candidates_have_lines_and_identities(spark):
    requests, _, routes = queries._searched(spark, SF, max_path_length_m=14.0)
    nodes = {r["node_id"]: [r["position"][a] for a in "xyz"] for r in scene.nodes(spark, SF).collect()}
    found = search.candidates(routes, requests, scene.edges(spark, SF), scene.nodes(spark, SF), queries.CONTEXT).collect()
    asked, ways = {r["request_id"]: r for r in requests.collect()}, {(r["request_id"], r["rank"]): r for r in routes.collect()}
    assert len({r["candidate_id"] for r in found}) == len(found) == len(ways) > 0
    for r in found:
        q, way = asked[r["request_id"]], ways[r["request_id"], r["rank"]]
        line = [nodes[q["start_node"]], *(nodes["N" + e[-2:]] for e in way["edge_ids"])]
        line = line * 2 if len(line) == 1 else line
        assert [[p["x"], p["y"], p["z"]] for p in r["polyline"]] == line

        def point(p):
            return {k: p[k] for k in ("camera_id", "floor_id", "observation_id", "plane_id", "point_id")} | {"timestamp": p["timestamp"].hex(), "world_position": [p["world_position"][a].hex() for a in "xyz"]}

        payload = queries.CONTEXT | {f"{e}_{f}": q[e][f] for e in ("start", "end") for f in ("camera_id", "floor_id", "observation_id")} | {f"{e}_point": point(q[e]["point"]) for e in ("start", "end")}
        payload |= {"identity_version": search.IDENTITY, "target_id": q["start"]["target_id"], "transition_ids": way["transition_ids"], "navigation_edge_ids": way["edge_ids"], "polyline": [[x.hex() for x in p] for p in line]}
        payload |= {"max_speed_m_s": q["max_speed_m_s"].hex(), "path_length": way["distance"].hex(), "minimum_travel_time": way["minimum_time"].hex(), "estimated_travel_time": way["estimated_time"].hex()}
        assert r["candidate_id"] == "candidate:" + hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    bad = spark.createDataFrame([("a", 1.0, 2.0, [1]), ("b", 2.0, 1.0, [1, 2])], "candidate_id string, estimated_travel_time double, minimum_travel_time double, polyline array<int>")
    assert {tuple(r) for r in constraints.violations(bad, constraints.candidate_checks(), "candidate_id").collect()} == {("a", "times"), ("a", "polyline")}


def test_requests_are_checked(spark):
    good = scene.search_requests(spark, SF).limit(1).withColumns({"start_valid": F.lit(True), "end_valid": F.lit(True), "start_target": F.lit("a"), "end_target": F.lit("a"), "start_observation_id": F.lit("o1"), "end_observation_id": F.lit("o2"), "start_failure": F.lit(None).cast("string"), "end_failure": F.lit(None).cast("string")})
    flaws = {
        None: {},
        "INVALID_MAX_PATHS": {"max_paths": F.lit(0)},
        "INVALID_OBSERVATION": {"end_valid": F.lit(None).cast("boolean")},
        "TARGET_MISMATCH": {"end_target": F.lit("b")},
        "DUPLICATE_OBSERVATION": {"end_observation_id": F.lit("o1")},
        "INVALID_TIME_GAP": {"gap_s": F.lit(0.0)},
        "ENDPOINT_FLOOR_REQUIRED": {"start_failure": F.lit("ENDPOINT_FLOOR_REQUIRED")},
        "ENDPOINT_OFF_NETWORK": {"end_node": F.lit(None).cast("string")},
        "NUMERICAL_FAILURE": {"max_speed_m_s": F.lit(float("inf"))},
    }
    rows = None
    for name, change in flaws.items():
        one = good.withColumns(change | {"request_id": F.lit(str(name))}).select(*good.columns)
        rows = one if rows is None else rows.unionByName(one)
    results, routes = search.checked_search(rows, scene.transitions(spark, SF), scene.edges(spark, SF))
    got = {r["request_id"]: r for r in results.collect()}
    assert {k: r["failure"] for k, r in got.items()} == {str(k): k for k in flaws}
    assert all((r["termination_reason"] is None) == (r["failure"] is not None) for r in got.values())
    assert {r["request_id"] for r in routes.collect()} <= {"None"}
    none, no_routes = search.checked_search(rows.where("max_paths = 0"), scene.transitions(spark, SF), scene.edges(spark, SF))
    assert [r["failure"] for r in none.collect()] == ["INVALID_MAX_PATHS"] and no_routes.count() == 0
