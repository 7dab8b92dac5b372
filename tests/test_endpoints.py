"""Contracts of observations without lists of their rows, and requests located from raw observations."""

from collections import Counter

from sightline.operators import endpoints
from sightline.plans import queries, scene
from sightline.sources.schemas import SEARCH_DEFAULTS

SF = "/root/testdata/sf0.001"
HEADS = "observation_id string, target_id string, camera_id string, start_time double, end_time double, floor_id string, provenance string"
FRAMES = "observation_id string, no int, timestamp double, status string, camera_id string, target_id string"
POINTS = "observation_id string, no int, point_id string, timestamp double, camera_id string, of_observation string, floor_id string, world_position struct<x:double,y:double,z:double>"


def tables(spark, cases):
    """cases: id -> (what is other in the head, frames as times or (time, status, camera, target), points as (id, time) or
    (id, time, camera, observation))."""
    heads, frames, points = [], [], []
    for k, (changes, times, path) in cases.items():
        head = {"target_id": "t", "camera_id": "c", "start_time": 0.0, "end_time": 10.0, "floor_id": "F1", "provenance": "PROJECTED"} | changes
        heads.append((k, *head.values()))
        for i, x in enumerate(times):
            t, *seen = x if isinstance(x, tuple) else (x, "OBSERVED", "c", "t")
            frames.append((k, i, t, *seen))
        for i, (point, t, *seen) in enumerate(path):
            points.append((k, i, point, t, *(seen or ("c", None)), "F1", (0.0, 0.0, 0.0)))
    return spark.createDataFrame(heads, HEADS), spark.createDataFrame(frames, FRAMES).repartition(3), spark.createDataFrame(points, POINTS).repartition(3)


def broken(spark, cases, ordinal="no"):
    rows = endpoints.observation_violations(endpoints.checked_observations(*tables(spark, cases), ordinal=ordinal)).collect()
    out = {k: set() for k in cases}
    for r in rows:
        out[r["observation_id"]].add(r["constraint"])
    return out


def test_contract_of_observations(spark, monkeypatch):
    monkeypatch.setattr(endpoints, "BLOCK_ROWS", 4)
    path = [("p", 1.0), ("q", 2.0)]
    long = [0.5 * i for i in range(20)]
    cases = {
        "good": ({}, long, path), "bare": ({"provenance": "OBSERVED"}, [], []), "no window": ({"end_time": None}, [], path), "backwards": ({"start_time": 11.0}, [], path),
        "path for nothing": ({"provenance": "OBSERVED"}, [1.0], path), "no path": ({}, [1.0], []), "no provenance": ({"provenance": None}, [1.0], []),
        "repeat": ({}, [1.0, 1.0], path), "edge of a block": ({}, [*long[:4], 1.5, *long[5:]], path), "repeat at an edge": ({}, [*long[:3], 2.0, 2.0, 3.0], path), "fall in a block": ({}, [1.0, 3.0, 2.0], path), "null time": ({}, [1.0, None], path),
        "gap": ({}, [(1.0, "GAP", "c", "t")], path), "other camera": ({}, [(1.0, "OBSERVED", "d", "t")], path), "other target": ({}, [(1.0, "OBSERVED", "c", "u")], path), "outside": ({}, [11.0], path),
        "path falls": ({}, [], [("p", 2.0), ("q", 1.0)]), "same id": ({}, [], [("p", 1.0), ("p", 2.0)]), "id null": ({}, [], [(None, 1.0)]), "path outside": ({}, [], [("p", 10.5)]), "own": ({}, [], [("p", 1.0, "c", "own")]), "another's": ({}, [], [("p", 1.0, "c", "own")]), "path camera": ({}, [], [("p", 1.0, "d", None)]),
    }
    want = {
        "good": set(), "bare": set(), "no window": {"window", "path"}, "backwards": {"window", "path"}, "path for nothing": {"provenance"}, "no path": {"provenance"}, "no provenance": {"provenance"},
        "repeat": {"frame_order"}, "edge of a block": {"frame_order"}, "repeat at an edge": {"frame_order"}, "fall in a block": {"frame_order"}, "null time": {"frame_order", "frames"},
        "gap": {"frames"}, "other camera": {"frames"}, "other target": {"frames"}, "outside": {"frames"}, "path falls": {"path_order"}, "same id": {"point_ids"}, "id null": {"point_ids"}, "path outside": {"path"}, "own": set(), "another's": {"path"}, "path camera": {"path"},
    }
    assert broken(spark, cases) == want
    # without numbers rows stand in the order of time, so only a repeated time breaks it
    by_time = want | {"fall in a block": set(), "path falls": set(), "edge of a block": {"frame_order"}}
    assert broken(spark, cases, None) == by_time


def test_every_failure_of_a_request(spark):
    place = (0.0, 0.0, 0.0)
    heads = [("a", "t", "c1", 0.0, 1.0, "F1", "PROJECTED"), ("b", "t", "c1", 2.0, 3.0, None, "PROJECTED"), ("other", "u", "c1", 2.0, 3.0, "F1", "PROJECTED"), ("seen", "t", "c1", 2.0, 3.0, "F1", "OBSERVED"), ("twice", "t", "c1", 2.0, 3.0, "F1", "PROJECTED"), ("twice", "t", "c1", 2.0, 3.0, "F1", "PROJECTED"),
             ("nowhere", "t", "c1", 2.0, 3.0, "", "PROJECTED"), ("torn", "t", "c1", 2.0, 3.0, "F2", "PROJECTED"), ("lost", "t", "c9", 2.0, 3.0, "F1", "PROJECTED"), ("up", "t", "c2", 2.0, 3.0, "F1", "PROJECTED"), ("off", "t", "c1", 2.0, 3.0, "F1", "PROJECTED"), ("crowd", "t", "c1", 2.0, 3.0, "F1", "PROJECTED"), ("nan", "t", "c1", 2.0, 3.0, "F1", "PROJECTED")]
    where = {"off": (0.5, 0.0, 0.0), "crowd": (9.0, 0.0, 0.0), "nan": (float("nan"), 0.0, 0.0)}
    points = [(k, i, f"p{i}", t, c, k, {"nowhere": None, "torn": "F1"}.get(k, "F1"), where.get(k, place)) for k, _, c, start, end, _, kind in dict.fromkeys(heads) if kind == "PROJECTED" for i, t in enumerate((start, end))]
    cameras = spark.createDataFrame([("c1", "F1"), ("c2", "F2")], "camera_id string, floor_id string")
    nodes = spark.createDataFrame([("n", "F1", place), ("m", "F2", place), ("x", "F1", (9.0, 0.0, 0.0)), ("y", "F1", (9.0, 0.0, 5e-7))], "node_id string, floor_id string, position struct<x:double,y:double,z:double>")
    asks = {("a", "b", 3, 1.0): None, ("a", "b", 0, 1.0): "INVALID_MAX_PATHS", ("a", "b", None, 1.0): "INVALID_MAX_PATHS", ("a", "seen", 3, 1.0): "INVALID_OBSERVATION", ("gone", "b", 3, 1.0): "INVALID_OBSERVATION", ("a", "twice", 3, 1.0): "INVALID_OBSERVATION", ("a", None, 3, 1.0): "INVALID_OBSERVATION",
            ("a", "other", 3, 1.0): "TARGET_MISMATCH", ("a", "a", 3, 1.0): "DUPLICATE_OBSERVATION", ("b", "a", 3, 1.0): "INVALID_TIME_GAP", ("a", "nowhere", 3, 1.0): "ENDPOINT_FLOOR_REQUIRED", ("a", "torn", 3, 1.0): "ENDPOINT_FLOOR_MISMATCH", ("a", "lost", 3, 1.0): "UNKNOWN_CAMERA", ("a", "up", 3, 1.0): "ENDPOINT_FLOOR_MISMATCH",
            ("a", "off", 3, 1.0): "ENDPOINT_OFF_NETWORK", ("a", "crowd", 3, 1.0): "ENDPOINT_OFF_NETWORK", ("a", "nan", 3, 1.0): "ENDPOINT_OFF_NETWORK", ("a", "b", 3, float("inf")): "NUMERICAL_FAILURE"}
    requests = spark.createDataFrame([(str(i), *ask) for i, ask in enumerate(asks)], "request_id string, start_observation_id string, end_observation_id string, max_paths int, max_speed_m_s double")
    frames = spark.createDataFrame([], FRAMES)
    found = endpoints.located_requests(requests, spark.createDataFrame(heads, HEADS), frames, spark.createDataFrame(points, POINTS), cameras, nodes, ordinal="no").collect()
    assert {int(r["request_id"]): r["failure"] for r in found} == dict(enumerate(asks.values())) and len(found) == len(asks)
    good = next(r for r in found if r["failure"] is None)
    assert (good["start_node"], good["end_node"], good["gap_s"], good["start_floor"], good["end_floor"]) == ("n", "n", 1.0, "F1", "F1")
    nothing = endpoints.located_requests(requests.limit(0), spark.createDataFrame([], HEADS), frames, spark.createDataFrame([], POINTS), cameras, nodes)
    assert nothing.count() == 0


def test_located_results(spark):
    """Every failure occurs in the tables' requests, and those that pass end as the search of their nodes does."""
    found = queries.located_requests(spark, SF).collect()
    codes = Counter(r["failure"] for r in found)
    assert codes[None] > 100 and {"INVALID_MAX_PATHS", "INVALID_OBSERVATION", "TARGET_MISMATCH", "INVALID_TIME_GAP", "ENDPOINT_FLOOR_REQUIRED", "ENDPOINT_FLOOR_MISMATCH", "UNKNOWN_CAMERA", "ENDPOINT_OFF_NETWORK", "NUMERICAL_FAILURE", "DUPLICATE_OBSERVATION"} <= set(codes)
    ends = queries.located_results(spark, SF).collect()
    assert {r["failure"]: r["n"] for r in ends if r["failure"]} == {k: n for k, n in codes.items() if k}
    assert sum(r["n"] for r in ends if not r["failure"]) == codes[None] and all((r["termination_reason"] is None) == (r["failure"] is not None) for r in ends)
    assert scene.raw_requests(spark, SF).columns[5:] == [k for k in SEARCH_DEFAULTS if k not in ("max_search_time_s", "max_paths", "max_path_length_m")] + ["max_path_length_m"]
