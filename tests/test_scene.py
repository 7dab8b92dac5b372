"""Fixtures with known results, and brute force for queries without SQL."""

import hashlib
import json
import os
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sightline.operators import audit, constraints, geometry, navigation, projection, raycasting, trajectory, visibility
from sightline.plans import queries, scene
from sightline.sources import readers, sinks
from sightline.streaming import gaps, proposals

SF = "/root/testdata/sf0.001"
V3 = "struct<x:double,y:double,z:double>"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def keyframes(spark, rate, rows):
    rows = [("T", rate, t, *map(float, p), "F1", None, region) for t, p, region in rows]
    return spark.createDataFrame(rows, "trajectory_id string, sample_rate_hz int, timestamp string, x double, y double, z double, floor_id string, zone_id string, semantic_region string").withColumn("timestamp", F.col("timestamp").cast("decimal(38,9)"))


def test_sampling(spark):
    basic = keyframes(spark, 2, [("0", (0, 0, 0), "corridor"), ("1", (2, 0, 0), "corner"), ("2", (2, 2, 0), "exit")])
    s = trajectory.sample_trajectories(basic).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in s] == [0, 0.5, 1, 1.5, 2]
    assert [(r["X"], r["Y"]) for r in s] == [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]
    assert [(r["VX"], r["VY"]) for r in s] == [(2, 0), (2, 0), (0, 2), (0, 2), (0, 2)]
    assert [r["semantic_region"] for r in s] == ["corridor", "corridor", "corner", "corner", "exit"]
    off = keyframes(spark, 2, [("0.1", (0, 0, 0), "a"), ("0.4", (1, 0, 0), "a"), ("1.15", (2, 0, 0), "a")])
    assert sorted(r["timestamp"] for r in trajectory.sample_trajectories(off).collect()) == [0.1, 0.4, 0.6, 1.1, 1.15]
    ten = keyframes(spark, 10, [("0.1", (0, 0, 0), "a"), ("0.3", (1, 0, 0), "a"), ("0.4", (2, 0, 0), "a")])
    assert sorted(r["timestamp"] for r in trajectory.sample_trajectories(ten).collect()) == [0.1, 0.2, 0.3, 0.4]
    with pytest.raises(Exception, match="too many samples"):
        trajectory.sample_trajectories(basic, max_samples=3).collect()


def camera(spark):
    m = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 10.0], [0.0, 0.0, 0.0, 1.0]]
    return projection.flattened(spark.createDataFrame([("C", m, 50.0, 50.0, 50.0, 50.0, 100, 100, 1.0, 20.0)], "camera_id string, camera_to_world array<array<double>>, fx double, fy double, cx double, cy double, width int, height int, clip_start double, clip_end double"))


def test_projection(spark):
    points = [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (0.0, 2.0, 0.0), (-10.0, 0.0, 0.0), (0.0, 0.0, 11.0), (0.0, 0.0, 9.5), (0.0, 0.0, -11.0), (10.0, 0.0, 0.0), (19.0, 0.0, -10.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, X double, Y double, Z double").crossJoin(camera(spark))
    got = projection.project_world(df).orderBy("i").collect()
    assert [(r["u"], r["v"]) for r in got[:4]] == [(50, 50), (60, 50), (50, 40), (0, 50)]
    assert [r["reason"] for r in got] == ["IN_FRUSTUM"] * 4 + ["BEHIND_CAMERA", "NEAR_CLIPPED", "FAR_CLIPPED", "OUTSIDE_FOV", "IN_FRUSTUM"]


def test_inverse_projection(spark):
    frames = spark.createDataFrame([(i, "C", "P", "OBSERVED", u, v) for i, (u, v) in enumerate([(50.0, 50.0), (60.0, 50.0), (75.0, 75.0), (100.0, 50.0)])] + [(4, "C", "Q", "OBSERVED", 50.0, 50.0), (5, "X", "P", "OBSERVED", 50.0, 50.0), (6, "C", "P", "GAP", 50.0, 50.0)], "frame_id int, camera_id string, plane_id string, status string, u double, v double")
    planes = spark.createDataFrame([("P", (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)), ("Q", (1.0, 0.0, 0.0), (1.0, 0.0, 0.0))], f"plane_id string, point {V3}, normal {V3}")
    got = projection.inverse_project(frames, camera(spark), planes=planes).orderBy("frame_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in got[:3]] == [(0, 0, 0), (2, 0, 0), (5, -5, 0)]
    assert got[2]["projection_quality"] == pytest.approx((2 / 3) ** 0.5)
    assert [r["failure"] for r in got[3:]] == ["PIXEL_OUTSIDE_IMAGE", "RAY_PARALLEL_TO_PLANE", "CAMERA_MISMATCH", "FRAME_NOT_OBSERVED"]


def test_rays(spark):
    box = lambda n, c, bad=False: (n, tuple(v - 0.5 for v in c), tuple(v + 0.5 for v in c), bad)
    boxes = spark.createDataFrame([box("Wall", (5.0, 0.0, 0.0)), box("NearWall", (2.0, 0.0, 0.0)), box("Odd", (5.0, 20.0, 0.0), True)], f"name string, lo {V3}, hi {V3}, bad boolean")
    o = (0.0, 0.0, 0.0)
    rays = spark.createDataFrame([("hit", o, (10.0, 0.0, 0.0)), ("clear", (0.0, 5.0, 0.0), (10.0, 5.0, 0.0)), ("none", o, o), ("odd", (0.0, 20.0, 0.0), (10.0, 20.0, 0.0)), ("nan", (float("nan"), 0.0, 0.0), o)], f"ray_id string, origin {V3}, target {V3}")
    got = {r["ray_id"]: (r["reason"], r["occluder_id"]) for r in raycasting.cast_rays(rays, boxes).collect()}
    assert got == {"hit": ("OCCLUDED", "NearWall"), "clear": ("CLEAR", None), "none": ("GEOMETRY_UNCERTAIN", None), "odd": ("GEOMETRY_UNCERTAIN", "Odd"), "nan": ("GEOMETRY_UNCERTAIN", None)}
    none = {r["ray_id"]: r["reason"] for r in raycasting.cast_rays(rays, boxes, max_candidates=0).collect()}
    assert none["hit"] == "RAYCAST_LIMIT" and none["clear"] == "CLEAR"


def test_navigation(spark):
    p = lambda x: (float(x), 0.0, 0.0)
    edges = spark.createDataFrame([(e, a, b, [p(0), p(1)], "WALK", None, True) for e, a, b in (("z_ac", "A", "C"), ("z_cb", "C", "B"), ("a_ad", "A", "D"), ("a_db", "D", "B"))], f"edge_id string, from_node_id string, to_node_id string, polyline array<{V3}>, transition_type string, stair_id string, walkable boolean")
    asks = spark.createDataFrame([("ab", "A", "B"), ("ba", "B", "A"), ("aa", "A", "A")], "request_id string, start_id string, goal_id string")
    got = {r["request_id"]: (r["distance"], r["edge_ids"]) for r in navigation.shortest_paths(asks, edges).collect()}
    assert got == {"ab": (2.0, ["a_ad", "a_db"]), "aa": (0.0, [])}


def test_constraints(spark):
    df = spark.createDataFrame([("ok", 1.0, 2.0), ("bad", 2.0, 1.0), ("null", None, 1.0)], "id string, a double, b double")
    checks = {"order": F.col("a") < F.col("b")}
    assert sorted(r["id"] for r in constraints.violations(df, checks, "id").collect()) == ["bad", "null"]
    with pytest.raises(Exception, match="contract broken"):
        constraints.enforce(df, checks, "id").collect()
    assert constraints.enforce(df.where("id = 'ok'"), checks, "id").count() == 1


def test_clusters_against_a_loop(spark):
    values = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/supplier.parquet").collect():
        values[r["s_nationkey"]].append(r["s_acctbal"])
    want = []
    for k, vs in values.items():
        groups = []
        for v in sorted(vs):
            if groups and v - sum(groups[-1]) / len(groups[-1]) <= 500:
                groups[-1].append(v)
            else:
                groups.append([v])
        want += [(k, i, g[0], g[-1], len(g)) for i, g in enumerate(groups)]
    got = [(r["s_nationkey"], r["cluster"], r["min"], r["max"], r["n"]) for r in queries.height_clusters(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_clipping(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)],)], "p array<struct<x:double,y:double>>")
    area = lambda *box: df.select(geometry.polygon_area(geometry.clip_to_box(F.col("p"), *map(F.lit, box)))).first()[0]
    assert area(-1.0, 5.0, -1.0, 5.0) == 8 and area(0.0, 1.0, 0.0, 1.0) == 1 and area(1.0, 2.0, 0.0, 10.0) == 2.5 and area(5.0, 6.0, 0.0, 1.0) == 0


def test_ids_and_exact_times(spark):
    hexes = {r["event_id"]: r["value_hex"] for r in queries.exact_times(spark, SF).collect()}
    assert all(v == float(r["value"]).hex() for r in spark.read.parquet(f"{SF}/events.parquet").collect() if (v := hexes[r["event_id"]]) is not None)
    frames = {r["frame_id"]: r for r in scene.pixel_frames(spark, SF).collect()}
    for r in queries.point_ids(spark, SF).limit(50).collect():
        f = frames[r["frame_id"]]
        parts = [f["camera_id"], f["target_id"], str(f["frame_id"]), f["timestamp"].hex(), r["plane_id"]]
        assert r["point_id"] == "projected:" + hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()
    ids = [r["candidate_id"] for r in queries.candidate_ids(spark, SF).collect()]
    assert len(ids) == len(set(ids)) > 0


def test_roundtrip_grid_and_stream(spark):
    back = queries.projection_roundtrip(spark, SF).collect()
    assert back and all(r["returned"] >= 0.95 * r["n"] for r in back)
    grid = queries.grid_surface_clusters(spark, SF).collect()
    assert grid and all(r["z_min"] <= r["z_mean"] <= r["z_max"] and 0 < r["n"] <= 81 for r in grid)
    segments = queries.stream_segments(spark, SF).collect()
    seen = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").where("event_type <> 'error'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect():
        seen[r["user_id"]].append(r["t"])
    last, want = max(max(v) for v in seen.values()), []
    for k, ts in seen.items():
        run = []
        for t in sorted(ts):
            if run and t >= run[-1] + 6 * 3_600_000_000:
                want.append((k, len(run), run[-1]))
                run = []
            run.append(t)
        want.append((k, len(run), run[-1]))
    closed = sorted((k, n) for k, n, end in want if end + 7 * 3_600_000_000 <= last)
    assert sorted((r["target_id"], r["n_frames"]) for r in segments) == closed


def test_stream_waits_for_late_frames(spark, tmp_path):
    """Frames that come in a later micro-batch than newer ones, but before the watermark, are put in order."""
    minute = lambda k: datetime(2024, 1, 1, 0, 0) + timedelta(minutes=k)
    batches = [[(1, 10, 1, 0), (1, 12, 2, 40)], [(1, 11, 3, 20), (2, 20, 1, 30)], [(1, 13, 4, 300), (2, 21, 2, 290)], [(1, 14, 5, 10), (1, 15, 6, 500), (2, 22, 1, 500)], [(1, 16, 7, 15), (1, 17, 7, 510)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(u, f, c, minute(m), float(m)) for u, f, c, m in rows], "target_id long, frame_id long, camera int, ts timestamp, t double")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        for part in (tmp_path / "in" / f"b{k}").glob("part-*"):
            os.makedirs(tmp_path / "src", exist_ok=True)
            part.rename(tmp_path / "src" / f"{k}.parquet")
            os.utime(tmp_path / "src" / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    pairs = gaps.gap_pairs(stream, "1 hour")
    gaps.run_to_end(pairs, str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    got = sorted((r["start_id"], r["end_id"], r["gap_s"]) for r in spark.read.schema(gaps.GAP_SCHEMA).parquet(str(tmp_path / "out")).collect())
    # frame 14 comes before anything of its time was let out, frame 16 after; frames 15, 17 and 22 still wait
    assert got == [(10, 14, 10.0), (11, 12, 20.0), (12, 13, 260.0), (14, 11, 10.0), (20, 21, 260.0)]


def test_stream_projects_each_frame_once(spark, tmp_path):
    """A frame that comes again, with it or batches later, is one; one behind the watermark is dropped; a rest is as without a stream."""
    frames = queries.scene.frames_of_events(queries.scene.table(spark, SF, "events"), F.expr("cast(ts as timestamp) as ts")).orderBy("ts", "frame_id").limit(40)
    rows, schema = frames.collect(), frames.schema
    late = rows[0].asDict() | {"frame_id": -1, "ts": rows[0]["ts"] - timedelta(days=30)}
    near = {r["frame_id"] for r in rows[20:]}
    batches = [rows[:20] + rows[:3], rows[20:] + rows[18:20], [tuple(late[c] for c in schema.names)] + rows[-2:]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        os.makedirs(tmp_path / "src", exist_ok=True)
        for part in (tmp_path / "in" / f"b{k}").glob("part-*"):
            part.rename(tmp_path / "src" / f"{k}.parquet")
            os.utime(tmp_path / "src" / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    cameras, planes = queries.scene.cameras(spark, SF), queries.scene.planes(spark)
    out = gaps.projected_frames(stream, cameras, planes, "1 day")
    gaps.run_to_end(out, str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    want = projection.inverse_project(frames, cameras, planes=planes).select(*out.columns).collect()
    assert near <= {r["frame_id"] for r in got} and sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, want), key=lambda r: r[1])


def test_inventory_publishers_and_proposals(spark, tmp_path):
    lamp = {"object_name": "L", "type": "AREA", "energy": 2.0, "color": {"x": 1, "y": 1, "z": 1}, "custom_properties": "{}"}
    (tmp_path / "lights.json").write_text(json.dumps(lamp) + "\n")
    assert readers.read_inventory(spark, str(tmp_path / "lights.json"), "lights").select("energy", "color.x").first() == (2.0, 1.0)
    (tmp_path / "bad.json").write_text('{"energy": "much"}\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_inventory(spark, str(tmp_path / "bad.json"), "lights").collect()
    asset = tmp_path / "asset.bin"
    asset.write_bytes(b"abc")
    before = readers.asset_fingerprint(spark, str(asset)).first().asDict()
    path = sinks.publish_geometry_audit({"regions": 2}, before, before, str(tmp_path / "audit.json"))
    report = json.loads(path.read_text())
    assert report["regions"] == 2 and report["source"]["sha256_before"] == before["sha256"] and report["interpretation_boundary"]["raw_coverage_is_walkability"] is False
    with pytest.raises(ValueError):
        sinks.publish_geometry_audit({}, before, before | {"sha256": "other"}, str(tmp_path / "audit.json"))
    cameras = spark.createDataFrame([("CAM_2",), ("CAM_1",), ("SKP_3",)], "camera_id string")
    assert [r[0] for r in readers.eligible_cameras(cameras, count=2).collect()] == ["CAM_1", "CAM_2"]
    with pytest.raises(ValueError):
        readers.eligible_cameras(cameras, count=3)
    catalog = json.loads(sinks.publish_camera_catalog(cameras, "a", "h", str(tmp_path / "cams.json"), 3).read_text())
    assert catalog["camera_count"] == 3 and [c["camera_id"] for c in catalog["cameras"]] == ["CAM_1", "CAM_2", "SKP_3"]
    with pytest.raises(ValueError):
        sinks.publish_camera_catalog(cameras.unionAll(cameras), "a", "h", str(tmp_path / "c2.json"))
    frames = spark.createDataFrame([(1, "C1"), (2, "C2")], "frame_id int, camera_id string")
    sinks.write_observation_bundle(frames, str(tmp_path / "bundle"), {"scene_id": "s"})
    assert spark.read.parquet(str(tmp_path / "bundle")).select("scene_id").distinct().collect() == [("s",)]
    requests = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "request_id string, x double")
    found = proposals.proposals(requests, lambda r: [([(0, 0, 0), (r["x"], 0, 0)], None)] * 2).collect()
    assert sorted((r["request_id"], r["proposal_no"], r["polyline"][1]["x"]) for r in found) == [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 2.0), ("b", 1, 2.0)]


def test_json_normaliser_bounds(spark):
    deep = "[" * 9 + "1" + "]" * 9
    wide = json.dumps({f"k{i:03}": i for i in range(250)})
    one = lambda t: json.loads(spark.createDataFrame([(t,)], "t string").select(audit.normal_json(F.col("t"))).first()[0])
    found = one(deep)
    for _ in range(8):
        found = found[0]
    assert found == {"truncated_type": "list", "reason": "maximum_depth"} and len(one(wide)) == 200


def test_sources_and_sinks(spark, tmp_path):
    doc = {"trajectory_id": "T", "target_id": "p", "scene_id": "s", "random_seed": 1, "sample_rate_hz": 2, "keyframes": [{"timestamp": 0.5, "position": {"x": 1, "y": 2, "z": 3}, "floor_id": "F1", "zone_id": None, "semantic_region": "a"}]}
    path = sinks.publish_json(doc, str(tmp_path / "t.json"))
    assert readers.read_keyframes(spark, str(path)).select("position.x", "timestamp").first()[0] == 1
    with pytest.raises(FileExistsError):
        sinks.publish_json(doc, str(path))
    with pytest.raises(ValueError):
        sinks.publish_json({"a": float("nan")}, str(tmp_path / "n.json"))
    with pytest.raises(ValueError):
        sinks.publish_json(doc, str(tmp_path / "t.txt"))
    with pytest.raises(ValueError):
        sinks.publish_json(doc, str(path), inputs=(str(path),), overwrite=True)
    found = readers.asset_fingerprint(spark, str(path)).first()
    assert found["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and found["size"] == path.stat().st_size
