"""Contracts of the entities as queries over the star tables, and the same rows in SQL.

Every table here is made by fixed arithmetic over suppliers, parts or nations, with flaws at fixed places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, constraints, geometry, navigation, projection, search, trajectory
from ..sources import readers
from . import scene


def _supplier(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return scene.table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as k", "s_nationkey as nation", "s_acctbal as balance").selectExpr(*columns)


def _broken(name: str, cases: dict[str, str], id_: str, source: str = "supplier", key: str = "s_suppkey") -> str:
    """SQL for violations: a row for each constraint whose condition for breaking holds."""
    rows = ", ".join(f"CASE WHEN {broken} THEN '{constraint}' END" for constraint, broken in cases.items())
    return f"SELECT {name}, \"constraint\" FROM (SELECT {name}, unnest([{rows}]) AS \"constraint\" FROM (SELECT {id_} AS {name}, {key} AS k FROM {source})) WHERE \"constraint\" IS NOT NULL"


def camera_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _supplier(spark, sf_dir, "k", "if(k % 11 = 0, '', concat('CAM_', k)) as camera_id", "if(k % 7 = 0, 0.0D, if(k % 13 = 0, double('NaN'), 64.0D)) as fx", "64.0D as fy", "if(k % 5 = 0, 0, 100) as width", "100 as height", "2.0D as clip_start", "if(k % 3 = 0, 1.0D, 200.0D) as clip_end")
    return constraints.violations(c, constraints.camera_checks(), "k")


def plane_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _supplier(spark, sf_dir, "k", "if(k % 9 = 0, '', concat('P', k)) as plane_id", "named_struct('x', if(k % 4 = 0, 0.61D, 0.6D), 'y', 0.0D, 'z', 0.8D) as normal")
    return constraints.violations(p, constraints.plane_checks(), "k")


#: Rotations and, from 3 on, matrices that are none: mirrored, scaled, sheared.
POSES = {
    0: ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
    1: ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)),
    2: ((0.6, 0.0, 0.8), (0.0, 1.0, 0.0), (-0.8, 0.0, 0.6)),
    3: ((-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
    4: ((1.1, 0.0, 0.0), (0.0, 1.1, 0.0), (0.0, 0.0, 1.1)),
    5: ((1.0, 0.01, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
}


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each supplier with a pose of POSES; the last row of every seventh matrix is wrong."""
    pick = lambda i, j: "element_at(array(" + ", ".join(f"{POSES[p][i][j]!r}D" for p in POSES) + "), cast(k % 6 + 1 as int))"
    rows = [f"array({', '.join(pick(i, j) for j in range(3))}, {t})" for i, t in enumerate(("double(k % 10)", "2.0D", "50.0D"))]
    return _supplier(spark, sf_dir, "k", "concat('CAM_', k) as camera_id", f"array({', '.join(rows)}, array(0.0D, 0.0D, 0.0D, if(k % 7 = 0, 2.0D, 1.0D))) as camera_to_world", "64.0D as fx", "64.0D as fy", "50.0D as cx", "50.0D as cy", "100 as width", "100 as height", "1.0D as clip_start", "200.0D as clip_end")


def rigid_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.flattened(_posed(spark, sf_dir)).select("camera_id", projection.rigid().alias("rigid"))


def rotated_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each camera with a proper pose, half of them turned."""
    p = projection.flattened(_posed(spark, sf_dir)).where(projection.rigid()).withColumns({"X": F.expr("double(k % 17)"), "Y": F.expr("double(k % 23)"), "Z": F.expr("double(k % 29)")})
    r6 = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return projection.project_world(p).select("camera_id", r6("depth"), r6("u"), r6("v"), "reason")


def camera_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.camera_basis(projection.flattened(_posed(spark, sf_dir)).where(projection.rigid()))


def path_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _supplier(
        spark, sf_dir, "k", "cast(k % 3 as int) as n", "array_repeat('e', cast(k % 3 as int)) as edge_ids", "array_repeat('WALK', cast(k % 3 + if(k % 5 = 0, 1, 0) as int)) as transition_types", "array_repeat('n', cast(k % 3 + 1 as int)) as node_ids",
        "transform(sequence(0, cast(k % 3 as int)), i -> named_struct('x', 10.0D * if(k % 11 = 0, 0, i), 'y', 0.0D, 'z', 0.0D)) as polyline", "10.0D * (k % 3) + if(k % 7 = 0, 1, 0) as distance",
    )
    return constraints.violations(p, constraints.nav_path_checks(), "k")


def transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _supplier(spark, sf_dir, "k", "concat('C', k % 3) as from_camera_id", "concat('C', k % 4) as to_camera_id", "if(k % 5 = 0, cast(array() as array<string>), if(k % 7 = 0, array('e', 'e'), array('e', 'f'))) as navigation_edge_ids")
    return constraints.violations(t, constraints.transition_checks(), "k")


def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _supplier(
        spark, sf_dir, "k", "transform(sequence(1, cast(k % 3 + 1 as int)), i -> named_struct('candidate_id', concat('c', if(k % 5 = 0, 1, i)))) as some",
        "element_at(array('COMPLETE', 'NO_FEASIBLE_PATH', 'MAX_SEARCH_NODES'), cast(k % 3 + 1 as int)) as termination_reason", "k % 4 < 2 as complete",
    ).selectExpr("k", "if(k % 2 = 0, slice(some, 1, 0), some) as candidates", "termination_reason", "complete")
    return constraints.violations(r, constraints.result_checks(), "k")


def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supplier(
        spark, sf_dir, "k", "1.0D as start_time", "if(k % 6 = 0, 0.5D, 2.0D) as end_time", "if(k % 5 = 0, cast(array() as array<string>), if(k % 7 = 0, array('a', 'a'), array('a', 'b'))) as observation_ids",
        "array(named_struct('candidate_id', 'c', 'start_observation_id', 'a', 'end_observation_id', if(k % 4 = 0, 'z', 'a')), named_struct('candidate_id', if(k % 9 = 0, 'c', 'd'), 'start_observation_id', 'a', 'end_observation_id', 'a')) as candidates",
    )
    return constraints.violations(e, constraints.event_checks(), "k")


def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _supplier(spark, sf_dir, "k", "if(k % 3 = 0, 0.0D, 1.5D) as max_speed_m_s", "cast(k % 5 as int) as max_candidate_paths", "cast(k % 7 as int) as max_search_nodes", "if(k % 11 = 0, double('Infinity'), 1000.0D) as max_path_length_m", "cast(k % 13 as int) as max_branch_factor", "if(k % 4 = 0, 0.99D, 1.0D) as max_detour_ratio")
    return constraints.violations(p, constraints.policy_checks(), "k")


def unbound_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth whose asset is not the catalogue's or whose samples were not evaluated."""
    truth = _supplier(spark, sf_dir, "k", "concat('asset', k % 4) as source_asset_sha256", "if(k % 3 = 0, 'CONFIGURED_KEYFRAMES', 'BLENDER_EVALUATED') as sample_source")
    catalog = scene.table(spark, sf_dir, "region").selectExpr("concat('asset', r_regionkey % 3) as source_asset_sha256")
    return constraints.unbound_sources(truth, catalog).select("k", "source_asset_sha256", "sample_source")


def endpoint_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supplier(spark, sf_dir, "k", "element_at(array('F0', 'F1', '', null), cast(k % 4 + 1 as int)) as observation_floor", "element_at(array('F0', '', null), cast(k % 3 + 1 as int)) as point_floor")
    floor, failure = search.endpoint_floor(F.col("observation_floor"), F.col("point_floor"))
    return e.select("k", floor.alias("floor"), failure.alias("failure"))


def request_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each supplier whose first flaw, in the order of the API, is named."""
    r = _supplier(
        spark, sf_dir, "k", "cast(if(k % 29 = 0, 0, 3) as int) as max_paths", "k % 23 > 0 as start_valid", "if(k % 19 = 0, null, true) as end_valid", "'t' as start_target", "if(k % 17 = 0, 'u', 't') as end_target", "'o1' as start_observation_id", "if(k % 13 = 0, 'o1', 'o2') as end_observation_id",
        "if(k % 11 = 0, 0.0D, if(k % 31 = 0, double('NaN'), 5.0D)) as gap_s", "if(k % 7 = 0, 'ENDPOINT_FLOOR_REQUIRED', null) as start_failure", "if(k % 5 = 0, null, 'n') as start_node", "if(k % 8 = 0, 'UNKNOWN_CAMERA', null) as end_failure", "if(k % 6 = 0, null, 'n') as end_node", "if(k % 9 = 0, 1.7e308D, 1.5D) as max_speed_m_s",
    )
    return search.request_failures(r).select("k", "failure")


def graph_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs and topologies with their bindings: a configured one needs an asset hash, and a network's two must agree."""
    g = _supplier(spark, sf_dir, "concat('G', k) as graph_id", "if(k % 3 = 0, 'CONFIGURED', 'SYNTHETIC_TEST_FIXTURE') as data_kind", "concat('S', k % 5) as spatial_context_id", "if(k % 2 = 0, null, concat('h', k % 4)) as source_asset_sha256")
    t = _supplier(spark, sf_dir, "concat('T', k) as topology_id", "concat('G', if(k % 10 = 0, k + 1000000, k)) as navigation_graph_id", "if(k % 4 = 0, 'CONFIGURED', 'SYNTHETIC_TEST_FIXTURE') as data_kind", "concat('S', k % 6) as spatial_context_id", "if(k % 2 = 0, null, concat('h', k % 3)) as source_asset_sha256")
    return constraints.binding_violations(g, t)


def short_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with fewer than two orders have no trajectory."""
    o = scene.table(spark, sf_dir, "orders").selectExpr("o_custkey as trajectory_id", "o_orderkey")
    return constraints.too_few(scene.table(spark, sf_dir, "customer").selectExpr("c_custkey as trajectory_id").join(o, "trajectory_id", "left"), "trajectory_id", "o_orderkey")


def eligible_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.eligible_cameras(_supplier(spark, sf_dir, "concat(if(k % 3 = 0, 'SKP_', 'CAM_'), k) as camera_id"))


def outgoing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.outgoing(scene.edges(spark, sf_dir), "N07").select("edge_id", "to_node_id")


def unknown_route_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _supplier(spark, sf_dir, "cast(k as string) as request_id", "concat('N', lpad(cast(nation as string), 2, '0')) as start_id", "concat('N', lpad(cast(k % 27 as string), 2, '0')) as goal_id")
    return navigation.unknown_nodes(r, scene.nodes(spark, sf_dir))


def unlocated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions without a value or a finite one are not looked for."""
    p = _supplier(spark, sf_dir, "cast(k as string) as request_id", "if(k % 5 = 0, null, named_struct('x', if(k % 7 = 0, double('NaN'), 10.0D * (nation div 5)), 'y', 0.0D, 'z', 4.0D * (nation % 5))) as position", "concat('F', cast(nation % 5 as string)) as floor_id")
    return navigation.locate_nodes(p, scene.nodes(spark, sf_dir).drop("key"))


def orphan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orphans(_supplier(spark, sf_dir, "element_at(array('meshes', 'materials', 'images'), cast(k % 3 + 1 as int)) as kind", "cast(k % 4 as int) as users"))


def plain_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _supplier(spark, sf_dir, "concat(element_at(array('AREA_', 'PORTAL_', 'WALL_'), cast(k % 3 + 1 as int)), k) as name", "if(k % 10 = 0, 'EMPTY', 'MESH') as type", "if(k % 4 = 0, 9, 8) as vertices", "6 as polygons", "if(k % 5 = 0, 1, 0) as material_slots", "k % 7 = 0 as has_properties")
    return audit.simple_boxes(o).select("name")


def decoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _supplier(spark, sf_dir, "concat(element_at(array('Chair', 'Main Table', 'Walls', 'Plants'), cast(k % 4 + 1 as int)), '_', k) as name", "k % 9 as object_count")
    return audit.decoration_collections(c)


def redacted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = r"array('/srv/tex/a b.png', 'C:\\tex\\wall.jpg', '//tex/rel.png', 'https://host.example/i/p.png?sig=1#x', 'tex/plain.png', 'c:/x/y.exr')"
    i = _supplier(spark, sf_dir, "k", f"element_at({paths}, cast(k % 6 + 1 as int)) as filepath")
    return i.select("k", audit.redacted_path(F.col("filepath")).alias("filepath"))


def normalised_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom properties as JSON, with addresses and absolute paths cut, keys sorted and depth bounded."""
    p = _supplier(spark, sf_dir, "k", "if(k % 5 = 0, '{\"b\": 1, \"a\": {\"url\": \"https://h.example/p?q=1\"}}', concat('{\"n\": ', k, ', \"path\": \"/srv/x/y.png\", \"l\": [true, null, \"C:/a/b.txt\"]}')) as properties")
    return p.select("k", audit.normal_json(F.col("properties")).alias("properties"))


def transformed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projection.flattened(_posed(spark, sf_dir)).withColumns({"px": F.expr("double(k % 17)"), "py": F.expr("double(k % 23)"), "pz": F.expr("double(k % 29)")})
    at = geometry.transform_point("px", "py", "pz")
    return p.select("camera_id", *((F.round(at[a], 6) + F.lit(0.0)).alias(a) for a in "xyz"))


def instance_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the eight corners of a box of 2 by 4 by 6 under each pose."""
    b = projection.flattened(_posed(spark, sf_dir)).withColumns({"lo": F.expr("named_struct('x', -1.0D, 'y', -2.0D, 'z', -3.0D)"), "hi": F.expr("named_struct('x', 1.0D, 'y', 2.0D, 'z', 3.0D)")})
    out = geometry.instance_bounds(b, "camera_id")
    return out.select("camera_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in out.columns if c != "camera_id"))


def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier(spark, sf_dir, "k", "k * 0.25D as t").select("k", trajectory.frame_at(F.col("t"), F.lit(24.0)).alias("frame"))


def area_layer_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects and faces with the largest clipped areas of each area's layers."""
    found = geometry.area_layer_tops(scene.area_boxes(spark, sf_dir), geometry.triangle_measures(scene.surfaces(spark, sf_dir)))
    return found.select("area", (F.round("z", 6) + F.lit(0.0)).alias("z"), "kind", "rank", "name", "polygon_index", (F.round("clipped_xy_area", 6) + F.lit(0.0)).alias("clipped_xy_area"))


def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.event_by_id(scene.table(spark, sf_dir, "events").selectExpr("cast(event_id as string) as event_id", "user_id", "event_type"), "7")


QUERIES = {f.__name__: f for f in (
    camera_violations, plane_violations, rigid_poses, rotated_projection, camera_axes, path_violations, transition_violations, result_violations, event_violations, policy_violations, unbound_sources, endpoint_floors, request_failures, graph_bindings,
    short_trajectories, eligible_cameras, outgoing_edges, unknown_route_ends, unlocated_positions, orphan_blocks, plain_boxes, decoration, redacted_images, normalised_properties, transformed_points, instance_bounds, frame_numbers, area_layer_tops, event_by_id,
)}


def _matrix() -> str:
    """posed: a supplier's matrix as columns m00 .. m22, tx and the matrix's last cell w."""
    cells = ", ".join(f"[{', '.join(repr(POSES[p][i][j]) + 'e0' for p in POSES)}][k % 6 + 1] AS m{i}{j}" for i in range(3) for j in range(3))
    return f"posed AS (SELECT k, 'CAM_' || k AS camera_id, {cells}, CAST(k % 10 AS DOUBLE) AS tx, 2e0 AS ty, 5e1 AS tz, k % 7 <> 0 AS last_row, CAST(k % 17 AS DOUBLE) AS px, CAST(k % 23 AS DOUBLE) AS py, CAST(k % 29 AS DOUBLE) AS pz FROM (SELECT s_suppkey AS k FROM supplier))"


def _r6(c: str, name: str) -> str:
    return f"round({c}, 6) + 0e0 AS {name}"


_DEPTH = "-(m02 * (px - tx) + m12 * (py - ty) + m22 * (pz - tz))"
_LX, _LY = ("(" + " + ".join(f"m{i}{j} * (p{a} - t{a})" for i, a in enumerate("xyz")) + ")" for j in (0, 1))
_AT = {a: f"m{i}0 * px + m{i}1 * py + m{i}2 * pz + t{a}" for i, a in enumerate("xyz")}
_SPAN = {a: f"(abs(m{i}0) * 1 + abs(m{i}1) * 2 + abs(m{i}2) * 3)" for i, a in enumerate("xyz")}
_KEY = "s_suppkey"

SQL = {
    "camera_violations": _broken("k", {"camera_id": "k % 11 = 0", "focal": "k % 7 = 0 OR k % 13 = 0", "image": "k % 5 = 0", "clipping": "k % 3 = 0"}, _KEY),
    "plane_violations": _broken("k", {"plane_id": "k % 9 = 0", "unit_normal": "k % 4 = 0"}, _KEY),
    "rigid_poses": f"WITH {_matrix()} SELECT camera_id, last_row AND k % 6 < 3 AS rigid FROM posed",
    "rotated_projection": f"""WITH {_matrix()}, d AS (SELECT camera_id, {_DEPTH} AS depth, {_LX} AS lx, {_LY} AS ly FROM posed WHERE last_row AND k % 6 < 3),
        uv AS (SELECT *, CASE WHEN depth BETWEEN 1 AND 200 THEN 64 * lx / depth + 50 END AS u, CASE WHEN depth BETWEEN 1 AND 200 THEN 50 - 64 * ly / depth END AS v FROM d)
        SELECT camera_id, {_r6('depth', 'depth')}, {_r6('u', 'u')}, {_r6('v', 'v')},
               CASE WHEN depth <= 0 THEN 'BEHIND_CAMERA' WHEN depth < 1 THEN 'NEAR_CLIPPED' WHEN depth > 200 THEN 'FAR_CLIPPED' WHEN u >= 0 AND u < 100 AND v >= 0 AND v < 100 THEN 'IN_FRUSTUM' ELSE 'OUTSIDE_FOV' END AS reason FROM uv""",
    "camera_axes": f"WITH {_matrix()} SELECT camera_id, -m02 AS forward_x, -m12 AS forward_y, -m22 AS forward_z, m01 AS up_x, m11 AS up_y, m21 AS up_z FROM posed WHERE last_row AND k % 6 < 3",
    "path_violations": _broken("k", {"counts": "k % 5 = 0", "empty_path": "k % 3 = 0 AND k % 7 = 0", "segments": "k % 3 > 0 AND k % 11 = 0", "distance": "k % 3 > 0 AND (k % 7 = 0 OR k % 11 = 0)"}, _KEY),
    "transition_violations": _broken("k", {"self_transition": "k % 3 = k % 4", "cited_edges": "k % 5 = 0 OR k % 7 = 0"}, _KEY),
    "result_violations": _broken("k", {"candidate_ids": "k % 5 = 0 AND k % 2 > 0 AND k % 3 > 0", "complete": "(k % 4 < 2) <> (k % 3 < 2)", "empty": "k % 3 = 1 AND k % 2 > 0"}, _KEY),
    "event_violations": _broken("k", {"range": "k % 6 = 0", "observations": "k % 5 = 0 OR k % 7 = 0", "candidates": "k % 9 = 0", "endpoints": "k % 5 = 0 OR k % 4 = 0"}, _KEY),
    "policy_violations": _broken("k", {"speed": "k % 3 = 0", "paths": "k % 5 = 0", "nodes": "k % 7 = 0", "length": "k % 11 = 0", "branch": "k % 13 = 0", "detour": "k % 4 = 0"}, _KEY),
    "unbound_sources": "SELECT s_suppkey AS k, 'asset' || (s_suppkey % 4) AS source_asset_sha256, CASE WHEN s_suppkey % 3 = 0 THEN 'CONFIGURED_KEYFRAMES' ELSE 'BLENDER_EVALUATED' END AS sample_source FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 NOT IN (SELECT r_regionkey % 3 FROM region)",
    "endpoint_floors": """SELECT k, CASE WHEN failure IS NULL THEN coalesce(p, o) END AS floor, failure FROM (
        SELECT *, CASE WHEN o IS NULL AND p IS NULL THEN 'ENDPOINT_FLOOR_REQUIRED' WHEN o <> p THEN 'ENDPOINT_FLOOR_MISMATCH' END AS failure FROM (
            SELECT s_suppkey AS k, ['F0', 'F1', NULL, NULL][s_suppkey % 4 + 1] AS o, ['F0', NULL, NULL][s_suppkey % 3 + 1] AS p FROM supplier))""",
    "request_failures": """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 29 = 0 THEN 'INVALID_MAX_PATHS' WHEN s_suppkey % 23 = 0 OR s_suppkey % 19 = 0 THEN 'INVALID_OBSERVATION' WHEN s_suppkey % 17 = 0 THEN 'TARGET_MISMATCH' WHEN s_suppkey % 13 = 0 THEN 'DUPLICATE_OBSERVATION'
        WHEN s_suppkey % 11 = 0 OR s_suppkey % 31 = 0 THEN 'INVALID_TIME_GAP' WHEN s_suppkey % 7 = 0 THEN 'ENDPOINT_FLOOR_REQUIRED' WHEN s_suppkey % 5 = 0 THEN 'ENDPOINT_OFF_NETWORK' WHEN s_suppkey % 8 = 0 THEN 'UNKNOWN_CAMERA' WHEN s_suppkey % 6 = 0 THEN 'ENDPOINT_OFF_NETWORK'
        WHEN s_suppkey % 9 = 0 THEN 'NUMERICAL_FAILURE' END AS failure FROM supplier""",
    "graph_bindings": """WITH s AS (SELECT s_suppkey AS k FROM supplier), g AS (
            SELECT 'G' || k AS id, CASE WHEN k % 3 = 0 THEN 'CONFIGURED' ELSE 'SYNTHETIC_TEST_FIXTURE' END AS kind, 'S' || (k % 5) AS context, CASE WHEN k % 2 > 0 THEN 'h' || (k % 4) END AS hash FROM s
        ), t AS (
            SELECT 'T' || k AS id, 'G' || CASE WHEN k % 10 = 0 THEN k + 1000000 ELSE k END AS graph, CASE WHEN k % 4 = 0 THEN 'CONFIGURED' ELSE 'SYNTHETIC_TEST_FIXTURE' END AS kind, 'S' || (k % 6) AS context, CASE WHEN k % 2 > 0 THEN 'h' || (k % 3) END AS hash FROM s)
        SELECT id, 'asset_hash' AS "constraint" FROM g WHERE kind = 'CONFIGURED' AND hash IS NULL
        UNION ALL SELECT id, 'asset_hash' FROM t WHERE kind = 'CONFIGURED' AND hash IS NULL
        UNION ALL SELECT t.id, 'graph' FROM t WHERE graph NOT IN (SELECT id FROM g)
        UNION ALL SELECT t.id, 'data_kind' FROM t JOIN g ON g.id = t.graph WHERE t.kind <> g.kind
        UNION ALL SELECT t.id, 'spatial_context' FROM t JOIN g ON g.id = t.graph WHERE t.context <> g.context
        UNION ALL SELECT t.id, 'same_asset' FROM t JOIN g ON g.id = t.graph WHERE t.hash IS DISTINCT FROM g.hash""",
    "short_trajectories": "SELECT c_custkey AS trajectory_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 2",
    "eligible_cameras": "SELECT 'CAM_' || s_suppkey AS camera_id FROM supplier WHERE s_suppkey % 3 > 0",
    "outgoing_edges": "SELECT 'E07_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS edge_id, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS to_node_id FROM nation WHERE n_nationkey IN (2, 6, 8, 12)",
    "unknown_route_ends": "SELECT CAST(s_suppkey AS VARCHAR) AS request_id FROM supplier WHERE s_suppkey % 27 > 24",
    "unlocated_positions": """SELECT CAST(s_suppkey AS VARCHAR) AS request_id, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 THEN 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS node_id, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'INVALID_POSITION' END AS failure
        FROM supplier JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = s_nationkey % 5""",
    "orphan_blocks": "SELECT ['meshes', 'materials', 'images'][s_suppkey % 3 + 1] AS kind, count(*) AS n FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1",
    "plain_boxes": "SELECT ['AREA_', 'PORTAL_'][s_suppkey % 3 + 1] || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 10 > 0 AND s_suppkey % 4 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 7 > 0",
    "decoration": "SELECT ['Chair', 'Main Table'][s_suppkey % 4 + 1] || '_' || s_suppkey AS name, s_suppkey % 9 AS object_count FROM supplier WHERE s_suppkey % 4 < 2",
    "redacted_images": "SELECT s_suppkey AS k, ['a b.png', 'wall.jpg', '//tex/rel.png', 'https://host.example/i/p.png', 'tex/plain.png', 'y.exr'][s_suppkey % 6 + 1] AS filepath FROM supplier",
    "normalised_properties": """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN '{"a":{"url":"https://h.example/p"},"b":1}'
        ELSE '{"l":[true,null,{"basename":"b.txt","path_kind":"absolute_redacted_to_basename"}],"n":' || s_suppkey || ',"path":{"basename":"y.png","path_kind":"absolute_redacted_to_basename"}}' END AS properties FROM supplier""",
    "transformed_points": f"WITH {_matrix()} SELECT camera_id, {', '.join(_r6(_AT[a], a) for a in 'xyz')} FROM posed",
    "instance_bounds": f"WITH {_matrix()} SELECT camera_id, {', '.join(_r6(f't{a} {sign} {_SPAN[a]}', a + end) for a in 'xyz' for sign, end in (('-', 'min'), ('+', 'max')))} FROM posed",
    "frame_numbers": "SELECT s_suppkey AS k, 1 + s_suppkey * 25e-2 * 24 AS frame FROM supplier",
    "event_by_id": "SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, event_type FROM events WHERE event_id = 7",
}
