"""The engine's operators as queries over the scene; sql.py has the same rows in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import float_hex
from ..functions.columns import exceeds
from ..functions.exact import exact_sums
from ..operators import audit, constraints, endpoints, geometry, navigation, projection, raycasting, search, trajectory, visibility
from ..sources import readers
from ..streaming import gaps as streaming
from . import contracts, scene
from ..sources.tables import materialised, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def gap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three shortest feasible routes across every blind gap."""
    walks = search.bounded_walks(scene.transitions(spark, sf_dir), scene.edges(spark, sf_dir), scene.REACH)
    walks = walks.select(F.expr("cast(substring(start, 2) as int)").alias("start_camera"), F.expr("cast(substring(end, 2) as int)").alias("end_camera"), "rank", "corridor", "length")
    g = scene.gaps(spark, sf_dir).join(F.broadcast(walks), ["start_camera", "end_camera"])  # three rows for two cameras
    g = g.where(~exceeds(F.col("length"), F.lit(scene.SPEED) * F.col("gap_s")))
    minimum = F.least(F.col("length") / scene.SPEED, F.col("gap_s"))
    return g.select("target_id", "start_id", "end_id", F.col("rank").cast("int").alias("rank"), "corridor", "length", r6(minimum).alias("min_time"), r6(F.greatest(F.lit(0.0), F.col("gap_s") - minimum)).alias("slack"))


def gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.gaps(spark, sf_dir).withColumn("gap_s", r6(F.col("gap_s"))).drop("start_t", "end_t")


CONTEXT = {"spatial_context_id": "star-tables", "navigation_graph_id": "nations", "topology_id": "nations-as-cameras", "source_asset_sha256": "0" * 64}


def _searched(spark: SparkSession, sf_dir: str, **policy):
    requests = materialised(scene.search_requests(spark, sf_dir, **policy), "requests")
    return requests, *search.search(requests, scene.transitions(spark, sf_dir), scene.edges(spark, sf_dir))


def _terminations(spark: SparkSession, sf_dir: str, **policy) -> DataFrame:
    """How searches end; evidence at the ends of requests takes no part."""
    requests = materialised(scene.search_requests(spark, sf_dir, **policy).drop("start", "end"), "requests")
    return search.search(requests, scene.transitions(spark, sf_dir), scene.edges(spark, sf_dir))[0]


def _candidates(spark: SparkSession, sf_dir: str, **policy) -> DataFrame:
    requests, _, routes = _searched(spark, sf_dir, **policy)
    return search.candidates(routes, requests, scene.edges(spark, sf_dir), scene.nodes(spark, sf_dir), CONTEXT)


def gap_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every gap's search ends under the default bounds."""
    return _terminations(spark, sf_dir)


def _small_bounds() -> dict:
    """Bounds that differ from request to request, so that searches end for every reason."""
    n = "cast(start_id as bigint)"
    return {
        "max_search_nodes": F.expr(f"cast(element_at(array(10000, 7, 1, 60), cast({n} % 4 + 1 as int)) as int)"),
        "max_branch_factor": F.expr(f"if({n} % 5 = 0, 3, if({n} % 7 = 0, 2, 32))"),
        "max_paths": F.expr(f"cast({n} % 3 + 1 as int)"),
        "max_path_length_m": F.expr(f"element_at(array(14.0D, 30.0D, 9.0D), cast({n} % 3 + 1 as int))"),
        "max_detour_ratio": F.expr(f"if({n} % 2 = 0, 1.0D, 1.5D)"),
        "max_speed_m_s": F.expr(f"if({n} % 11 = 0, 0.01D, 1.5D)"),
    }


def gap_termination_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terminations(spark, sf_dir, **_small_bounds())


def gap_termination_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of routes of 14 m at most, for which SQL can make all walks."""
    return _terminations(spark, sf_dir, max_path_length_m=14.0)


def _shown(c: DataFrame) -> DataFrame:
    return c.select("request_id", "rank", "corridor", "path_length", r6(F.col("minimum_travel_time")).alias("minimum_travel_time"), r6(F.col("temporal_cost")).alias("temporal_cost"), "feasibility_flags", "provenance")


def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_candidates(spark, sf_dir))


def gap_candidates_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_candidates(spark, sf_dir, max_path_length_m=14.0))


def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("request_id", "rank", "candidate_id", F.size("polyline").alias("points"))


def candidate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the search that break their contract: none."""
    return constraints.violations(_candidates(spark, sf_dir), constraints.candidate_checks(), "candidate_id")


def _pairs(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    n = scene.nodes(spark, sf_dir).select(F.expr(f"replace(node_id, 'N', '{prefix}')").alias("id"))
    goals = n.agg(F.sort_array(F.collect_list("id")).alias("goals")).first()["goals"]  # 25 nations
    return n.select(F.col("id").alias("start_id"), F.explode(F.array(*map(F.lit, goals))).alias("goal_id")).withColumn("request_id", F.concat_ws(">", "start_id", "goal_id"))


def shortest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = navigation.shortest_paths(_pairs(spark, sf_dir, "N"), scene.edges(spark, sf_dir))
    return found.select("request_id", "distance", F.array_join("edge_ids", ",").alias("edge_ids"))


def min_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = navigation.minimum_hops(_pairs(spark, sf_dir, "C"), scene.transitions(spark, sf_dir))
    return found.select("request_id", "hops", F.array_join("transition_ids", ",").alias("transition_ids"))


def route_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = "lpad(cast({} as string), 2, '0')"
    step = "element_at(array(5, -1, 1), cast({} % 3 + 1 as int))"
    c = scene.table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as route_id", "c_nationkey as a", f"c_nationkey + {step.format('c_custkey')} as b", "c_custkey as k")
    c = c.selectExpr("route_id", "a", "b", f"if(k % 11 = 0, b + 1, b) as b2", f"b + {step.format('(k div 3)')} as c", "k")
    edge = lambda x, y: f"concat('E', {two.format(x)}, '_', {two.format(y)})"
    routes = c.selectExpr("route_id", f"concat('N', {two.format('a')}) as start_node_id", f"if(k % 13 = 0, cast(array() as array<string>), array({edge('a', 'b')}, {edge('b2', 'c')})) as edge_ids")
    out = navigation.route_polylines(routes, scene.edges(spark, sf_dir), scene.nodes(spark, sf_dir))
    line = F.array_join(F.transform("polyline", lambda p: F.concat_ws("/", p["x"].cast("int").cast("string"), p["z"].cast("int").cast("string"))), " ")
    return out.select("route_id", line.alias("line"), "distance", "failure")


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.located_requests(scene.raw_requests(spark, sf_dir), *scene.raw_observations(spark, sf_dir), scene.camera_nodes(spark, sf_dir), scene.nodes(spark, sf_dir))


def located_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations and requests between them: where a search would start and end, or the first check that fails."""
    found = _located(spark, sf_dir)
    passed = F.col("failure").isNull()
    return found.select("request_id", "failure", *(F.when(passed, F.col(c)).alias(c) for c in ("start_node", "end_node")), F.when(passed, r6(F.col("gap_s"))).alias("gap_s"))


def located_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches of those requests: how each ends, or why it does not begin. Routes of 14 m at most."""
    results, _ = search.checked_search(_located(spark, sf_dir), scene.transitions(spark, sf_dir), scene.edges(spark, sf_dir))
    return results.groupBy("failure", "termination_reason").agg(F.count("*").alias("n"))


def edge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.violations(scene.proposed_edges(spark, sf_dir), constraints.nav_edge_checks(), "edge_id")


def nav_graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.nav_graph_violations(scene.nodes(spark, sf_dir), scene.proposed_edges(spark, sf_dir))


def topology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.topology_violations(scene.camera_nodes(spark, sf_dir), scene.proposed_transitions(spark, sf_dir))


def network_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.network_violations(scene.nodes(spark, sf_dir), scene.edges(spark, sf_dir), scene.camera_nodes(spark, sf_dir), scene.proposed_transitions(spark, sf_dir))


def locate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scene.nodes(spark, sf_dir)
    twins = n.where("key % 5 = 3").withColumn("node_id", F.concat("node_id", F.lit("b")))
    positions = scene.table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as string) as request_id",
        "named_struct('x', 10.0D * (s_nationkey div 5) + (s_suppkey % 4) * 4e-7D, 'y', 0.0D, 'z', 4.0D * (s_nationkey % 5)) as position",
        "concat('F', cast(if(s_suppkey % 9 = 8, 7, s_nationkey % 5) as string)) as floor_id",
    )
    return navigation.locate_nodes(positions, n.drop("key").unionByName(twins.drop("key")))


def trajectory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trajectory.sample_trajectories(scene.keyframes(spark, sf_dir))
    return s.select("trajectory_id", F.col("sample_no").cast("long").alias("sample_no"), r6(F.col("timestamp")).alias("timestamp"), *(r6(F.col(c)).alias(c.lower()) for c in ("X", "Y", "Z", "VX", "VY", "VZ")), "floor_id", "zone_id", "semantic_region")


def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = scene.keyframes(spark, sf_dir)
    made = trajectory.sample_trajectories(k).groupBy("trajectory_id").agg(F.count("*").alias("samples"))
    return made.join(trajectory.expected_samples(k), "trajectory_id")


def unordered_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose price is not above the one before, as if prices were times."""
    o = scene.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return constraints.unordered(o, "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", "previous")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trajectory.sample_trajectories(scene.keyframes(spark, sf_dir)).select("trajectory_id", F.col("trajectory_id").cast("string").alias("target_id"), F.col("sample_no").alias("frame_id"), "timestamp", "X", "Y", "Z")
    return visibility.samples_by_camera(s, scene.cameras(spark, sf_dir), max_frames=None)


def samples_x_cameras_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projection.project_world(_points(spark, sf_dir))
    return p.select("target_id", F.col("frame_id").cast("long").alias("frame_id"), "camera_id", r6(F.col("depth")).alias("depth"), r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"), "reason")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.frames_among_boxes(_points(spark, sf_dir), scene.boxes(spark, sf_dir), "trajectory_id")


def gap_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return f.groupBy("camera_id", "status", F.coalesce("gap_reason", F.lit("-")).alias("gap_reason")).agg(F.count("*").alias("n"))


def visible_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).where("status = 'OBSERVED'")
    return f.select("target_id", F.col("frame_id").cast("long").alias("frame_id"), "camera_id", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"), "provenance")


def occluded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).where("gap_reason = 'OCCLUDED'")
    return f.select("target_id", F.col("frame_id").cast("long").alias("frame_id"), "camera_id", "occluder_id")


def frame_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of which some keep a pixel in a gap or lack a reason."""
    f = scene.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "if(event_type = 'error', 'GAP', if(event_id % 50 = 0, 'SEEN', 'OBSERVED')) as status",
        "if(event_type = 'error' and event_id % 3 > 0 or event_id % 7 = 0, null, named_struct('u', 1.0D, 'v', value)) as point_2d",
        "if(event_type = 'error', null, 'OBSERVED') as provenance",
        "if(event_type = 'error' and event_id % 5 > 0, 'OCCLUDED', null) as gap_reason",
        "cast(null as string) as occluder_id",
    )
    return constraints.violations(f, constraints.frame_checks(), "event_id")


def _inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.inverse_project(scene.pixel_frames(spark, sf_dir), scene.cameras(spark, sf_dir), planes=scene.planes(spark))


def inverse_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inverse(spark, sf_dir).select("frame_id", "plane_id", *(r6(F.col(a)).alias(a) for a in "xyz"), r6(F.col("projection_quality")).alias("quality"), "failure")


def projection_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inverse(spark, sf_dir).where("failure is not null").groupBy("camera_id", "failure").agg(F.count("*").alias("n"))


def projection_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that project back to within a millionth of a pixel, by camera."""
    p = _inverse(spark, sf_dir).where("failure is null").withColumnsRenamed({"u": "u0", "v": "v0"})
    back = projection.project_world(p.join(scene.cameras(spark, sf_dir), "camera_id"), "x", "y", "z")
    ok = F.col("in_frustum") & (F.abs(F.col("u") - F.col("u0")) < 1e-6) & (F.abs(F.col("v") - F.col("v0")) < 1e-6)
    return back.groupBy("camera_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("returned"))


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _inverse(spark, sf_dir).where("failure is null")
    return p.select("frame_id", "plane_id", projection.point_id(F.col("camera_id"), F.col("target_id"), F.col("frame_id"), F.col("timestamp"), F.col("plane_id")).alias("point_id"))


def segment_box_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raycasting.box_hits(scene.rays(spark, sf_dir), scene.boxes(spark, sf_dir), r6)


def ray_nearest_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raycasting.cast_rays(scene.rays(spark, sf_dir), scene.boxes(spark, sf_dir))


def ray_triangle_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rays against the triangles of rays that start outside all boxes. Where a ray starts is asked once an aim, and
    triangles are made once a shape: boxes of the same corners have the same."""
    boxes, rays = scene.boxes(spark, sf_dir), scene.rays(spark, sf_dir)
    shapes, aimed = raycasting.alike(boxes, "lo", "hi"), raycasting.aims(rays)
    inside = raycasting.Grid(shapes).met(raycasting.rays_with_direction(aimed)).where("entry <= 0").select("ray_id").distinct()
    outside = materialised(aimed.join(inside, "ray_id", "left_anti"), "aims-outside")
    return raycasting.cast_rays(raycasting.of_aims(rays, outside).drop("aim"), boxes, scene.box_triangles(shapes))


def instanced_ray_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rays against turned, stretched and flat instances of a few meshes, some of them hidden or left out."""
    triangles, meshes = scene.mesh_triangles(spark), scene.mesh_bounds(spark)
    return raycasting.cast_instanced(scene.rays(spark, sf_dir), scene.mesh_instances(spark, sf_dir), meshes, triangles, scene.excluded_objects(spark))


def ray_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raycasting.cast_rays(scene.rays(spark, sf_dir), scene.boxes(spark, sf_dir), max_candidates=4).groupBy("reason").agg(F.count("*").alias("n"))


def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.type_counts(scene.scene_objects(spark, sf_dir))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = audit.duplicate_groups(scene.scene_objects(spark, sf_dir), audit.normal_name(F.col("name")))
    return g.select("key", "n", F.array_join("names", ",").alias("names"), "truncated")


def shared_data_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = audit.duplicate_groups(scene.scene_objects(spark, sf_dir), F.concat_ws("/", "type", "p_brand"))
    return g.select("key", "n", F.array_join("names", ",").alias("names"), "truncated")


def geometry_signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scene.scene_objects(spark, sf_dir).where("type = 'MESH'")
    g = audit.duplicate_groups(o, F.concat_ws("/", F.col("vertices").cast("string"), F.col("polygons").cast("string"), F.col("collections")))
    return g.select("key", "n", "truncated")


def high_poly_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.high_poly(scene.scene_objects(spark, sf_dir)).select("name", "polygons", "vertices")


def top_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_meshes(scene.scene_objects(spark, sf_dir)).select("name", "polygons")


def semantic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tags(scene.scene_objects(spark, sf_dir))


def portal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.portal_overlaps(scene.portals(spark, sf_dir))


def collection_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scene.table(spark, sf_dir, "supplier").groupBy(F.expr("concat('N', s_nationkey)").alias("name")).agg(F.collect_set(F.expr("concat('S', s_suppkey % 7)")).alias("children"))
    return audit.parents(n).select("child", F.array_join("parents", ",").alias("parents"))


def z_layer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = geometry.horizontal(geometry.triangle_measures(scene.surfaces(spark, sf_dir)))
    return audit.z_layers(level).select(r6(F.col("z")).alias("z"), r6(F.col("area")).alias("area"), "triangles", "objects")


def layer_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = geometry.horizontal(geometry.triangle_measures(scene.surfaces(spark, sf_dir)))
    return audit.layer_faces(level).select(r6(F.col("z")).alias("z"), "rank", "name", "polygon_index", r6(F.col("area_3d")).alias("area"))


def slope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = geometry.triangle_measures(scene.surfaces(spark, sf_dir)).withColumn("clipped_area", F.col("area_3d") * F.col("normal_z"))
    s = geometry.slopes(t, "name")
    return s.select("name", *(r6(F.col(c)).alias(c) for c in ("clipped_xy_area", "slope_min", "slope_median", "slope_max", "z_min", "z_max")))


def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.polygons(geometry.triangle_measures(scene.surfaces(spark, sf_dir)))
    return p.select("name", "polygon_index", *(r6(F.col(c)).alias(c) for c in ("area", "xy_area", "z", "xmin", "xmax", "ymin", "ymax", "normal_z")))


def connected_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as polygons in rows of fifty; neighbours share a mesh edge."""
    p = scene.table(spark, sf_dir, "part").selectExpr("concat('OBJ', p_partkey div 50) as name", "cast(p_partkey as int) as polygon_index", "cast(p_size as double) as area", "((p_partkey div 7) % 3) * 0.2D as z", "cast(p_partkey as double) as xmin", "p_partkey + 1.0D as xmax", "0.0D as ymin", "1.0D as ymax")
    sides = p.select("name", "polygon_index", F.explode(F.expr("array(polygon_index, polygon_index + 1)")).alias("v1")).withColumn("v2", F.col("v1") + 1_000_000)
    found = audit.patches(p, audit.neighbours(sides))
    return found.select("name", "polygons", r6(F.col("area")).alias("area"), r6(F.col("z")).alias("z"), "xmin", "xmax")


def area_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.area_layers(scene.area_boxes(spark, sf_dir), geometry.triangle_measures(scene.surfaces(spark, sf_dir)))
    return found.select("area", r6(F.col("z")).alias("z"), r6(F.col("clipped_xy_area")).alias("clipped_xy_area"), r6(F.col("coverage")).alias("coverage"))


def _stairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.stair_triangles(scene.area_boxes(spark, sf_dir), geometry.triangle_measures(scene.surfaces(spark, sf_dir)))


def stair_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.stair_levels(_stairs(spark, sf_dir)).select("area", r6(F.col("z")).alias("z"), r6(F.col("clipped_xy_area")).alias("clipped_xy_area"), "up", "down")


def grid_surface_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = geometry.top_surface_grid(_stairs(spark, sf_dir))
    return geometry.clusters(tops, "area", "z", 0.5).select("area", "cluster", r6(F.col("mean")).alias("z_mean"), r6(F.col("min")).alias("z_min"), r6(F.col("max")).alias("z_max"), "n")


def height_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of suppliers' balances by nation."""
    s = scene.table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    return geometry.clusters(s, "s_nationkey", "s_acctbal", 500.0).select("s_nationkey", "cluster", r6(F.col("mean")).alias("mean"), "min", "max", "n")


def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = scene.boxes(spark, sf_dir)
    corners = b.select(F.lit("scene").alias("what"), "lo.*").unionByName(b.select(F.lit("scene").alias("what"), "hi.*"))
    return geometry.bounds(corners, "what")


def camera_height_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scene.table(spark, sf_dir, "supplier").selectExpr("concat('CAM_', cast(s_suppkey % 3 + 1 as int), 'F_', s_suppkey) as name", "s_acctbal / 100 as z")
    h = audit.camera_heights(c, {"CAM_1F_": 15.0, "CAM_2F_": 160.0})
    return h.select("floor", "n", *(r6(F.col(k)).alias(k) for k in ("z_min", "z_median", "z_max", "above_min", "above_median", "above_max")))


def camera_floor_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scene.table(spark, sf_dir, "supplier").selectExpr("concat(if(s_suppkey % 5 = 4, 'SKP_', 'CAM_'), s_nationkey % 3, 'F_HALL_', if(s_suppkey % 2 = 0, 'WEST', 'EAST'), if(s_suppkey % 3 = 0, '', concat('_', s_suppkey))) as name")
    floor, zone = projection.floor_and_zone(F.col("name"))
    return c.select("name", floor.alias("floor_id"), zone.alias("zone_id"))


def camera_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scene.table(spark, sf_dir, "part").selectExpr("p_partkey", "1920 as width", "1080 as height", "-p_size / 10.0D as left", "p_size / 8.0D as right", "-0.5D as bottom", "0.25D + p_size / 100.0D as top")
    return projection.intrinsics(v).select("p_partkey", *(r6(F.col(c)).alias(c) for c in ("fx", "fy", "cx", "cy")))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, ports = scene.scene_objects(spark, sf_dir), scene.portals(spark, sf_dir)
    o = objects.agg(
        F.count_if(F.col("name").startswith("AREA ")).alias("areas"), F.count_if(F.lower("name").contains("navmesh")).alias("navmesh_named"), F.count_if((F.col("type") == "MESH") & (F.col("polygons") >= audit.HIGH_POLY)).alias("high_poly"), F.countDistinct("p_brand").alias("materials"), F.count_if(F.col("name").startswith("Stair")).alias("stair_areas"),
    )
    p = ports.agg(F.count("*").alias("portals"), F.count_if(F.col("name").contains("STAIR")).alias("stair_portals"))
    overlaps = audit.portal_overlaps(ports).agg(F.count("*").alias("portal_overlaps"))
    walkable = audit.tags(objects).where("category = 'walkable'").agg(F.count("*").alias("walkable_tagged"))
    # suppliers as cameras, customers as lights, parts as images
    s = scene.table(spark, sf_dir, "supplier").agg(F.count_if(F.expr("s_suppkey % 3 < 2")).alias("research_cameras"), F.expr("min(if(s_suppkey % 3 < 2, 30 + s_suppkey, null))").alias("min_camera_z"), F.count_if(F.expr("s_suppkey % 3 = 2")).alias("imported_cameras"), F.count_if(F.expr("s_suppkey % 97 = 1")).alias("bad_intrinsics"))
    lights = scene.table(spark, sf_dir, "customer").agg(F.count_if(F.expr("c_custkey % 50 = 7")).alias("outer_lights"))
    images = scene.table(spark, sf_dir, "part").agg(F.count_if(F.expr("p_partkey % 2 = 0")).alias("images"), F.count_if(F.expr("p_partkey % 400 = 2")).alias("missing_images"), F.count_if(F.expr("p_partkey % 8 = 3 and p_size > 200")).alias("annotated_stair_areas"))
    m = None
    for d in (o, p, overlaps, walkable, s, lights, images):  # one row each
        m = d.withColumn("k", F.lit(1)) if m is None else m.join(d.withColumn("k", F.lit(1)), "k")
    m = m.selectExpr("*", "true as metric_units", "1.0D as unit_scale")
    return audit.findings(m).select("code", "severity", "n", "recommended_action")


def closed_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scene.table(spark, sf_dir, "events").selectExpr("event_id", "if(event_id % 10 = 0, replace(props, '{', '{\"extra\": 1, '), props) as props")
    return e.select("event_id", F.array_join(readers.unknown_fields(F.col("props"), ["k"]), ",").alias("unknown")).where("unknown <> ''")


def missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scene.proposed_edges(spark, sf_dir).select("edge_id", F.explode(F.array("from_node_id", "to_node_id")).alias("node_id"))
    return e.join(scene.nodes(spark, sf_dir), "node_id", "left_anti").select("edge_id", "node_id").distinct()


def observation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a camera that overlap a range, read as a provider would."""
    o = scene.observed(spark, sf_dir).groupBy("target_id", F.expr("concat('C', camera)").alias("camera_id")).agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"))
    return readers.observations_between(o, "C7", 1_704_500.0, 1_705_500.0).select("target_id", r6(F.col("start_time")).alias("start_time"), r6(F.col("end_time")).alias("end_time"))


def exact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.table(spark, sf_dir, "events").select("event_id", float_hex(F.col("value")).alias("value_hex"))


def exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discounts of each supplier's lines, added exactly among terms that are far larger and cancel."""
    line = scene.table(spark, sf_dir, "lineitem")
    large = F.pow(F.lit(2.0), 40 + F.col("l_orderkey") % 20)
    terms = line.select("l_suppkey", F.explode(F.array(F.col("l_extendedprice").cast("double") * F.col("l_discount").cast("double"), large, -large)).alias("term"))
    return exact_sums(terms, ["l_suppkey"], "term")


def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target's events at a camera as one observation; repeated times, errors and missing paths break its contract."""
    e = scene.table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as target_id", "event_id", "cast(event_id % 25 as string) as camera_id", "cast(floor(unix_micros(cast(ts as timestamp)) / 1e9D / 60) as double) as timestamp", "event_type")
    e = e.withColumn("observation_id", F.concat_ws("@", "target_id", "camera_id"))
    heads = e.groupBy("observation_id", "target_id", "camera_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.when(F.count("*") % 2 == 0, "PROJECTED").otherwise("OBSERVED").alias("provenance"))
    frames = e.select("observation_id", "timestamp", F.expr("if(event_type = 'error', 'GAP', 'OBSERVED')").alias("status"), "camera_id", "target_id")
    points = e.select("observation_id", F.expr("concat('p', event_id % 1000)").alias("point_id"), "timestamp", "camera_id", F.lit(None).cast("string").alias("of_observation"))
    checked = endpoints.checked_observations(heads, frames, points)
    return endpoints.observation_violations(checked).groupBy("constraint").agg(F.count("*").alias("n"))


def _events_as_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_as_stream(spark, sf_dir).where("event_type <> 'error'").selectExpr("user_id as target_id", "event_id as frame_id", "cast(event_id % 25 as int) as camera", "cast(ts as timestamp) as ts", "unix_micros(cast(ts as timestamp)) / 1e9D as t")


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    streaming.run_to_end(stream, f"{base}/checkpoint", f"{base}/out")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(streaming.gap_pairs(_stream(spark, sf_dir)), "gaps").withColumn("gap_s", r6(F.col("gap_s")))


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(streaming.observation_segments(_stream(spark, sf_dir)), "segments")


def stream_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of inverse_projection as a stream in which every seventh comes twice."""
    twice = _events_as_stream(spark, sf_dir).withColumn("copy", F.explode(F.expr("sequence(0, if(event_id % 7 = 0, 1, 0))")))
    frames = scene.frames_of_events(twice, F.expr("cast(ts as timestamp) as ts"))
    out = _run(streaming.projected_frames(frames, scene.cameras(spark, sf_dir), scene.planes(spark)), "projected")
    return out.select("frame_id", "plane_id", *(r6(F.col(a)).alias(a) for a in "xyz"), r6(F.col("projection_quality")).alias("quality"), "failure")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    gap_topk, gap_pairs, gap_termination, gap_termination_bounds, gap_termination_short, gap_candidates, gap_candidates_short, candidate_ids, candidate_violations, shortest_routes, min_hops, route_polylines, edge_violations, nav_graph_violations, topology_violations, network_violations, locate_nodes, located_requests, located_results,
    trajectory_samples, sample_counts, unordered_keyframes, samples_x_cameras_projection, gap_reason_counts, visible_frames, occluded_frames, frame_violations, inverse_projection, projection_rejects, projection_roundtrip, point_ids,
    segment_box_hits, ray_nearest_hit, ray_triangle_hit, instanced_ray_hit, ray_budget, object_counts, duplicate_groups, shared_data_groups, geometry_signature_groups, high_poly_objects, top_meshes, semantic_tags, portal_overlap, collection_parents,
    z_layer_histogram, layer_top5, slope_summary, polygon_measures, connected_patches, area_overlap, stair_levels, grid_surface_clusters, height_clusters, scene_bounds, camera_height_summary, camera_floor_zone, camera_intrinsics, findings,
    closed_schema_check, missing_endpoints, observation_windows, exact_times, exact_totals, observation_violations, stream_gap_pairs, stream_segments, stream_projection,
)} | contracts.QUERIES
