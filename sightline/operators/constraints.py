"""Contracts of the entities as named conditions. violations() lists what fails; enforce() fails the job instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import all_distinct, distance, finite, is_close, norm, pairs_of, segment_lengths, strictly_increasing, total

Checks = dict[str, Column]


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def violations(df: DataFrame, checks: Checks, *key: str) -> DataFrame:
    """key, constraint: a row for each condition that a row of df does not meet; null counts as not met."""
    failed = F.filter(F.array(*(F.when(~_holds(c), F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())
    return df.select(*key, F.explode(failed).alias("constraint"))


def enforce(df: DataFrame, checks: Checks, *key: str) -> DataFrame:
    """df unchanged; the job fails at the first row that breaks a condition, naming both."""
    message = F.concat_ws(" ", *(F.when(~_holds(c), F.lit(name)) for name, c in checks.items()))
    text = F.concat(F.lit("contract broken by "), F.concat_ws(",", *(F.col(k).cast("string") for k in key)), F.lit(": "), message)
    return df.where(F.when(message == "", F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def _present(name: str) -> Column:
    return F.length(name) >= 1


def camera_checks() -> Checks:
    c = F.col
    return {
        "camera_id": _present("camera_id"),
        "focal": finite(c("fx"), c("fy")) & (c("fx") > 0) & (c("fy") > 0),
        "image": (c("width") >= 1) & (c("height") >= 1),
        "clipping": finite(c("clip_start"), c("clip_end")) & (c("clip_start") > 0) & (c("clip_end") > c("clip_start")),
    }


def plane_checks() -> Checks:
    return {"plane_id": _present("plane_id"), "unit_normal": F.abs(norm(F.col("normal")) - 1) <= 1e-6}


def frame_checks() -> Checks:
    c = F.col
    seen, gap = c("status") == "OBSERVED", c("status") == "GAP"
    return {
        "status": seen | gap,
        "observed": ~seen | (c("point_2d").isNotNull() & c("provenance").eqNullSafe(F.lit("OBSERVED")) & c("gap_reason").isNull() & c("occluder_id").isNull()),
        "gap": ~gap | (c("point_2d").isNull() & c("provenance").isNull() & c("gap_reason").isNotNull()),
    }


def observation_checks() -> Checks:
    c = F.col
    frames, path = c("frames"), c("projected_path")
    inside = lambda t: (t >= c("start_time")) & (t <= c("end_time"))
    return {
        "window": c("end_time") >= c("start_time"),
        "provenance": F.when(c("provenance") == "PROJECTED", F.size(path) > 0).otherwise(F.size(path) == 0),
        "frame_order": strictly_increasing(F.transform(frames, lambda f: f["timestamp"])),
        "frames": F.forall(frames, lambda f: (f["status"] == "OBSERVED") & (f["camera_id"] == c("camera_id")) & (f["target_id"] == c("target_id")) & inside(f["timestamp"])),
        "path_order": strictly_increasing(F.transform(path, lambda p: p["timestamp"])),
        "point_ids": all_distinct(F.transform(path, lambda p: p["point_id"])),
        "path": F.forall(path, lambda p: (p["camera_id"] == c("camera_id")) & inside(p["timestamp"]) & (p["observation_id"].isNull() | (p["observation_id"] == c("observation_id")))),
    }


def nav_edge_checks() -> Checks:
    c = F.col
    line, kind = c("polyline"), c("transition_type")
    rise = pairs_of(line, lambda a, b: b["z"] - a["z"])
    net = F.element_at(line, -1)["z"] - F.element_at(line, 1)["z"]
    up, down = kind == "STAIR_UP", kind == "STAIR_DOWN"
    return {
        "self_edge": c("from_node_id") != c("to_node_id"),
        "two_points": F.size(line) >= 2,
        "repeated_point": F.forall(segment_lengths(line), lambda d: d > 0),
        "walk_without_stair": (kind != "WALK") | c("stair_id").isNull(),
        "stair_id": ~(up | down) | c("stair_id").isNotNull(),
        "ascends": ~up | (F.forall(rise, lambda d: d >= 0) & (net > 0)),
        "descends": ~down | (F.forall(rise, lambda d: d <= 0) & (net < 0)),
    }


def nav_path_checks() -> Checks:
    c = F.col
    n, lengths = F.size("edge_ids"), segment_lengths(c("polyline"))
    return {
        "counts": (n == F.size("transition_types")) & (n == F.size("node_ids") - 1),
        "empty_path": (n > 0) | ((F.size("polyline") == 1) & (c("distance") == 0)),
        "segments": (n == 0) | F.forall(lengths, lambda d: finite(d) & (d > 0)),
        "distance": (n == 0) | is_close(c("distance"), total(lengths)),
    }


def transition_checks() -> Checks:
    return {"self_transition": F.col("from_camera_id") != F.col("to_camera_id"), "cited_edges": (F.size("navigation_edge_ids") >= 1) & all_distinct(F.col("navigation_edge_ids"))}


def candidate_checks() -> Checks:
    return {"times": F.col("estimated_travel_time") >= F.col("minimum_travel_time"), "polyline": F.size("polyline") >= 2}


def result_checks() -> Checks:
    c = F.col
    return {
        "candidate_ids": all_distinct(F.transform("candidates", lambda x: x["candidate_id"])),
        "complete": c("complete") == c("termination_reason").isin("COMPLETE", "NO_FEASIBLE_PATH"),
        "empty": (c("termination_reason") != "NO_FEASIBLE_PATH") | (F.size("candidates") == 0),
    }


def event_checks() -> Checks:
    c = F.col
    ends = F.flatten(F.transform("candidates", lambda x: F.array(x["start_observation_id"], x["end_observation_id"])))
    return {
        "range": c("end_time") >= c("start_time"),
        "observations": (F.size("observation_ids") >= 1) & all_distinct(c("observation_ids")),
        "candidates": all_distinct(F.transform("candidates", lambda x: x["candidate_id"])),
        "endpoints": F.size(F.array_except(ends, c("observation_ids"))) == 0,
    }


def policy_checks() -> Checks:
    c = F.col
    return {"speed": finite(c("max_speed_m_s")) & (c("max_speed_m_s") > 0), "paths": c("max_candidate_paths") >= 1, "nodes": c("max_search_nodes") >= 1, "length": finite(c("max_path_length_m")) & (c("max_path_length_m") > 0), "branch": c("max_branch_factor") >= 1, "detour": finite(c("max_detour_ratio")) & (c("max_detour_ratio") >= 1)}


def unordered(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before it in its key's order: for keyframes and samples."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("previous", before).where(F.col("previous") >= F.col(value))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def too_few(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with fewer than `least` values, and how many they have."""
    return df.groupBy(key).agg(F.count(value).alias("n")).where(F.col("n") < least)


def binding_violations(graphs: DataFrame, topologies: DataFrame) -> DataFrame:
    """id, constraint: configured graphs and topologies without an asset hash, and topologies that name no graph or one of
    another kind, context or asset."""
    own = {"asset_hash": (F.col("data_kind") != "CONFIGURED") | F.col("source_asset_sha256").isNotNull()}
    g = graphs.select(F.col("graph_id").alias("navigation_graph_id"), F.lit(True).alias("there"), *(F.col(c).alias(f"g_{c}") for c in ("data_kind", "spatial_context_id", "source_asset_sha256")))
    both = topologies.join(g, "navigation_graph_id", "left")
    no = F.col("there").isNull()
    checks = own | {
        "graph": ~no,
        "data_kind": no | (F.col("data_kind") == F.col("g_data_kind")),
        "spatial_context": no | (F.col("spatial_context_id") == F.col("g_spatial_context_id")),
        "same_asset": no | F.col("source_asset_sha256").eqNullSafe(F.col("g_source_asset_sha256")),
    }
    return violations(graphs, own, "graph_id").toDF("id", "constraint").unionAll(violations(both, checks, "topology_id").toDF("id", "constraint"))


def nav_graph_violations(nodes: DataFrame, edges: DataFrame, cross_floor: str = "EXPLICIT_PARAMETERIZED_STAIRS") -> DataFrame:
    """id, constraint: repeated ids, missing endpoints, polylines that miss their nodes, and floors that the edge's kind forbids."""
    n = nodes.select("node_id", "floor_id", "position")
    a, b = n.toDF("from_node_id", "from_floor", "from_position"), n.toDF("to_node_id", "to_floor", "to_position")
    ends = edges.join(a, "from_node_id", "left").join(b, "to_node_id", "left")
    kind, stairs = F.col("transition_type"), F.col("transition_type").isin("STAIR_UP", "STAIR_DOWN")
    same = F.col("from_floor") == F.col("to_floor")
    there = F.col("from_floor").isNotNull() & F.col("to_floor").isNotNull()
    checks = {
        "endpoint": there,
        "joins_nodes": ~there | ((distance(F.element_at("polyline", 1), F.col("from_position")) == 0) & (distance(F.element_at("polyline", -1), F.col("to_position")) == 0)),
        "walk_floor": ~there | (kind != "WALK") | same,
        "stair_floor": ~there | ~stairs | ~same,
        "disconnected": ~there | same | F.lit(cross_floor != "DISCONNECTED"),
    }
    parts = [
        violations(ends, checks, "edge_id").toDF("id", "constraint"),
        repeated(nodes, "node_id").select(F.col("node_id").alias("id"), F.lit("repeated_node").alias("constraint")),
        repeated(edges, "edge_id").select(F.col("edge_id").alias("id"), F.lit("repeated_edge").alias("constraint")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def topology_violations(cameras: DataFrame, transitions: DataFrame) -> DataFrame:
    """id, constraint: repeated ids, missing cameras, floors and zones that the transition's type forbids."""
    c = cameras.select("camera_id", "floor_id", "zone_id")
    ends = transitions.join(c.toDF("from_camera_id", "from_floor", "from_zone"), "from_camera_id", "left").join(c.toDF("to_camera_id", "to_floor", "to_zone"), "to_camera_id", "left")
    there = F.col("from_floor").isNotNull() & F.col("to_floor").isNotNull()
    stairs = F.col("transition_type").isin("STAIR_UP", "STAIR_DOWN")
    checks = {
        "endpoint": there,
        "stairs_cross_floors": ~there | (stairs == (F.col("from_floor") != F.col("to_floor"))),
        "same_zone": (F.col("transition_type") != "SAME_ZONE") | F.coalesce(F.col("from_zone") == F.col("to_zone"), F.lit(False)),
    }
    parts = [
        violations(ends, checks, "transition_id").toDF("id", "constraint"),
        repeated(cameras, "camera_id").select(F.col("camera_id").alias("id"), F.lit("repeated_camera").alias("constraint")),
        repeated(transitions, "transition_id").select(F.col("transition_id").alias("id"), F.lit("repeated_transition").alias("constraint")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def network_violations(nodes: DataFrame, edges: DataFrame, cameras: DataFrame, transitions: DataFrame) -> DataFrame:
    """id, constraint: anchors that do not exist or stand on another floor than their camera, cited edges that are missing,
    do not follow each other or do not reach the anchor, and stairs that the transition's type forbids."""
    n = nodes.select("node_id", "floor_id", F.col("position.z").alias("z"))
    c = cameras.select("camera_id", "floor_id")
    t = (
        transitions.join(n.toDF("navigation_from_node_id", "a_floor", "a_z"), "navigation_from_node_id", "left")
        .join(n.toDF("navigation_to_node_id", "b_floor", "b_z"), "navigation_to_node_id", "left")
        .join(c.toDF("from_camera_id", "from_floor"), "from_camera_id", "left")
        .join(c.toDF("to_camera_id", "to_floor"), "to_camera_id", "left")
    )
    e = edges.select(F.col("edge_id"), "from_node_id", "to_node_id", F.col("transition_type").alias("edge_type"))
    cited = transitions.select("transition_id", "navigation_from_node_id", F.posexplode("navigation_edge_ids").alias("pos", "edge_id")).join(e, "edge_id", "left")
    before = F.lag("to_node_id").over(Window.partitionBy("transition_id").orderBy("pos"))
    cited = cited.withColumn("expected", F.when(F.col("pos") == 0, F.col("navigation_from_node_id")).otherwise(before))
    route = cited.groupBy("transition_id").agg(
        F.bool_and(F.col("from_node_id").isNotNull()).alias("edges_exist"),
        F.bool_and(F.coalesce(F.col("from_node_id") == F.col("expected"), F.lit(False))).alias("contiguous"),
        F.max_by("to_node_id", "pos").alias("reached"),
        F.bool_or(F.coalesce(F.col("edge_type") == "STAIR_UP", F.lit(False))).alias("has_up"),
        F.bool_or(F.coalesce(F.col("edge_type") == "STAIR_DOWN", F.lit(False))).alias("has_down"),
    )
    t = t.join(route, "transition_id", "left")
    kind, col = F.col("transition_type"), F.col
    checks = {
        "anchors_exist": col("a_floor").isNotNull() & col("b_floor").isNotNull(),
        "anchor_floor": (col("a_floor") == col("from_floor")) & (col("b_floor") == col("to_floor")),
        "edges_exist": col("edges_exist"),
        "contiguous": col("contiguous"),
        "reaches_anchor": col("reached") == col("navigation_to_node_id"),
        "stair_up": (kind != "STAIR_UP") | (col("has_up") & ~col("has_down") & (col("b_z") > col("a_z"))),
        "stair_down": (kind != "STAIR_DOWN") | (col("has_down") & ~col("has_up") & (col("b_z") < col("a_z"))),
        "no_stairs": kind.isin("STAIR_UP", "STAIR_DOWN") | (~col("has_up") & ~col("has_down")),
    }
    return violations(t, checks, "transition_id").toDF("id", "constraint")


def unbound_sources(truth: DataFrame, catalog: DataFrame) -> DataFrame:
    """Truth rows whose asset hash is not the catalogue's or that were not evaluated in the scene."""
    known = catalog.select("source_asset_sha256").distinct()
    bad = truth.join(known, "source_asset_sha256", "left_anti")
    return bad.unionByName(truth.where(F.col("sample_source") != "BLENDER_EVALUATED")).distinct()
