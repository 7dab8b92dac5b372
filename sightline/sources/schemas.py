"""Spark schemas of the entities and the enumerations of the API."""

from __future__ import annotations

V3 = "STRUCT<x:DOUBLE,y:DOUBLE,z:DOUBLE>"
P2 = "STRUCT<u:DOUBLE,v:DOUBLE>"
_KEYFRAME = f"STRUCT<timestamp:DECIMAL(38,18),position:{V3},floor_id:STRING,zone_id:STRING,semantic_region:STRING>"
_FRAME = f"frame_id:INT,timestamp:DOUBLE,target_id:STRING,camera_id:STRING,status:STRING,point_2d:{P2},provenance:STRING,gap_reason:STRING,occluder_id:STRING,data_kind:STRING"
_POINT = f"point_id:STRING,camera_id:STRING,plane_id:STRING,timestamp:DOUBLE,world_position:{V3},projection_quality:DOUBLE,floor_id:STRING,zone_id:STRING,observation_id:STRING,provenance:STRING"


def _columns(fields: str) -> str:
    """A struct's fields as a table's columns."""
    out, depth = [], 0
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        out.append(" " if ch == ":" and not depth else ch)
    return "".join(out)


CAMERAS = "camera_id STRING, camera_to_world ARRAY<ARRAY<DOUBLE>>, fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE, width INT, height INT, clip_start DOUBLE, clip_end DOUBLE, convention STRING, pixel_origin STRING, meters_per_unit DOUBLE, floor_id STRING, zone_id STRING"
PLANES = f"plane_id STRING, point {V3}, normal {V3}, floor_id STRING, zone_id STRING"
TRAJECTORY_CONFIGS = f"trajectory_id STRING, target_id STRING, scene_id STRING, random_seed INT, sample_rate_hz INT, keyframes ARRAY<{_KEYFRAME}>"
GROUND_TRUTH_COLUMNS = ("trajectory_id", "target_id", "scene_id", "data_kind", "sample_source", "source_asset_name", "source_asset_sha256", "random_seed", "sample_rate_hz", "timestamp", "X", "Y", "Z", "VX", "VY", "VZ", "floor_id", "zone_id", "semantic_region", "provenance")
OBSERVATION_FRAMES = _columns(_FRAME)
PROJECTED_POINTS = _columns(_POINT)
OBSERVATIONS = f"observation_id STRING, target_id STRING, camera_id STRING, start_time DOUBLE, end_time DOUBLE, floor_id STRING, zone_id STRING, frames ARRAY<STRUCT<{_FRAME}>>, projected_path ARRAY<STRUCT<{_POINT}>>, provenance STRING"
NAV_NODES = f"node_id STRING, position {V3}, floor_id STRING, zone_id STRING"
NAV_EDGES = f"edge_id STRING, from_node_id STRING, to_node_id STRING, polyline ARRAY<{V3}>, transition_type STRING, stair_id STRING, walkable BOOLEAN"
CAMERA_NODES = "camera_id STRING, floor_id STRING, zone_id STRING"
CAMERA_TRANSITIONS = "transition_id STRING, from_camera_id STRING, to_camera_id STRING, transition_type STRING, navigation_from_node_id STRING, navigation_to_node_id STRING, navigation_edge_ids ARRAY<STRING>"
SEARCH_REQUESTS = "request_id STRING, start_camera STRING, start_node STRING, end_camera STRING, end_node STRING, gap_s DOUBLE, max_speed_m_s DOUBLE, max_paths INT, max_candidate_paths INT, max_search_nodes INT, max_path_length_m DOUBLE, max_branch_factor INT, max_detour_ratio DOUBLE"
MESH_INSTANCES = f"name STRING, lo {V3}, hi {V3}"
MESH_TRIANGLES = f"name STRING, polygon_index INT, a {V3}, b {V3}, c {V3}"

_PROPERTIES = "custom_properties STRING"
_PLACED = f"location {V3}, rotation_euler_radians {V3}, scale {V3}, hide_viewport BOOLEAN, hide_render BOOLEAN, linked_collections ARRAY<STRING>, {_PROPERTIES}"
#: The tables of an exported scene inventory; custom properties are JSON.
INVENTORY = {
    "objects": f"name STRING, type STRING, data_name STRING, in_active_scene BOOLEAN, display_type STRING, parent STRING, dimensions {V3}, matrix_world ARRAY<ARRAY<DOUBLE>>, mesh STRUCT<vertices:BIGINT,edges:BIGINT,polygons:BIGINT,loops:BIGINT>, material_slots ARRAY<STRING>, {_PLACED}",
    "cameras": f"object_name STRING, data_name STRING, active_in_scenes ARRAY<STRING>, matrix_world_camera_to_world ARRAY<ARRAY<DOUBLE>>, forward_world {V3}, up_world {V3}, projection_type STRING, lens_mm DOUBLE, lens_is_finite BOOLEAN, sensor_fit STRING, sensor_width_mm DOUBLE, sensor_height_mm DOUBLE, shift_x DOUBLE, shift_y DOUBLE, clip_start DOUBLE, clip_end DOUBLE, angle_x_radians DOUBLE, angle_y_radians DOUBLE, {_PLACED}",
    "lights": f"object_name STRING, data_name STRING, type STRING, energy DOUBLE, color {V3}, {_PLACED}",
    "images": "name STRING, source STRING, filepath STRING, path_kind STRING, exists BOOLEAN, packed BOOLEAN, packed_file_count INT, width INT, height INT, channels INT, depth INT, file_format STRING, colorspace STRING, users INT, use_fake_user BOOLEAN",
    "collections": f"name STRING, parents ARRAY<STRING>, children ARRAY<STRING>, direct_object_count INT, all_object_count INT, direct_object_names ARRAY<STRING>, hide_viewport BOOLEAN, hide_render BOOLEAN, instance_offset {V3}, {_PROPERTIES}",
    "materials": f"name STRING, users INT, use_nodes BOOLEAN, object_users ARRAY<STRING>, {_PROPERTIES}",
    "meshes": f"name STRING, users INT, vertices BIGINT, edges BIGINT, polygons BIGINT, loops BIGINT, material_names ARRAY<STRING>, shape_keys STRING, {_PROPERTIES}",
}

#: The enumerations of the API.
PROVENANCE = ("OBSERVED", "PROJECTED", "INFERRED_GAP", "GROUND_TRUTH")
PROJECTION_REASONS = ("IN_FRUSTUM", "BEHIND_CAMERA", "NEAR_CLIPPED", "FAR_CLIPPED", "OUTSIDE_FOV")
VISIBILITY = ("OBSERVED", "GAP")
GAP_REASONS = ("BEHIND_CAMERA", "NEAR_CLIPPED", "FAR_CLIPPED", "OUTSIDE_FOV", "OCCLUDED", "GEOMETRY_UNCERTAIN", "RAYCAST_LIMIT")
RAY_REASONS = ("CLEAR", "OCCLUDED", "GEOMETRY_UNCERTAIN", "RAYCAST_LIMIT")
NAV_TRANSITIONS = ("WALK", "STAIR_UP", "STAIR_DOWN")
CAMERA_TRANSITION_TYPES = ("ADJACENT", "OVERLAPPING_FOV", "SAME_ZONE", "STAIR_UP", "STAIR_DOWN")
DATA_KINDS = ("CONFIGURED", "SYNTHETIC_TEST_FIXTURE")
TERMINATIONS = ("COMPLETE", "NO_FEASIBLE_PATH", "MAX_PATHS_REACHED", "MAX_SEARCH_NODES", "MAX_BRANCH_FACTOR", "SEARCH_TIMEOUT")
FEASIBILITY_FLAGS = ("CAMERA_REACHABLE", "TOPOLOGY_AUTHORIZED", "WALKABLE", "WITHIN_MAX_SPEED")
#: Defaults of a search's bounds.
SEARCH_DEFAULTS = {"max_candidate_paths": 3, "max_search_nodes": 10_000, "max_path_length_m": 1000.0, "max_search_time_s": 1.0, "max_branch_factor": 32, "max_detour_ratio": 2.0}
