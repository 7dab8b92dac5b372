"""Scene audit: inventories, duplicates, connected patches, tags and findings."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import bin_of
from ..functions.exact import exact_medians
from ..sources.tables import materialised
from .geometry import LAYER, top_per_group

NAMES_SHOWN = 100
HIGH_POLY = 50_000
MIN_PATCH_AREA = 0.05

#: Words that tag an object by its name or collections, each between non-letters.
TAG_WORDS = {
    "floor": ("floor", "ground", "slab", "deck"),
    "wall": ("wall",),
    "stair": ("stair", "stairs", "staircase", "step"),
    "walkable": ("walkable", "walkway", "navmesh", "navigation", "corridor", "hallway", "path"),
    "semantic_area": ("area",),
    "portal": ("portal", "door", "entrance", "exit"),
}
#: A name with one of these is no wall.
NOT_A_WALL = ("wall lamp", "wall clock", "on-wall", "speaker")
#: Words of collections that furnish or decorate.
MAX_DEPTH, MAX_KEYS = 8, 200
DECORATION = ("book", "box", "chair", "clock", "poster", "sofa", "table", "cabinet", "carpet", "garland", "lectern", "speaker", "trash", "trolley")
#: Findings and their severity.
SEVERITY = {
    "UNIT_SCALE_REVIEW_REQUIRED": "blocking_for_metric_evaluation",
    "IMPORTED_CAMERA_REVIEW_CANDIDATE": "review",
    "NONFINITE_CAMERA_INTRINSICS": "blocking_for_camera_allowlist",
    "AREA_PORTAL_BOXES_ARE_NOT_WALKABLE_GEOMETRY": "blocking_for_automatic_navmesh",
    "STAIR_TRANSITION_METADATA_MISSING": "blocking_for_cross_floor_topology",
    "CROSS_FLOOR_PORTAL_TRANSFORM_OVERLAP": "scene_data_review",
    "NO_EXPLICIT_NAVMESH_OBJECT": "blocking_for_automatic_navmesh",
    "HIGH_POLY_OBJECTS": "performance_review",
    "OUTER_LIGHT_GRID_NOT_REQUIRED_FOR_GEOMETRY": "review",
    "LARGE_APPEARANCE_ASSET_SET": "performance_review",
    "MISSING_EXTERNAL_IMAGES": "render_review",
}


def type_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("type").agg(F.count("*").alias("n"), F.sum("vertices").alias("vertices"), F.sum("polygons").alias("polygons"))


def normal_name(name: Column) -> Column:
    """A name without its numbered copy's ending, in lower case."""
    return F.lower(F.regexp_replace(name, r"\.\d{3}$", ""))


def duplicate_groups(objects: DataFrame, key: Column, limit: int = NAMES_SHOWN) -> DataFrame:
    """key, n, names, truncated of keys that several objects share: the first names in order. Names are ranked before
    they are gathered, so a group's list never holds more than the limit."""
    keyed = objects.where(key.isNotNull()).select(key.alias("key"), "name")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shown = top_per_group(keyed.join(counts.select("key"), "key", "left_semi"), ["key"], ["name"], limit)
    names = shown.groupBy("key").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return counts.join(names, "key").withColumn("truncated", F.col("n") > limit)


def z_layers(horizontal: DataFrame) -> DataFrame:
    """z, area, triangles, objects of horizontal triangles in layers of LAYER."""
    return horizontal.groupBy(bin_of(F.col("z_mean"), LAYER).alias("z")).agg(F.sum("area_3d").alias("area"), F.count("*").alias("triangles"), F.countDistinct("name").alias("objects"))


def layer_faces(horizontal: DataFrame, k: int = 5) -> DataFrame:
    """The k largest faces of each layer."""
    faces = horizontal.withColumn("z", bin_of(F.col("z_mean"), LAYER))
    return top_per_group(faces, ["z"], [F.desc("area_3d"), F.desc("name"), F.desc("polygon_index")], k)


def neighbours(polygon_edges: DataFrame) -> DataFrame:
    """name, a, b: polygons of an object that share a mesh edge (name, polygon_index, v1, v2), each pair once."""
    e = polygon_edges.select("name", "polygon_index", F.least("v1", "v2").alias("lo"), F.greatest("v1", "v2").alias("hi")).distinct()
    return e.select("name", "lo", "hi", F.col("polygon_index").alias("a")).join(e.select("name", "lo", "hi", F.col("polygon_index").alias("b")), ["name", "lo", "hi"]).where("a < b").select("name", "a", "b").distinct()


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, component: the least id that links (a, b) reach. Labels hook along links and jump pointers, a written table a round."""
    both = materialised(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialised(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        seen = both.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
        apart = materialised(seen.where("la <> lb").select("a", "la", "lb"), "apart")
        if apart.isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        hooks = apart.select(F.col("a").alias("id"), "lb").unionAll(apart.select(F.col("la").alias("id"), "lb")).groupBy("id").agg(F.min("lb").alias("hook"))
        hooked = materialised(labels.join(hooks, "id", "left").select("id", F.least("label", "hook").alias("label")), "hooked")
        jump = hooked.toDF("label", "root")
        labels = materialised(hooked.join(jump, "label", "left").select("id", F.least("label", "root").alias("label")), "labels")


def patches(polygons: DataFrame, adjacent: DataFrame) -> DataFrame:
    """component, name, polygons, area, z, bounds of near-horizontal polygons joined where heights differ by LAYER at most; small patches go."""
    p = polygons.withColumn("id", F.concat_ws("#", "name", F.lpad(F.col("polygon_index").cast("string"), 12, "0")))
    z = p.select("name", F.col("polygon_index"), "z", "id")
    links = adjacent.join(z.toDF("name", "a", "za", "ida"), ["name", "a"]).join(z.toDF("name", "b", "zb", "idb"), ["name", "b"]).where(F.abs(F.col("za") - F.col("zb")) <= LAYER)
    found = connected(p.select("id"), links.select(F.col("ida").alias("a"), F.col("idb").alias("b")))
    return (
        p.join(found, "id")
        .groupBy("component", "name")
        .agg(F.count("*").alias("polygons"), F.sum("area").alias("area"), (F.sum(F.col("area") * F.col("z")) / F.sum("area")).alias("z"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
        .where(F.col("area") >= MIN_PATCH_AREA)
    )


def tags(objects: DataFrame) -> DataFrame:
    """name, category, basis, confidence of objects (name, collections text, type, dx, dy, dz)."""
    text = F.lower(F.concat_ws(" ", "name", "collections"))
    no_wall = F.lit(False)
    for token in NOT_A_WALL:
        no_wall = no_wall | text.contains(token)
    named = []
    for category, words in TAG_WORDS.items():
        hit = text.rlike("(?:^|[^a-z])(" + "|".join(words) + ")(?:$|[^a-z])")
        hit = hit & ~no_wall if category == "wall" else hit
        named.append(F.when(hit, F.struct(F.lit(category).alias("category"), F.lit("name_or_collection").alias("basis"), F.lit("review_required").alias("confidence"))))
    dx, dy, dz = (F.abs(F.col(c)) for c in ("dx", "dy", "dz"))
    mesh = F.col("type") == "MESH"
    flat = mesh & (dz <= F.greatest(F.lit(0.01), F.least(dx, dy) * 0.05)) & (dx * dy >= 10_000)
    upright = mesh & (dz >= 50) & (F.least(dx, dy) <= F.greatest(F.lit(1.0), F.greatest(dx, dy) * 0.05))
    for hit, category in ((flat, "large_horizontal_surface"), (upright, "vertical_barrier")):
        named.append(F.when(hit, F.struct(F.lit(category).alias("category"), F.lit("dimensions_only").alias("basis"), F.lit("low").alias("confidence"))))
    found = F.filter(F.array(*named), lambda t: t.isNotNull())
    return objects.select("name", F.explode(found).alias("t")).select("name", "t.*")


def high_poly(objects: DataFrame, threshold: int = HIGH_POLY) -> DataFrame:
    return objects.where((F.col("type") == "MESH") & (F.col("polygons") >= threshold))


def top_meshes(objects: DataFrame, k: int = 30) -> DataFrame:
    return objects.where(F.col("type") == "MESH").orderBy(F.desc("polygons"), "name").limit(k)


def portal_overlaps(objects: DataFrame) -> DataFrame:
    """names, x, y, z of places with portals of both floors: same location and size to six decimals."""
    p = objects.where(F.col("name").startswith("PORTAL_"))
    place = [F.bround(c, 6).alias(c) for c in ("x", "y", "z")] + [F.bround(F.abs(F.col(c)), 6).alias(c) for c in ("dx", "dy", "dz")]
    g = p.groupBy(*place).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.bool_or(F.col("name").startswith("PORTAL_1F_")).alias("on_1f"), F.bool_or(F.col("name").startswith("PORTAL_2F_")).alias("on_2f"))
    return g.where("on_1f and on_2f").select("names", "x", "y", "z")


def camera_heights(cameras: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Heights of cameras by name prefix, and above the floor given for it."""
    levels = F.create_map(*(F.lit(x) for kv in floors.items() for x in kv))
    prefix = F.coalesce(*(F.when(F.col("name").startswith(f), F.lit(f)) for f in floors))
    c = cameras.withColumn("floor", prefix).where(F.col("floor").isNotNull())
    g = c.groupBy("floor").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max")).join(exact_medians(c, ["floor"], "z", "z_median"), "floor")
    return g.withColumns({f"above_{s}": F.col(f"z_{s}") - levels[F.col("floor")] for s in ("min", "median", "max")})


def orphans(blocks: DataFrame) -> DataFrame:
    """kind, n of datablocks without users."""
    return blocks.where("users = 0").groupBy("kind").agg(F.count("*").alias("n"))


def parents(collections: DataFrame) -> DataFrame:
    """child, parents: the collections (name, children) that hold each child."""
    return collections.select(F.explode("children").alias("child"), "name").groupBy("child").agg(F.array_sort(F.collect_set("name")).alias("parents"))


def decoration_collections(collections: DataFrame) -> DataFrame:
    return collections.where(F.lower("name").rlike("|".join(DECORATION))).select("name", "object_count")


def simple_boxes(objects: DataFrame) -> DataFrame:
    """Plain unannotated boxes among areas and portals."""
    named = F.col("name").startswith("AREA_") | F.col("name").startswith("PORTAL_")
    return objects.where(named & (F.col("type") == "MESH") & (F.col("vertices") == 8) & (F.col("polygons") == 6) & (F.col("material_slots") == 0) & ~F.col("has_properties"))


def redacted_path(path: Column) -> Column:
    """An absolute path without its folders, an address without query and fragment; // begins a path relative to the scene."""
    plain = F.regexp_replace(path, r"[?#].*$", "")
    return F.when(plain.rlike(r"^(/(?!/)|[A-Za-z]:[\\/])"), F.element_at(F.split(plain, r"[/\\]"), -1)).otherwise(plain)


@F.pandas_udf(T.StringType())
def normal_json(text: pd.Series) -> pd.Series:
    """A JSON value with sorted keys, at most MAX_KEYS an object and MAX_DEPTH deep; addresses lose their query, absolute
    paths all but their last part."""

    def normal(value: object, depth: int) -> object:
        if depth >= MAX_DEPTH:
            return {"truncated_type": type(value).__name__, "reason": "maximum_depth"}
        if isinstance(value, dict):
            return {k: normal(value[k], depth + 1) for k in sorted(value)[:MAX_KEYS]}
        if isinstance(value, list):
            return [normal(v, depth + 1) for v in value]
        if isinstance(value, str) and re.match(r"https?://", value):
            return re.split(r"[?#]", value, maxsplit=1)[0]
        if isinstance(value, str) and re.match(r"/|[A-Za-z]:[\\/]", value):
            return {"path_kind": "absolute_redacted_to_basename", "basename": re.split(r"[\\/]", value)[-1]}
        return None if isinstance(value, float) and not math.isfinite(value) else value

    return text.map(lambda t: None if t is None else json.dumps(normal(json.loads(t), 0), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def missing_images(images: DataFrame) -> DataFrame:
    return images.where("not packed and not exists").select("name", redacted_path(F.col("filepath")).alias("filepath"))


def findings(metrics: DataFrame) -> DataFrame:
    """code, severity, n of the rules that one row of metrics meets, with the attributes that all findings share."""
    c = F.col
    rules = {
        "UNIT_SCALE_REVIEW_REQUIRED": (c("metric_units") & (c("unit_scale") == 1.0) & (c("research_cameras") > 0) & (c("min_camera_z") > 20), c("research_cameras")),
        "IMPORTED_CAMERA_REVIEW_CANDIDATE": (c("imported_cameras") > 0, c("imported_cameras")),
        "NONFINITE_CAMERA_INTRINSICS": (c("bad_intrinsics") > 0, c("bad_intrinsics")),
        "AREA_PORTAL_BOXES_ARE_NOT_WALKABLE_GEOMETRY": (c("areas") + c("portals") > 0, c("areas") + c("portals")),
        "STAIR_TRANSITION_METADATA_MISSING": ((c("stair_areas") > 0) & (c("stair_portals") == 0) & (c("annotated_stair_areas") == 0), c("stair_areas")),
        "CROSS_FLOOR_PORTAL_TRANSFORM_OVERLAP": (c("portal_overlaps") > 0, c("portal_overlaps")),
        "NO_EXPLICIT_NAVMESH_OBJECT": (c("navmesh_named") == 0, c("walkable_tagged")),
        "HIGH_POLY_OBJECTS": (c("high_poly") > 0, c("high_poly")),
        "OUTER_LIGHT_GRID_NOT_REQUIRED_FOR_GEOMETRY": (c("outer_lights") > 0, c("outer_lights")),
        "LARGE_APPEARANCE_ASSET_SET": ((c("materials") >= 100) | (c("images") >= 100), c("materials") + c("images")),
        "MISSING_EXTERNAL_IMAGES": (c("missing_images") > 0, c("missing_images")),
    }
    rows = [F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), n.cast("long").alias("n"))) for code, (rule, n) in rules.items()]
    found = metrics.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("f")).select("f.*")
    return found.withColumns({"confidence": F.lit("high"), "status": F.lit("candidate"), "recommended_action": F.lit("manual_review_only"), "destructive_action_authorized": F.lit(False)})
