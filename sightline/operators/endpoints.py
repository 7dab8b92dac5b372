"""From observations to search requests: contracts of whole observations, and the endpoints that requests start from.

Observations come as three tables: their heads, their frames and their projected points. No list of an observation's
rows is made: every rule is a count or a conjunction that Spark combines before the shuffle, and order is looked at in
blocks of rows, with the blocks' edges compared afterwards, so that an observation of any length spreads over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import materialised
from .navigation import locate_nodes
from .search import endpoint_floor, request_failures

#: Rows of an observation that one window holds.
BLOCK_ROWS = 10_000
CHECKS = ("window", "provenance", "frame_order", "frames", "path_order", "point_ids", "path")


def ordered(rows: DataFrame, ordinal: str | None) -> DataFrame:
    """observation_id, ordered: whether timestamps increase strictly from row to row.

    Rows are numbered by ordinal, from 0 without gaps; without it they stand in the order of time, and only a repeated
    time breaks it. A null time breaks it too.
    """
    if ordinal is None:
        times = rows.groupBy("observation_id", "timestamp").agg(F.count("*").alias("n"))
        return times.groupBy("observation_id").agg(F.bool_and((F.col("n") == 1) & F.col("timestamp").isNotNull()).alias("ordered"))
    r = rows.select("observation_id", F.col(ordinal).cast("long").alias("no"), "timestamp").withColumn("block", F.expr(f"no div {BLOCK_ROWS}"))
    before = F.lag("timestamp").over(Window.partitionBy("observation_id", "block").orderBy("no"))
    inside = r.withColumn("before", before).withColumn("ok", F.col("timestamp").isNotNull() & F.coalesce(F.col("timestamp") > F.col("before"), F.col("before").isNull()))
    blocks = inside.groupBy("observation_id", "block").agg(F.bool_and("ok").alias("ok"), F.min_by("timestamp", "no").alias("first"), F.max_by("timestamp", "no").alias("last"))
    last = F.lag("last").over(Window.partitionBy("observation_id").orderBy("block"))
    joined = blocks.withColumn("last_before", last)
    return joined.groupBy("observation_id").agg(F.bool_and(F.col("ok") & F.coalesce(F.col("first") > F.col("last_before"), F.col("last_before").isNull())).alias("ordered"))


def checked_observations(observations: DataFrame, frames: DataFrame, points: DataFrame, ordinal: str | None = None) -> DataFrame:
    """observations with a column for each of CHECKS (that of provenance is provenance_met), true where the observation
    meets that part of its contract, n_frames and n_points.

    observations has observation_id, target_id, camera_id, start_time, end_time, provenance; frames has observation_id,
    timestamp, status, camera_id, target_id; points has observation_id, point_id, timestamp, camera_id and
    of_observation (null, or the observation that the point itself names). observation_id must differ from row to row.
    window: it ends no sooner than it starts. provenance: PROJECTED with points, or another without. frame_order,
    path_order: times increase strictly. frames: all OBSERVED, of the same camera and target, inside the window.
    point_ids: all different. path: of the same camera, inside the window, of no other observation. Nulls in what a
    rule looks at break it, and rows of frames and points without an observation are passed over.
    """
    head = observations.select("observation_id", F.col("camera_id").alias("own_camera"), F.col("target_id").alias("own_target"), "start_time", "end_time")
    inside = (F.col("timestamp") >= F.col("start_time")) & (F.col("timestamp") <= F.col("end_time"))
    true = lambda c: F.coalesce(c, F.lit(False))
    seen = frames.join(head, "observation_id").groupBy("observation_id").agg(
        F.count("*").alias("n_frames"), F.bool_and(true((F.col("status") == "OBSERVED") & (F.col("camera_id") == F.col("own_camera")) & (F.col("target_id") == F.col("own_target")) & inside)).alias("frames")
    )
    own = F.col("of_observation").isNull() | (F.col("of_observation") == F.col("observation_id"))
    laid = points.join(head, "observation_id").groupBy("observation_id").agg(F.count("*").alias("n_points"), F.bool_and(true((F.col("camera_id") == F.col("own_camera")) & inside & own)).alias("path"))
    ids = points.groupBy("observation_id", "point_id").agg(F.count("*").alias("n")).groupBy("observation_id").agg(F.bool_and((F.col("n") == 1) & F.col("point_id").isNotNull()).alias("point_ids"))
    parts = [seen, laid, ids, ordered(frames, ordinal).withColumnRenamed("ordered", "frame_order"), ordered(points, ordinal).withColumnRenamed("ordered", "path_order")]
    out = reduce(lambda a, b: a.join(b, "observation_id", "left"), parts, observations)
    projected = F.col("provenance") == "PROJECTED"
    out = out.withColumns({"n_frames": F.coalesce("n_frames", F.lit(0)), "n_points": F.coalesce("n_points", F.lit(0)), "window": true(F.col("end_time") >= F.col("start_time"))})
    out = out.withColumn("provenance_met", true(F.when(projected, F.col("n_points") > 0).otherwise(F.col("provenance").isNotNull() & (F.col("n_points") == 0))))
    none = {c: F.coalesce(c, F.lit(True)) for c in CHECKS if c not in ("window", "provenance")}  # nothing to look at breaks no rule
    return out.withColumns(none)


def observation_violations(checked: DataFrame) -> DataFrame:
    """observation_id, constraint: a row for each part of the contract that an observation of checked_observations breaks."""
    cases = F.array(*(F.when(~F.col("provenance_met" if c == "provenance" else c), F.lit(c)) for c in CHECKS))
    return checked.select("observation_id", F.explode(F.array_compact(cases)).alias("constraint"))


def located_requests(requests: DataFrame, observations: DataFrame, frames: DataFrame, points: DataFrame, cameras: DataFrame, nodes: DataFrame, tolerance: float = 1e-6, ordinal: str | None = None) -> DataFrame:
    """requests with what a search starts from, and failure: the first check that a request does not pass, else null.

    requests has request_id, start_observation_id, end_observation_id, max_paths, max_speed_m_s, and what else the
    search is to be told. observations, frames and points are as in checked_observations, with floor_id in the heads
    and floor_id and world_position (x, y, z) in the points. cameras has camera_id and floor_id, nodes node_id,
    floor_id and position. Added are start_ and end_ target, camera, floor, node, valid, failure, and gap_s, the time
    between the start's last point and the end's first.

    An observation must be there once, meet its contract, and be PROJECTED with points. Checks go in this order: the
    number of paths, both observations, one target, two observations, time between them; then for the start and after
    it for the end its floor (named, and the same by point and observation), the camera (known, and on that floor) and
    the one node within tolerance; then the numbers.
    """
    checked = checked_observations(observations, frames, points, ordinal)
    place = F.struct("timestamp", "floor_id", "world_position")
    ends = points.groupBy("observation_id").agg(F.min_by(place, "timestamp").alias("first_point"), F.max_by(place, "timestamp").alias("last_point"))
    met = reduce(lambda a, b: a & b, (F.col("provenance_met" if c == "provenance" else c) for c in CHECKS))
    once = observations.groupBy("observation_id").agg(F.count("*").alias("rows"))
    heads = checked.join(once, "observation_id").where("rows = 1").join(ends, "observation_id", "left")
    heads = materialised(heads.select("observation_id", "target_id", "camera_id", F.col("floor_id").alias("own_floor"), (met & (F.col("provenance") == "PROJECTED") & (F.col("n_points") > 0)).alias("valid"), "first_point", "last_point"), "observation-heads")
    out = requests
    for end, point in (("start", "last_point"), ("end", "first_point")):
        floor, failure = endpoint_floor(F.col("own_floor"), F.col(f"{point}.floor_id"))
        side = heads.select(F.col("observation_id").alias(f"{end}_observation_id"), F.col("target_id").alias(f"{end}_target"), F.col("camera_id").alias(f"{end}_camera"), F.col("valid").alias(f"{end}_valid"), F.col(f"{point}.timestamp").alias(f"{end}_time"), F.col(f"{point}.world_position").alias(f"{end}_position"), floor.alias(f"{end}_floor"), failure.alias(f"{end}_failure"))
        known = cameras.select(F.col("camera_id").alias(f"{end}_camera"), F.col("floor_id").alias(f"{end}_camera_floor"), F.lit(True).alias(f"{end}_known"))
        out = out.join(side, f"{end}_observation_id", "left").join(known, f"{end}_camera", "left")
        out = out.withColumn(f"{end}_failure", F.coalesce(F.col(f"{end}_failure"), F.when(F.col(f"{end}_known").isNull(), "UNKNOWN_CAMERA"), F.when(~F.col(f"{end}_camera_floor").eqNullSafe(F.col(f"{end}_floor")), "ENDPOINT_FLOOR_MISMATCH")))
    out = materialised(out.withColumn("gap_s", F.col("end_time") - F.col("start_time")).drop("start_known", "end_known", "start_camera_floor", "end_camera_floor"), "endpoints")
    for end in ("start", "end"):
        asked = out.where(F.col(f"{end}_failure").isNull() & F.col(f"{end}_valid")).select("request_id", F.col(f"{end}_position").alias("position"), F.col(f"{end}_floor").alias("floor_id"))
        found = locate_nodes(asked, nodes, tolerance).select("request_id", F.col("node_id").alias(f"{end}_node"))
        out = out.join(found, "request_id", "left")
    return request_failures(out)
