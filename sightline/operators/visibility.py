"""Visibility: samples against cameras, and the frames that come of casting rays between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised
from . import raycasting
from .projection import project_world

MAX_FRAMES = 100_000


def samples_by_camera(samples: DataFrame, cameras: DataFrame, max_frames: int | None = MAX_FRAMES) -> DataFrame:
    """Every sample with every camera: the cameras are a configuration table and travel as one array to each sample.

    The number of frames is checked before any is made; None lifts the check.
    """
    rows = cameras.select(F.struct(*cameras.columns).alias("camera")).agg(F.sort_array(F.collect_list("camera")).alias("cameras"), F.count("*").alias("n")).first()
    if max_frames is not None and samples.count() * rows["n"] > max_frames:
        raise ValueError("too many frames")
    if len({c["camera_id"] for c in rows["cameras"]}) < rows["n"]:
        raise ValueError("camera ids repeat")
    one = samples.sparkSession.createDataFrame([(rows["cameras"],)], f"cameras array<{cameras.select(F.struct(*cameras.columns).alias('c')).schema['c'].dataType.simpleString()}>")
    return samples.join(F.broadcast(one)).select(*samples.columns, F.explode("cameras").alias("camera")).select(*samples.columns, "camera.*")  # one row with all cameras


Raycaster = Callable[[DataFrame], DataFrame]
KEYS = ["frame_id", "timestamp", "target_id", "camera_id"]


def _point(x: str, y: str, z: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))


def observation_frames(points: DataFrame, raycaster: Raycaster | None = None) -> DataFrame:
    """frame_id, timestamp, target_id, camera_id, status, u, v, provenance, gap_reason, occluder_id: nothing of the 3D truth.

    points are samples with their camera's columns. Only points in the frustum are looked at; raycaster takes ray_id,
    origin, target and a column `frame`, and gives ray_id, occluded, reason, occluder_id for each. Where it hands on
    `frame` too, as the engine's own casters do, its answers are the frames; else they are joined with the points, and
    a ray without an answer is GEOMETRY_UNCERTAIN. Without a raycaster all rays are clear.
    """
    seen = project_world(points).withColumn("ray_id", F.concat_ws("|", "target_id", "camera_id", F.col("frame_id").cast("string")))
    frame = F.struct(*KEYS, "u", "v", F.when(~F.col("in_frustum"), F.col("reason")).alias("outside"))
    unseen = {"occluded": F.lit(False), "reason": F.lit("CLEAR"), "occluder_id": F.lit(None).cast("string")}
    if raycaster is None:
        answered = seen.select(frame.alias("frame"), *(c.alias(k) for k, c in unseen.items()))
    else:
        seen = materialised(seen.select("ray_id", _point("tx", "ty", "tz").alias("origin"), _point("X", "Y", "Z").alias("target"), frame.alias("frame")), "projected-points")
        rays, outside = seen.where("frame.outside is null"), seen.where("frame.outside is not null").select("frame", *(c.alias(k) for k, c in unseen.items()))
        answered = raycaster(rays)
        if "frame" not in answered.columns:
            answered = rays.select("ray_id", "frame").join(answered.select("ray_id", *unseen), "ray_id", "left")
        answered = answered.select("frame", *unseen).unionByName(outside)
    return _frames(answered.select("frame.*", *unseen))


def frames_among_boxes(points: DataFrame, boxes: DataFrame, *within: str) -> DataFrame:
    """observation_frames with rays cast against boxes (name, lo, hi) in one pass: frames are made, cast and told where the
    points lie, and written nowhere. within names columns of the points by which these lie hashed; target, camera and
    frame_id together differ from point to point."""
    seen = project_world(points)
    ends = (F.when(F.col("in_frustum"), p) for p in (_point("tx", "ty", "tz"), _point("X", "Y", "Z")))
    outside = F.when(~F.col("in_frustum"), F.col("reason"))
    rays = seen.select(F.col("frame_id").alias("ray_id"), *(p.alias(k) for p, k in zip(ends, ("origin", "target"))), "timestamp", "target_id", "camera_id", "u", "v", outside.alias("outside"), *within)
    answered = raycasting.cast_in_place(rays, boxes, within=(*within, "target_id", "camera_id"))
    return _frames(answered.withColumnRenamed("ray_id", "frame_id"))


def _frames(answered: DataFrame) -> DataFrame:
    """Frames from keys, u, v, outside and a ray's answer."""
    told = F.col("reason")
    blocked = F.coalesce(F.col("occluded"), F.lit(True)) | ~told.eqNullSafe(F.lit("CLEAR"))
    uncertain = F.when(told.isNull() | (told == "CLEAR"), F.lit("GEOMETRY_UNCERTAIN")).otherwise(told)
    gap = F.coalesce(F.col("outside"), F.when(blocked, uncertain))
    out = answered.withColumn("gap_reason", gap).withColumn("ok", gap.isNull())
    return out.select(
        *KEYS,
        F.when(F.col("ok"), "OBSERVED").otherwise("GAP").alias("status"),
        F.when(F.col("ok"), F.col("u")).alias("u"),
        F.when(F.col("ok"), F.col("v")).alias("v"),
        F.when(F.col("ok"), F.lit("OBSERVED")).alias("provenance"),
        "gap_reason",
        F.when(F.col("outside").isNull() & ~F.col("ok"), F.col("occluder_id")).alias("occluder_id"),
    )
