"""Scans: JSON documents with closed schemas, catalogues, fingerprints and point reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file under a fixed schema; a document that does not fit fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory configurations, a row a keyframe in order."""
    doc = read_document(spark, path, schemas.TRAJECTORY_CONFIGS)
    keep = [c for c in doc.columns if c != "keyframes"]
    return doc.select(*keep, F.posexplode("keyframes").alias("keyframe_no", "k")).select(*keep, "keyframe_no", "k.*")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Samples of exported ground truth, a row a sample."""
    sample = f"STRUCT<timestamp:DOUBLE,position:{schemas.V3},velocity:{schemas.V3},floor_id:STRING,zone_id:STRING,semantic_region:STRING,provenance:STRING>"
    doc = read_document(spark, path, f"trajectory_id STRING, target_id STRING, scene_id STRING, source_asset_sha256 STRING, sample_source STRING, samples ARRAY<{sample}>")
    return doc.select("trajectory_id", "target_id", "scene_id", "source_asset_sha256", "sample_source", F.posexplode("samples").alias("sample_no", "s")).select("*", "s.*").drop("s")


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """The cameras of a catalogue; a count that differs from the catalogue's own fails."""
    row = schemas.CAMERAS.replace("camera_to_world ARRAY", "camera_to_world: ARRAY")
    fields = ", ".join(c.replace(" ", ":", 1) if ":" not in c.split("<")[0] else c for c in row.split(", "))
    doc = read_document(spark, path, f"data_kind STRING, source_asset_name STRING, source_asset_sha256 STRING, camera_count INT, cameras ARRAY<STRUCT<{fields}>>")
    checked = doc.withColumn("cameras", F.when(F.size("cameras") == F.col("camera_count"), F.col("cameras")).otherwise(F.raise_error(F.lit("camera_count differs from the number of cameras"))))
    return checked.select("source_asset_sha256", F.explode("cameras").alias("c")).select("source_asset_sha256", "c.*")


def read_inventory(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One table of an exported scene inventory, a JSON object a line under its closed schema: objects, cameras, lights,
    images, collections, materials or meshes. A row that does not fit fails the read."""
    return spark.read.schema(schemas.INVENTORY[kind]).option("mode", "FAILFAST").json(path)


def unknown_fields(raw: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that the closed schema does not have; null for text that is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, allowed))))


def eligible_cameras(cameras: DataFrame, prefix: str = "CAM_", count: int | None = None) -> DataFrame:
    """Cameras of this prefix by id; with count, another number of them is an error."""
    found = cameras.where(F.col("camera_id").startswith(prefix)).orderBy("camera_id")
    if count is not None and found.count() != count:
        raise ValueError(f"expected {count} cameras with {prefix}")
    return found


def asset_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size, modified of files, read by Spark's binary source."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def observations_between(observations: DataFrame, camera_id: str, start: float, end: float) -> DataFrame:
    """Observations of one camera that overlap a time range; both filters reach the scan."""
    return observations.where((F.col("camera_id") == camera_id) & (F.col("start_time") <= end) & (F.col("end_time") >= start))


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id)
