"""Sinks: guarded paths, partitioned tables, and small documents that replace their target in one step."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import GROUND_TRUTH_COLUMNS


def guard_output(path: str, suffix: str, inputs: tuple[str, ...] = (), overwrite: bool = False) -> Path:
    """The resolved path, if it has the suffix, is no input and may be written."""
    target = Path(path)
    real = target.resolve()
    if target.suffix != suffix or real.suffix != suffix:
        raise ValueError(f"output must end in {suffix}: {path}")
    if real in {Path(i).resolve() for i in inputs}:
        raise ValueError(f"output is an input: {path}")
    if real.exists() and not overwrite:
        raise FileExistsError(path)
    return real


def publish_text(text: str, path: str, suffix: str = ".json", inputs: tuple[str, ...] = (), overwrite: bool = False) -> Path:
    """Write a small document beside its target, sync it, and rename or link it into place."""
    target = guard_output(path, suffix, inputs, overwrite)
    handle, temporary = tempfile.mkstemp(dir=target.parent, suffix=suffix)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        if overwrite:
            os.replace(temporary, target)
        else:
            os.link(temporary, target)
    finally:
        Path(temporary).unlink(missing_ok=True)
    return target


def publish_json(payload: dict, path: str, inputs: tuple[str, ...] = (), overwrite: bool = False) -> Path:
    """A small JSON document with sorted keys; NaN and infinities are refused."""
    return publish_text(json.dumps(payload, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n", path, ".json", inputs, overwrite)


def write_ground_truth_csv(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    """Samples as CSV parts with a header, columns in the fixed order."""
    samples.select(*GROUND_TRUTH_COLUMNS).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_frames(frames: DataFrame, path: str, overwrite: bool = False) -> None:
    """Observation frames as Parquet, a folder a camera, in frame order within files."""
    frames.repartition("camera_id").sortWithinPartitions("camera_id", "frame_id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("camera_id").parquet(path)


def write_json_rows(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object a row, keys sorted, nulls written."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def camera_catalog(cameras: DataFrame, asset_name: str, asset_sha256: str) -> DataFrame:
    """One catalogue row: the cameras by id, their count and the asset they were taken from."""
    body = F.struct(*cameras.columns)
    return cameras.agg(F.sort_array(F.collect_list(body)).alias("cameras"), F.count("*").cast("int").alias("camera_count")).select(F.lit("CONFIGURED").alias("data_kind"), F.lit(asset_name).alias("source_asset_name"), F.lit(asset_sha256).alias("source_asset_sha256"), "camera_count", "cameras")


def publish_geometry_audit(report: dict, before: dict, after: dict, path: str, overwrite: bool = True) -> Path:
    """A geometry report with where it came from and what it does not prove. before and after are rows of
    readers.asset_fingerprint from around the audit; an asset that changed between them is an error."""
    changed = [k for k in ("sha256", "size", "modified") if before[k] != after[k]]
    if changed:
        raise ValueError(f"the asset changed during the audit: {', '.join(changed)}")
    # fixed values: the report's statements
    kept = {f"source_{k}_unchanged": True for k in ("hash", "size", "mtime")} | {f"{k}_operation_performed": False for k in ("save", "render")}
    unproven = ("navigation_geometry_approved", "raw_coverage_is_walkability", "annotation_boxes_are_collision_surfaces", "stair_absence_globally_proven")
    source = {"filename": os.path.basename(before["path"]), "sha256_before": before["sha256"], "sha256_after": after["sha256"], "size_bytes": before["size"]}
    whole = report | {"schema_version": "1.0.0", "audit_kind": "READ_ONLY_GEOMETRY_DIAGNOSTIC", "source": source, "read_only_contract": kept, "interpretation_boundary": dict.fromkeys(unproven, False)}
    return publish_json(whole, path, (before["path"].removeprefix("file:"),), overwrite)


def publish_camera_catalog(cameras: DataFrame, asset_name: str, asset_sha256: str, path: str, expected: int | None = None, overwrite: bool = False) -> Path:
    """The catalogue of a scene's cameras, a configuration document: ids must differ and their number be as expected."""
    row = camera_catalog(cameras, asset_name, asset_sha256).first().asDict(recursive=True)
    ids = [c["camera_id"] for c in row["cameras"]]
    if len(set(ids)) < len(ids) or expected not in (None, len(ids)):
        raise ValueError("camera ids repeat, or their number is not as expected")
    return publish_json(row, path, overwrite=overwrite)


def write_observation_bundle(frames: DataFrame, path: str, metadata: dict[str, str], overwrite: bool = False) -> None:
    """Observation frames as write_frames does, each row with what the bundle was made from (source hash, scene, seed)."""
    write_frames(frames.withColumns({k: F.lit(v) for k, v in metadata.items()}), path, overwrite)


def findings_markdown(findings: DataFrame) -> str:
    """A short report of findings, most severe first; findings are a handful of rows."""
    rows = findings.orderBy("severity", "code").collect()
    return "\n".join(["# Scene findings", "", "| Code | Severity | Count |", "| --- | --- | --- |", *(f"| {r['code']} | {r['severity']} | {r['n']} |" for r in rows), ""])
