"""Several tables and documents published together: readers see all of a version or none of it.

Parts are written under a name that nobody knows yet, read back, counted and hashed. The manifest that names them is
written beside its target and renamed onto it, the one step that publishes, by whatever file system the folder is on. A
job that ends before that leaves parts that no manifest names; sweep removes them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import GROUND_TRUTH_COLUMNS

MANIFEST = "manifest.json"
FORMATS = {"parquet": {}, "csv": {"header": True}, "json": {"ignoreNullFields": False}}


class Part(NamedTuple):
    """A table and the format it is written in, with the writer's options; or a small text."""

    content: DataFrame | str
    form: str = "parquet"
    options: dict = {}


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one small document
    return rows[0][0]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _at(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()


def fingerprint(df: DataFrame) -> dict[str, int | str]:
    """rows and hash of a table, whatever order its rows are in: two sums and an exclusive or of their hashes."""
    key = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    r = df.select(key.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.sum((F.xxhash64("h", F.lit(1))).cast("decimal(38,0)")).alias("t")).first()
    return {"rows": r["n"], "hash": hashlib.sha256(f"{r['n']},{r['x']},{r['s']},{r['t']}".encode()).hexdigest()}


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The published version's manifest; None where nothing is published."""
    p, fs = _at(spark, f"{folder}/{MANIFEST}")
    return json.loads(_read_text(spark, f"{folder}/{MANIFEST}")) if fs.exists(p) else None


def publish(spark: SparkSession, folder: str, parts: dict[str, Part], overwrite: bool = False) -> dict:
    """Write parts and publish them as folder's version; returns the manifest. Without overwrite a folder that has one is
    an error, before anything is written and again at the rename. Two writers at once publish one whole version each,
    the last one staying."""
    if not overwrite and manifest(spark, folder) is not None:
        raise FileExistsError(folder)
    version = uuid.uuid4().hex
    found = {}
    for name, part in parts.items():
        path = f"parts-{version}/{name}"
        if isinstance(part.content, str):
            _write_text(spark, f"{folder}/{path}", part.content)
            found[name] = {"path": path, "format": "text", "sha256": hashlib.sha256(part.content.encode()).hexdigest()}
        else:
            part.content.write.options(**(FORMATS[part.form] | part.options)).format(part.form).save(f"{folder}/{path}")
            found[name] = {"path": path, "format": part.form, "schema": part.content.schema.jsonValue()} | fingerprint(_read(spark, folder, {"path": path, "format": part.form, "schema": part.content.schema.jsonValue()}))
    whole = {"version": version, "parts": found}
    _write_text(spark, f"{folder}/parts-{version}/{MANIFEST}", json.dumps(whole, sort_keys=True, indent=2) + "\n")
    _rename(spark, f"{folder}/parts-{version}/{MANIFEST}", f"{folder}/{MANIFEST}", overwrite)
    return whole


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """Rename in one step; without overwrite a target that exists is an error."""
    gateway, fs = spark.sparkContext._gateway, spark._jvm.org.apache.hadoop.fs
    (a, _), (b, _) = _at(spark, source), _at(spark, target)
    kind = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = kind.getField("OVERWRITE" if overwrite else "NONE").get(None)
    try:
        fs.FileContext.getFileContext(b.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, how)
    except Exception as error:
        if "AlreadyExists" in str(error):
            raise FileExistsError(target) from error
        raise


def _read(spark: SparkSession, folder: str, part: dict) -> DataFrame:
    from pyspark.sql.types import StructType

    return spark.read.options(**FORMATS[part["format"]]).schema(StructType.fromJson(part["schema"])).format(part["format"]).load(f"{folder}/{part['path']}")


def published(spark: SparkSession, folder: str, name: str, verify: bool = False) -> DataFrame | str:
    """A part of the published version: a table as a DataFrame, a text as such. With verify its hash is made again and one
    that differs is an error."""
    whole = manifest(spark, folder)
    if whole is None or name not in whole["parts"]:
        raise FileNotFoundError(f"{folder}: {name} is not published")
    part = whole["parts"][name]
    if part["format"] == "text":
        text = _read_text(spark, f"{folder}/{part['path']}")
        if verify and hashlib.sha256(text.encode()).hexdigest() != part["sha256"]:
            raise ValueError(f"{name} is not what was published")
        return text
    df = _read(spark, folder, part)
    if verify and fingerprint(df) != {k: part[k] for k in ("rows", "hash")}:
        raise ValueError(f"{name} is not what was published")
    return df


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Remove parts that the published version does not name; returns their folders. Not while a writer is at work."""
    whole = manifest(spark, folder)
    p, fs = _at(spark, folder)
    gone = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("parts-") and (whole is None or name != f"parts-{whole['version']}"):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def publish_ground_truth(samples: DataFrame, folder: str, overwrite: bool = False) -> dict:
    """Samples (GROUND_TRUTH_COLUMNS) as documents, one file and JSON object a trajectory with its samples in the order of
    time, and as CSV with a header, published together. A trajectory's samples are one row there, as many as it may
    have (trajectory.sample_trajectories bounds them)."""
    head = GROUND_TRUTH_COLUMNS[: GROUND_TRUTH_COLUMNS.index("timestamp")]
    v3 = lambda x, y, z: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    sample = F.struct("timestamp", v3("X", "Y", "Z").alias("position"), v3("VX", "VY", "VZ").alias("velocity"), "floor_id", "zone_id", "semantic_region", "provenance")
    documents = samples.groupBy(*head).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    documents = documents.select(*sorted(documents.columns))
    return publish(samples.sparkSession, folder, {"documents": Part(documents, "json", {"maxRecordsPerFile": 1}), "table": Part(samples.select(*GROUND_TRUTH_COLUMNS), "csv")}, overwrite)


def publish_scene_audit(report: dict, summaries: dict[str, str], findings: DataFrame, folder: str, overwrite: bool = False) -> dict:
    """A scene's audit: its report as JSON, the findings as a table, and a summary a language (code -> Markdown)."""
    text = json.dumps(report, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False) + "\n"
    return publish(findings.sparkSession, folder, {"report.json": Part(text), "findings": Part(findings)} | {f"summary.{language}.md": Part(t) for language, t in summaries.items()}, overwrite)


def publish_observations(frames: DataFrame, metadata: dict, folder: str, overwrite: bool = False) -> dict:
    """Observation frames, in order within a camera, and what they were made from."""
    ordered = frames.repartitionByRange("camera_id", "frame_id").sortWithinPartitions("camera_id", "frame_id")
    return publish(frames.sparkSession, folder, {"frames": Part(ordered), "bundle.json": Part(json.dumps(metadata, sort_keys=True, indent=2, allow_nan=False) + "\n")}, overwrite)
