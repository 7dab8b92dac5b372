"""Versions that are published whole or not at all, and the sources and sinks that the other tests leave out."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from sightline.operators import trajectory, visibility
from sightline.sources import publishing, readers, schemas, sinks
from sightline.sources.publishing import Part


def samples(spark, n, rate=2):
    rows = [("T%d" % k, "p", "s", "SYNTHETIC", "ANALYTIC", "asset", "0" * 64, 1, rate, 0.5 * i, float(i), float(k), 0.0, 1.0, 0.0, 0.0, "F1", None, "a", "GROUND_TRUTH") for k in range(2) for i in range(n)]
    kinds = {"random_seed": "int", "sample_rate_hz": "int"} | dict.fromkeys(("timestamp", "X", "Y", "Z", "VX", "VY", "VZ"), "double")
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in schemas.GROUND_TRUTH_COLUMNS)).repartition(3)


def test_ground_truth_is_published_whole(spark, tmp_path):
    folder = str(tmp_path / "truth")
    first = publishing.publish_ground_truth(samples(spark, 3), folder)
    assert first["parts"]["table"]["rows"] == 6 and first["parts"]["documents"]["rows"] == 2
    table = publishing.published(spark, folder, "table", verify=True)
    assert table.columns == list(schemas.GROUND_TRUTH_COLUMNS) and table.count() == 6
    read = readers.read_ground_truth(spark, f"{folder}/{first['parts']['documents']['path']}")
    assert sorted((r["trajectory_id"], r["sample_no"], r["timestamp"], r["position"]["x"], r["provenance"]) for r in read.collect()) == [(f"T{k}", i, 0.5 * i, float(i), "GROUND_TRUTH") for k in range(2) for i in range(3)]
    document = json.loads(open(glob.glob(f"{folder}/{first['parts']['documents']['path']}/part-*")[0]).readline())
    assert list(document) == sorted(document) and document["samples"][0]["zone_id"] is None
    with pytest.raises(FileExistsError):
        publishing.publish_ground_truth(samples(spark, 4), folder)
    publishing.publish_ground_truth(samples(spark, 4), folder, overwrite=True)
    assert publishing.published(spark, folder, "table").count() == 8


@pytest.mark.parametrize("broken", ["first", "second", "manifest"])
def test_an_interrupted_writer_publishes_nothing(spark, tmp_path, monkeypatch, broken):
    folder = str(tmp_path / "out")
    good = spark.range(5)
    publishing.publish(spark, folder, {"a": Part(good), "b": Part(good), "note": Part("one")})
    bad = good.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    parts = {"a": Part(bad if broken == "first" else spark.range(9)), "b": Part(bad if broken == "second" else spark.range(9)), "note": Part("two")}
    if broken == "manifest":
        monkeypatch.setattr(publishing, "_rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        publishing.publish(spark, folder, parts, overwrite=True)
    monkeypatch.undo()
    assert [publishing.published(spark, folder, k, verify=True).count() for k in "ab"] == [5, 5] and publishing.published(spark, folder, "note", verify=True) == "one"
    assert len(publishing.sweep(spark, folder)) == 1 and publishing.sweep(spark, folder) == []
    publishing.publish(spark, folder, parts | {"a": Part(spark.range(9)), "b": Part(spark.range(9))}, overwrite=True)
    assert publishing.published(spark, folder, "b").count() == 9 and publishing.published(spark, folder, "note") == "two"


def test_a_race_for_a_new_folder_has_one_winner(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "new")
    rename = publishing._rename

    def other_first(*args):
        monkeypatch.setattr(publishing, "_rename", rename)
        publishing.publish(spark, folder, {"a": Part("other")})
        rename(*args)

    monkeypatch.setattr(publishing, "_rename", other_first)
    with pytest.raises(FileExistsError):
        publishing.publish(spark, folder, {"a": Part("mine")})
    assert publishing.published(spark, folder, "a") == "other"


def test_changed_parts_are_noticed(spark, tmp_path):
    folder = str(tmp_path / "out")
    made = publishing.publish(spark, folder, {"t": Part(spark.range(4).repartition(2)), "n": Part("text")})
    assert made["parts"]["t"]["hash"] == publishing.fingerprint(spark.range(4))["hash"] != publishing.fingerprint(spark.range(5).where("id <> 2"))["hash"]
    spark.range(1).write.mode("append").parquet(f"{folder}/{made['parts']['t']['path']}")
    with pytest.raises(ValueError):
        publishing.published(spark, folder, "t", verify=True)
    with pytest.raises(FileNotFoundError):
        publishing.published(spark, folder, "other")
    with pytest.raises(FileNotFoundError):
        publishing.published(spark, str(tmp_path / "nothing"), "t")
    assert publishing.fingerprint(spark.range(0))["rows"] == 0


def test_audits_and_bundles(spark, tmp_path):
    findings = spark.createDataFrame([("B", "high", 2), ("A", "high", 1), ("C", "low", 3)], "code string, severity string, n int")
    text = sinks.findings_markdown(findings)
    assert text.splitlines()[4:] == ["| A | high | 1 |", "| B | high | 2 |", "| C | low | 3 |"]
    publishing.publish_scene_audit({"objects": 3}, {"en": text, "zh": "# x\n"}, findings, str(tmp_path / "audit"))
    assert json.loads(publishing.published(spark, str(tmp_path / "audit"), "report.json", verify=True)) == {"objects": 3}
    assert publishing.published(spark, str(tmp_path / "audit"), "summary.zh.md") == "# x\n" and publishing.published(spark, str(tmp_path / "audit"), "findings").count() == 3
    frames = spark.createDataFrame([(i, f"C{i % 3}") for i in range(30)], "frame_id int, camera_id string")
    publishing.publish_observations(frames, {"scene_id": "s"}, str(tmp_path / "frames"))
    assert publishing.published(spark, str(tmp_path / "frames"), "frames", verify=True).count() == 30
    sinks.write_ground_truth_csv(samples(spark, 2), str(tmp_path / "csv"))
    assert open(glob.glob(str(tmp_path / "csv" / "part-*"))[0]).readline().strip() == ",".join(schemas.GROUND_TRUTH_COLUMNS)
    sinks.write_json_rows(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "rows"))
    lines = [line for p in glob.glob(str(tmp_path / "rows" / "part-*")) if os.path.getsize(p) for line in open(p)]
    assert lines == ['{"a":null,"b":1}\n']


def test_camera_catalogue_comes_back(spark, tmp_path):
    pose = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    cameras = spark.createDataFrame([(f"CAM_{k}", pose, 50.0, 50.0, 50.0, 50.0, 100, 100, 0.1, 50.0, "OPENGL", "TOP_LEFT", 1.0, "F1", None) for k in (2, 1)], schemas.CAMERAS)
    path = str(sinks.publish_camera_catalog(cameras, "asset", "0" * 64, str(tmp_path / "cameras.json"), expected=2))
    back = readers.read_cameras(spark, path).orderBy("camera_id").collect()
    assert [r["camera_id"] for r in back] == ["CAM_1", "CAM_2"] and back[0]["camera_to_world"] == pose and back[0]["source_asset_sha256"] == "0" * 64
    whole = json.loads(open(path).read())
    (tmp_path / "short.json").write_text(json.dumps(whole | {"camera_count": 3}))
    with pytest.raises(Exception, match="camera_count"):
        readers.read_cameras(spark, str(tmp_path / "short.json")).collect()


def test_evaluated_positions(spark):
    s = spark.createDataFrame([("T", 0, 0.0, 0.0, 0.0), ("T", 1, 1.0, 0.0, 0.0)], "trajectory_id string, sample_no long, X double, Y double, Z double")
    near = spark.createDataFrame([("T", 1, 1.0005, 0.0, 0.0), ("T", 0, 0.0, 0.0, 0.0005), ("U", 0, 9.0, 9.0, 9.0)], "trajectory_id string, sample_no long, x double, y double, z double")
    got = trajectory.evaluated(s, near, "f" * 64).orderBy("sample_no").collect()
    assert [(r["X"], r["Z"], r["sample_source"], r["source_asset_sha256"]) for r in got] == [(0.0, 0.0005, "BLENDER_EVALUATED", "f" * 64), (1.0005, 0.0, "BLENDER_EVALUATED", "f" * 64)]
    for wrong in (near.where("sample_no = 1"), near.withColumn("x", F.col("x") + 0.01)):
        with pytest.raises(Exception, match="missing or too far"):
            trajectory.evaluated(s, wrong, "f" * 64).collect()


def test_bounds_of_a_batch(spark):
    points = spark.range(10).withColumnRenamed("id", "sample")
    cameras = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "camera_id string, fx double")
    assert visibility.samples_by_camera(points, cameras, max_frames=20).count() == 20
    with pytest.raises(ValueError, match="too many"):
        visibility.samples_by_camera(points, cameras, max_frames=19)
    with pytest.raises(ValueError, match="repeat"):
        visibility.samples_by_camera(points, cameras.unionAll(cameras))
