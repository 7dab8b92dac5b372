"""What a query's work grows with: how it is spread over tasks, and what is worked out once."""

import time

import pandas as pd
from pyspark.sql import functions as F

from rows import spark_rows
from sightline.operators import geometry, search
from sightline.plans import queries, scene
from sightline.streaming import gaps

SF = "/root/testdata/sf0.001"


def test_surfaces_are_spread_and_cut_once(spark):
    assert scene.surfaces(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    pairs = queries._stairs(spark, SF)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(array(struct(on_x") == 1


def test_triangles_inside_a_box_have_their_area(spark):
    corner = "struct<x:double,y:double,z:double>"
    at = lambda x, y: (float(x), float(y), 0.0)
    shapes = [(at(1, 1), at(3, 1), at(1, 3)), (at(0, 0), at(10, 0), at(0, 10)), (at(-2, 1), at(4, 1), at(4, 5)), (at(0.1, 0.7), at(9.3, 0.3), at(5.9, 9.1)), (at(10, 10), at(12, 10), at(10, 12))]
    triangles = spark.createDataFrame([("t", i, *s) for i, s in enumerate(shapes)], f"name string, polygon_index int, a {corner}, b {corner}, c {corner}")
    box = spark.createDataFrame([("b", 0.0, 10.0, 0.0, 10.0, -1.0, 1.0)], "area string, xlo double, xhi double, ylo double, yhi double, zlo double, zhi double")
    measured = geometry.triangle_measures(triangles)
    got = geometry.overlap_areas(box, measured, F.lit(True), 1e-9).select("polygon_index", "clipped_area")
    cut = geometry.polygon_area(geometry.clip_to_box(geometry.flat("a", "b", "c"), *map(F.lit, (0.0, 10.0, 0.0, 10.0))))
    want = measured.select("polygon_index", cut.alias("clipped_area")).where("clipped_area > 1e-9")
    assert spark_rows(got) == spark_rows(want) and got.count() == 4


def test_requests_that_reach_alike_are_one_question(spark):
    start = {"start_camera": F.lit("c"), "start_node": F.lit("n")}
    ranked = spark.createDataFrame([(0.0,), (4.0,), (10.0,)], "distance double").withColumns(start)
    made = spark.createDataFrame([(10.0,), (14.0,)], "far double").withColumns(start)
    reaches = [("a", 100.0), ("b", 14.0), ("c", 14.0 - 1e-13), ("d", 13.9), ("e", 10.0), ("f", 3.0), ("g", float("inf")), ("h", -1.0)]
    bounds = {b: F.lit(1) for b in search.BOUNDS} | {"end_camera": F.lit("c"), "end_node": F.lit("n"), "gap_s": F.col("reach_m"), "max_speed_m_s": F.lit(1.0)}
    found = search.asked(spark.createDataFrame(reaches, "request_id string, reach_m double").withColumns(start | bounds), ranked, made).collect()
    assert {r["request_id"]: r["level"] for r in found} == {"a": 4, "b": 4, "c": 4, "d": 3, "e": 3, "f": 1, "g": 4, "h": 0}
    assert len({r["question"] for r in found}) == 4


def test_a_target_costs_the_stream_little(spark):
    """The step of a target is timed, with frames that come late and one that is still to wait."""
    kept = {}

    class Stream:
        groupBy = withColumn = withWatermark = lambda self, *a: self

        def applyInPandasWithState(self, step, *a):  # noqa: N802
            kept["step"] = step

    class State:
        exists, get = False, None
        getCurrentWatermarkMs = lambda self: 5000  # noqa: E731, N815
        setTimeoutTimestamp = lambda self, ms: kept.update(timer=ms)  # noqa: E731, N815
        update = lambda self, value: kept.update(state=value)

    gaps.gap_pairs(Stream())
    frames = pd.DataFrame({"t": [3.0, 1.0, 1.0, 9.0], "frame_id": [4, 2, 1, 7], "camera": [5, 3, 6, 8], "ms": [3000, 1000, 1000, 9000]})
    began = time.perf_counter()
    for _ in range(500):
        out = list(kept["step"]((11,), iter([frames]), State()))
    assert time.perf_counter() - began < 1.5  # three milliseconds a target; sorting and cutting tables took seven
    assert [tuple(r) for r in pd.concat(out).itertuples(index=False)] == [(11, 2, 4, 3, 5, 2.0)]
    assert kept["state"] == ((3.0, 4, 5, 3000), [(9.0, 7, 8, 9000)]) and kept["timer"] == 9000
