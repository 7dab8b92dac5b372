"""The scene that the driver's star tables stand for, by fixed arithmetic over their keys.

Nations are nodes of a walkable graph and cameras at once: floor n_regionkey, 4 m a floor, and 10 m between columns.
Events are frames and observations, customers' orders are keyframes, parts are boxes and surfaces, suppliers are further
cameras, portals and proposed edges, some of them flawed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.schemas import SEARCH_DEFAULTS

SPEED = 1.5
REACH = 30.0
TASK_KEYFRAMES = 50_000
TASK_SURFACES = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> str:
    return f"concat('{prefix}', lpad(cast({key} as string), 2, '0'))"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.expr(_id("N", "n_nationkey")).alias("node_id"),
        F.expr("named_struct('x', 10.0D * (n_nationkey div 5), 'y', 0.0D, 'z', 4.0D * n_regionkey)").alias("position"),
        F.expr("concat('F', cast(n_regionkey as string))").alias("floor_id"),
        F.expr("concat('Z', cast(n_nationkey div 5 as string))").alias("zone_id"),
        F.col("n_nationkey").alias("key"),
    )


def camera_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select(F.expr(_id("C", "key")).alias("camera_id"), "floor_id", "zone_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WALK between neighbouring columns of a floor, stairs between neighbouring floors of a column, both ways."""
    n = nodes(spark, sf_dir).select("key", "node_id", "position", F.expr("cast(substring(floor_id, 2) as int)").alias("floor"))
    a = n.toDF("a", "from_node_id", "pa", "fa").withColumn("b", F.explode(F.expr("array(a - 5, a + 5, a - 1, a + 1)")))
    e = a.join(F.broadcast(n.toDF("b", "to_node_id", "pb", "fb")), "b").where("abs(a - b) = 5 or abs(fa - fb) = 1")  # 25 nations
    kind = F.expr("case when fa = fb then 'WALK' when fb > fa then 'STAIR_UP' else 'STAIR_DOWN' end")
    return e.select(
        F.expr("concat('E', lpad(cast(a as string), 2, '0'), '_', lpad(cast(b as string), 2, '0'))").alias("edge_id"),
        "from_node_id",
        "to_node_id",
        F.array("pa", "pb").alias("polyline"),
        kind.alias("transition_type"),
        F.expr("case when fa <> fb then concat('S', cast(a div 5 as string)) end").alias("stair_id"),
        F.lit(True).alias("walkable"),
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select(
        F.expr("replace(edge_id, 'E', 'T')").alias("transition_id"),
        F.expr("replace(from_node_id, 'N', 'C')").alias("from_camera_id"),
        F.expr("replace(to_node_id, 'N', 'C')").alias("to_camera_id"),
        F.expr("case when transition_type = 'WALK' then 'ADJACENT' else transition_type end").alias("transition_type"),
        F.col("from_node_id").alias("navigation_from_node_id"),
        F.col("to_node_id").alias("navigation_to_node_id"),
        F.array("edge_id").alias("navigation_edge_ids"),
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, event_id, camera (a nation's key), t in synthetic seconds."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.select(F.col("user_id").alias("target_id"), "event_id", F.expr("cast(event_id % 25 as int)").alias("camera"), F.expr("unix_micros(cast(ts as timestamp)) / 1e9D").alias("t"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring observations of a target with time between them."""
    order = Window.partitionBy("target_id").orderBy("t", "event_id")
    o = observed(spark, sf_dir)
    for c in ("event_id", "camera", "t"):
        o = o.withColumn(f"p_{c}", F.lag(c).over(order))
    return o.where("t > p_t").select("target_id", F.col("p_event_id").alias("start_id"), F.col("event_id").alias("end_id"), F.col("p_camera").alias("start_camera"), F.col("camera").alias("end_camera"), (F.col("t") - F.col("p_t")).alias("gap_s"), F.col("p_t").alias("start_t"), F.col("t").alias("end_t"))


def search_requests(spark: SparkSession, sf_dir: str, **policy) -> DataFrame:
    """A request for each gap, with the default bounds but for those in policy, and its evidence at both ends."""
    g = gaps(spark, sf_dir)
    bounds = {k: v for k, v in SEARCH_DEFAULTS.items() if k != "max_search_time_s"} | {"max_paths": 3, "max_speed_m_s": SPEED} | policy
    id_ = lambda prefix, c: F.expr(_id(prefix, c))

    def evidence(end: str, time: str):
        floor, observation = F.expr(f"concat('F', {end}_camera % 5)"), F.expr(f"concat('O', {end}_id)")
        at = F.expr(f"named_struct('x', 10.0D * ({end}_camera div 5), 'y', 0.0D, 'z', 4.0D * ({end}_camera % 5))")
        camera = id_("C", f"{end}_camera")
        point = F.struct(F.expr(f"concat('P', {end}_id)").alias("point_id"), observation.alias("observation_id"), camera.alias("camera_id"), F.lit(None).cast("string").alias("plane_id"), floor.alias("floor_id"), F.col(time).alias("timestamp"), at.alias("world_position"))
        return F.struct(F.col("target_id").cast("string").alias("target_id"), camera.alias("camera_id"), floor.alias("floor_id"), observation.alias("observation_id"), point.alias("point"))

    return g.select(
        F.concat_ws("-", "start_id", "end_id").alias("request_id"),
        *(id_(p, f"{e}_camera").alias(f"{e}_{n}") for e in ("start", "end") for p, n in (("C", "camera"), ("N", "node"))),
        "gap_s",
        *((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in bounds.items()),
        evidence("start", "start_t").alias("start"),
        evidence("end", "end_t").alias("end"),
    )


def raw_observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, frames, points): an observation of one frame and two points for each event. Some lie about their
    target, camera, floor, order or place."""
    node = "cast(event_id % 25 as int)"
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", f"{node} as node", "unix_micros(cast(ts as timestamp)) / 1e9D as t", "concat('O', event_id) as observation_id", f"concat('F', {node} % 5) as floor")
    e = e.withColumns({"camera_id": F.expr(f"if(event_id % 37 = 3, 'C99', {_id('C', 'node')})"), "target_id": F.expr("if(event_id % 41 = 7, 'nobody', cast(user_id as string))")})
    heads = e.selectExpr("observation_id", "target_id", "camera_id", "t - 1 as start_time", "if(event_id % 83 = 4, t - 2, t) as end_time", "case event_id % 29 when 5 then 'F9' when 6 then null when 7 then '' else floor end as floor_id", "if(event_type = 'error', 'OBSERVED', 'PROJECTED') as provenance")
    frames = e.selectExpr("observation_id", "t as timestamp", "if(event_id % 43 = 9, 'GAP', 'OBSERVED') as status", "camera_id", "target_id")
    at = "named_struct('x', 10.0D * (node div 5) + if(event_id % 53 = 2, 0.5D, 0.0D), 'y', 0.0D, 'z', 4.0D * (node % 5))"
    points = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "observation_id", "concat('P', event_id, '-', if(event_id % 79 = 8, 0, k)) as point_id", "if(event_id % 47 = 11, t, t - 1 + k) as timestamp", "camera_id", "if(event_id % 89 = 3, 'another', observation_id) as of_observation",
        "case event_id % 29 when 5 then null when 6 then null when 7 then null when 8 then 'F8' else floor end as floor_id", f"{at} as world_position",
    )
    return heads, frames, points


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request between each two neighbouring events of a user, some of them turned round, doubled or out of range."""
    e = table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before")).where("before is not null")
    bounds = {k: v for k, v in SEARCH_DEFAULTS.items() if k not in ("max_search_time_s", "max_paths", "max_path_length_m")} | {"max_path_length_m": 14.0}
    return e.select(
        F.expr("concat(before, '-', event_id)").alias("request_id"),
        F.expr("concat('O', if(event_id % 67 = 5, event_id, before))").alias("start_observation_id"),
        F.expr("concat('O', if(event_id % 67 = 5 or event_id % 61 = 0, before, if(event_id % 73 = 1, -1, event_id)))").alias("end_observation_id"),
        F.expr("if(event_id % 59 = 1, 0, 3)").alias("max_paths"),
        F.expr("if(event_id % 71 = 3, double('infinity'), 1.5D)").alias("max_speed_m_s"),
        *(F.lit(v).alias(k) for k, v in bounds.items()),
    )


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory of each customer with two orders or more, a keyframe an order, 0.7 s apart; in tasks of about
    TASK_KEYFRAMES, since samples and frames are made where their keyframes lie."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    o = o.repartition(max(spark.sparkContext.defaultParallelism, o.count() // TASK_KEYFRAMES), "o_custkey")
    by = Window.partitionBy("o_custkey")
    o = o.withColumn("no", F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")) - 1).withColumn("n", F.count("*").over(by)).where("n > 1")
    return o.select(
        F.col("o_custkey").alias("trajectory_id"),
        F.lit(2).alias("sample_rate_hz"),
        F.expr("cast(no * 0.7BD as decimal(38,9))").alias("timestamp"),
        F.expr("cast(o_orderkey % 101 as double)").alias("x"),
        F.expr("cast(o_orderkey % 97 as double)").alias("y"),
        F.expr("cast(o_orderkey % 7 as double)").alias("z"),
        F.expr("concat('F', cast(o_orderkey % 5 as string))").alias("floor_id"),
        F.expr("concat('Z', cast(o_orderkey % 3 as string))").alias("zone_id"),
        F.col("o_orderpriority").alias("semantic_region"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each region, looking down, as flattened columns."""
    one = {f"r{i}{j}": F.lit(1.0 if i == j else 0.0) for i in range(3) for j in range(3)}
    rest = {"tx": F.expr("20.0D * r_regionkey"), "ty": F.lit(50.0), "tz": F.lit(90.0), "w0": F.lit(0.0), "w1": F.lit(0.0), "w2": F.lit(0.0), "w3": F.lit(1.0)}
    lens = {"fx": F.lit(64.0), "fy": F.lit(64.0), "cx": F.lit(50.0), "cy": F.lit(50.0), "width": F.lit(100), "height": F.lit(100), "clip_start": F.lit(85.0), "clip_end": F.lit(200.0)}
    return table(spark, sf_dir, "region").select(F.expr("concat('R', cast(r_regionkey as string))").alias("camera_id"), *(c.alias(k) for k, c in (one | rest | lens).items()))


def planes(spark: SparkSession) -> DataFrame:
    rows = [("P0", (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)), ("P1", (0.0, 0.0, 10.0), (0.6, 0.0, 0.8)), ("P2", (0.0, 0.0, 100.0), (0.0, 0.0, 1.0)), ("P3", (10.0, 0.0, 0.0), (1.0, 0.0, 0.0))]
    return spark.createDataFrame(rows, "plane_id string, point struct<x:double,y:double,z:double>, normal struct<x:double,y:double,z:double>")


def pixel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of the region cameras; some name no camera, some pixels are outside the image."""
    return frames_of_events(table(spark, sf_dir, "events"))


def frames_of_events(events: DataFrame, *more: Column) -> DataFrame:
    return events.select(
        *more,
        F.col("event_id").alias("frame_id"),
        F.expr("unix_micros(cast(ts as timestamp)) / 1e9D").alias("timestamp"),
        F.expr("cast(user_id as string)").alias("target_id"),
        F.expr("concat('R', cast(event_id % 6 as string))").alias("camera_id"),
        F.expr("case when event_type = 'error' then 'GAP' else 'OBSERVED' end").alias("status"),
        F.expr("(event_id * 37 % 1010) / 10.0D").alias("u"),
        F.expr("(event_id * 91 % 1010) / 10.0D").alias("v"),
        F.expr("concat('P', cast(event_id % 4 as string))").alias("plane_id"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each part on a ground of 1000 by 1000."""
    p = table(spark, sf_dir, "part").select(F.expr("concat('M', lpad(cast(p_partkey as string), 9, '0'))").alias("name"), F.expr("cast(p_partkey * 37 % 1000 as double)").alias("x"), F.expr("cast(p_partkey * 71 % 1000 as double)").alias("y"), F.expr("p_size / 10.0D").alias("s"))
    corner = lambda sign: F.expr(f"named_struct('x', x {sign} s, 'y', y {sign} s, 'z', 5.0D {sign} s)")
    return p.select("name", corner("-").alias("lo"), corner("+").alias("hi"))


def box_triangles(boxes: DataFrame) -> DataFrame:
    """The twelve triangles of each box."""
    at = lambda bits: F.struct(*((F.col("hi") if bit == "1" else F.col("lo"))[a].alias(a) for bit, a in zip(bits, "xyz")))
    quads = [("000", "010", "011", "001"), ("100", "110", "111", "101"), ("000", "100", "101", "001"), ("010", "110", "111", "011"), ("000", "100", "110", "010"), ("001", "101", "111", "011")]
    faces = [F.struct(*(at(p).alias(n) for p, n in zip((q[0], q[i], q[i + 1]), "abc"))) for q in quads for i in (1, 2)]
    return boxes.select("name", F.posexplode(F.array(*faces)).alias("polygon_index", "t")).select("name", "polygon_index", "t.*")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ray for each customer over that ground; every fiftieth has no length."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.expr("cast(c_custkey as string)").alias("ray_id"),
        F.expr("named_struct('x', cast(c_custkey * 13 % 1000 as double) + 0.25D, 'y', cast(c_custkey * 29 % 1000 as double) + 0.25D, 'z', 5.0D)").alias("origin"),
        F.expr("case when c_custkey % 50 = 0 then named_struct('x', cast(c_custkey * 13 % 1000 as double) + 0.25D, 'y', cast(c_custkey * 29 % 1000 as double) + 0.25D, 'z', 5.0D) else named_struct('x', cast(c_custkey * 17 % 1000 as double) + 0.5D, 'y', cast(c_custkey * 43 % 1000 as double) + 0.5D, 'z', 6.0D) end").alias("target"),
    )


#: Local vertices and faces of the meshes that instances are made of; the last has no faces.
MESHES = {
    "block": ([(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)], [(0, 1, 3), (0, 3, 2), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 3, 7), (1, 7, 5)]),
    "spike": ([(1.0, 1.0, 1.0), (-1.0, -1.0, 1.0), (-1.0, 1.0, -1.0), (1.0, -1.0, -1.0)], [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]),
    "pane": ([(-1.0, 0.25, -1.0), (1.0, 0.25, -1.0), (1.0, 0.25, 1.0), (-1.0, 0.25, 1.0)], [(0, 1, 2), (0, 2, 3)]),
    "empty": ([(-1.0, -1.0, -1.0), (1.0, 1.0, 1.0)], []),
}


def mesh_triangles(spark: SparkSession) -> DataFrame:
    v3 = "struct<x:double,y:double,z:double>"
    rows = [(name, i, *(vertices[k] for k in face)) for name, (vertices, faces) in MESHES.items() for i, face in enumerate(faces)]
    return spark.createDataFrame(rows, f"mesh string, polygon_index int, a {v3}, b {v3}, c {v3}")


def mesh_bounds(spark: SparkSession) -> DataFrame:
    v3 = "struct<x:double,y:double,z:double>"
    rows = [(name, tuple(map(min, zip(*vertices))), tuple(map(max, zip(*vertices))), len(faces)) for name, (vertices, faces) in MESHES.items()]
    return spark.createDataFrame(rows, f"mesh string, lo {v3}, hi {v3}, n_polygons int")


def mesh_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance of a mesh for each part, turned by one of five angles, longer one way in every second, of no width
    in every 97th; some are hidden, and some belong to an object that is left out."""
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as k", "cast(p_partkey * 37 % 1000 as double) as x", "cast(p_partkey * 71 % 1000 as double) as y", "if(p_partkey % 97 = 0, 0.0D, p_size / 10.0D) as sx", "p_size / 10.0D * (1 + p_partkey % 2) as sy", "p_size / 10.0D as sz",
        "element_at(array(1.0D, 0.6D, 0.8D, 0.0D, -0.6D), cast(p_partkey % 5 + 1 as int)) as c", "element_at(array(0.0D, 0.8D, -0.6D, 1.0D, 0.8D), cast(p_partkey % 5 + 1 as int)) as s",
    )
    return p.select(
        F.expr("concat('I', lpad(cast(k as string), 9, '0'))").alias("name"),
        F.expr("if(k % 17 = 0, 'Areas', null)").alias("parent"),
        F.expr("if(k % 29 = 0, 'empty', element_at(array('block', 'spike', 'pane'), cast(k % 3 + 1 as int)))").alias("mesh"),
        F.expr("array(c * sx, -s * sy, 0.0D, x, s * sx, c * sy, 0.0D, y, 0.0D, 0.0D, sz, 5.0D)").alias("matrix"),
        F.expr("k % 13 <> 5").alias("visible"),
    )


def excluded_objects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Areas",), ("I000000007",)], "name string")


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle for each part: level, or rising in every fourth; in tasks of about TASK_SURFACES, since parts are few
    bytes, of which Spark would make one task, and cutting them is much work."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    p = p.repartition(max(spark.sparkContext.defaultParallelism, p.count() // TASK_SURFACES), "p_partkey").selectExpr("p_partkey as k", "cast(p_size as double) as s", "cast(p_partkey * 37 % 1000 as double) as x", "cast(p_partkey * 71 % 1000 as double) as y", "(p_partkey % 40) * 0.1D as z", "if(p_partkey % 4 = 0, 1.0D, 0.0D) as up", "p_brand")
    return p.select(
        F.col("p_brand").alias("name"),
        F.col("k").cast("int").alias("polygon_index"),
        F.expr("named_struct('x', x, 'y', y, 'z', z)").alias("a"),
        F.expr("named_struct('x', x + s, 'y', y, 'z', z)").alias("b"),
        F.expr("named_struct('x', x, 'y', y + 2.0D, 'z', z + up)").alias("c"),
    )


def area_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each nation on a grid of 200 by 200."""
    return table(spark, sf_dir, "nation").selectExpr("concat('AREA_', lpad(cast(n_nationkey as string), 2, '0')) as area", "200.0D * (n_nationkey div 5) as xlo", "200.0D * (n_nationkey div 5) + 150 as xhi", "200.0D * n_regionkey as ylo", "200.0D * n_regionkey + 150 as yhi", "0.4D * n_regionkey as zlo", "0.4D * n_regionkey + 3 as zhi")


def scene_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each part, with a name of eight kinds, collections and dimensions."""
    kinds = "array('Hall floor', 'Wall lamp', 'On-wall clock', 'Stair step', 'NavMesh path', 'AREA box', 'Front door', 'Chair')"
    return table(spark, sf_dir, "part").selectExpr(
        f"concat(element_at({kinds}, cast(p_partkey % 8 + 1 as int)), ' ', cast(p_partkey div 16 as string), if(p_partkey % 16 > 7, '.001', '')) as name",
        "p_type as collections",
        "if(p_partkey % 10 = 9, 'EMPTY', 'MESH') as type",
        "p_size * 1500 as polygons",
        "p_size * 700 as vertices",
        "p_size * 4.0D as dx",
        "p_size * 5.0D as dy",
        "if(p_partkey % 3 = 0, 0.005D, if(p_partkey % 7 = 0, 60.0D, 3.0D)) as dz",
        "p_brand",
    )


def portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("concat('PORTAL_', if(s_suppkey % 2 = 0, '1F_', '2F_'), lpad(cast(s_suppkey as string), 6, '0')) as name", "cast(s_nationkey as double) as x", "cast(s_suppkey % 3 as double) as y", "0.0D as z", "2.0D as dx", "-1.0D as dy", "3.0D as dz")


def proposed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each supplier between two nations, often flawed."""
    s = table(spark, sf_dir, "supplier").selectExpr("concat('X', cast(if(s_suppkey % 20 = 19, s_suppkey - 1, s_suppkey) as string)) as edge_id", "s_nationkey as a", "cast(s_suppkey % 27 as int) as b", "cast(s_suppkey % 3 as int) as k", "cast(s_suppkey % 4 as int) as q")
    z = lambda c: f"4.0D * ({c} % 5)"
    return s.select(
        "edge_id",
        F.expr(_id("N", "a")).alias("from_node_id"),
        F.expr(_id("N", "b")).alias("to_node_id"),
        F.expr(f"array(named_struct('x', 10.0D * (a div 5), 'y', 0.0D, 'z', {z('a')}), named_struct('x', 10.0D * (b div 5), 'y', if(q = 3, 1.0D, 0.0D), 'z', {z('b')}))").alias("polyline"),
        F.expr("element_at(array('WALK', 'STAIR_UP', 'STAIR_DOWN'), k + 1)").alias("transition_type"),
        F.expr("if(q = 0, null, concat('S', cast(q as string)))").alias("stair_id"),
    )


def proposed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transition for each supplier: cameras at the ends of a walk of one or two graph edges, often flawed."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('Y', cast(s_suppkey as string)) as transition_id",
        f"{_id('C', 's_nationkey')} as from_camera_id",
        f"{_id('C', 's_suppkey % 26')} as to_camera_id",
        "element_at(array('ADJACENT', 'SAME_ZONE', 'STAIR_UP', 'STAIR_DOWN'), cast(s_suppkey % 4 + 1 as int)) as transition_type",
        f"{_id('N', 's_nationkey')} as navigation_from_node_id",
        f"{_id('N', 's_suppkey % 26')} as navigation_to_node_id",
        "array(concat('E', lpad(cast(s_nationkey as string), 2, '0'), '_', lpad(cast(s_suppkey % 26 as string), 2, '0'))) as navigation_edge_ids",
    )
