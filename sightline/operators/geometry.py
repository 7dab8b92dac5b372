"""Triangles, clipping, surfaces and clusters for the geometry audit."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bin_of, cross, minus, norm
from ..functions.exact import exact_medians, let

HORIZONTAL_NZ = 0.95
LAYER = 0.25
MIN_AREA = 1e-12


def triangle_measures(triangles: DataFrame) -> DataFrame:
    """triangles (name, polygon_index, a, b, c) with area_3d, normal_z, slope_degrees, z_min, z_max, z_mean, centroid and xy bounds; triangles without area go."""
    n = cross(minus(F.col("b"), F.col("a")), minus(F.col("c"), F.col("a")))
    t = triangles.withColumn("n", n).withColumn("twice", norm(F.col("n"))).where(F.col("twice") / 2 > MIN_AREA)
    nz = F.col("n.z") / F.col("twice")
    three = lambda f, axis: f(F.col(f"a.{axis}"), F.col(f"b.{axis}"), F.col(f"c.{axis}"))
    mean = lambda x, y, z: (x + y + z) / 3
    return t.select(
        *triangles.columns,
        (F.col("twice") / 2).alias("area_3d"),
        nz.alias("normal_z"),
        F.degrees(F.acos(F.least(F.lit(1.0), F.abs(nz)))).alias("slope_degrees"),
        three(F.least, "z").alias("z_min"),
        three(F.greatest, "z").alias("z_max"),
        three(mean, "z").alias("z_mean"),
        F.struct(*(three(mean, a).alias(a) for a in "xyz")).alias("centroid"),
        *(three(f, a).alias(f"{a}{s}") for a in "xy" for f, s in ((F.least, "min"), (F.greatest, "max"))),
    )


def horizontal(measured: DataFrame, nz: float = HORIZONTAL_NZ) -> DataFrame:
    return measured.where((F.col("normal_z") >= nz) & (F.col("z_max") - F.col("z_min") <= 0.05))


def clip_to_box(polygon: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """A polygon (array of x, y structs) cut by the four sides of a box, folded over the sides so that the expression stays small.

    Each corner gives the crossing of the side that ends in it, if any, and itself, if inside.
    """
    side = lambda on_x, bound, above: F.struct(F.lit(on_x).alias("on_x"), bound.cast("double").alias("bound"), F.lit(above).alias("above"))
    sides = F.array(side(True, xmin, True), side(True, xmax, False), side(False, ymin, True), side(False, ymax, False))

    def cut(corners: Column, s: Column) -> Column:
        at = lambda p: F.when(s["on_x"], p["x"]).otherwise(p["y"])
        inside = lambda p: F.when(s["above"], at(p) >= s["bound"]).otherwise(at(p) <= s["bound"])

        def corner(p: Column, i: Column) -> Column:
            prev = F.element_at(corners, F.when(i == 0, F.size(corners)).otherwise(i))
            t = F.try_divide(s["bound"] - at(prev), at(p) - at(prev))
            x = F.when(s["on_x"], s["bound"]).otherwise(prev["x"] + t * (p["x"] - prev["x"]))
            y = F.when(s["on_x"], prev["y"] + t * (p["y"] - prev["y"])).otherwise(s["bound"])
            crossed = (inside(p) != inside(prev)) & (F.abs(at(p) - at(prev)) > 1e-12)
            return F.filter(F.array(F.when(crossed, F.struct(x.alias("x"), y.alias("y"))), F.when(inside(p), p)), lambda q: q.isNotNull())

        return F.flatten(F.transform(corners, corner))

    return F.aggregate(sides, polygon, cut)


def polygon_area(polygon: Column) -> Column:
    """Shoelace area of an array of x, y structs; zero for fewer than three corners."""
    n = F.size(polygon)
    turned = F.concat(F.slice(polygon, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1))
    twice = F.aggregate(F.zip_with(polygon, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x)
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """polygon_area of a triangle's corners, term by term, without making an array of them."""
    term = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    return F.abs(term(a, b) + term(b, c) + term(c, a)) / 2


def flat(*corners: str) -> Column:
    return F.array(*(F.struct(F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")) for c in corners))


def overlap_areas(boxes: DataFrame, measured: DataFrame, near: Column, least_area: float, cell: float = 10.0) -> DataFrame:
    """Pairs of a box (area, xlo, xhi, ylo, yhi, zlo, zhi) and a triangle that overlap in x and y and satisfy `near`, with clipped_area.

    Both are dealt to grid cells; a pair is looked at in the first cell that it shares. Only triangles that reach over
    their box's sides are cut.
    """

    def cells(df: DataFrame, lo: tuple[str, str], hi: tuple[str, str]) -> DataFrame:
        df = df.withColumn("gx", F.explode(F.sequence(F.floor(F.col(lo[0]) / cell), F.floor(F.col(hi[0]) / cell))))
        return df.withColumn("gy", F.explode(F.sequence(F.floor(F.col(lo[1]) / cell), F.floor(F.col(hi[1]) / cell))))

    b = cells(boxes, ("xlo", "ylo"), ("xhi", "yhi"))
    t = cells(measured, ("xmin", "ymin"), ("xmax", "ymax"))
    meets = (F.col("xmax") >= F.col("xlo")) & (F.col("xmin") <= F.col("xhi")) & (F.col("ymax") >= F.col("ylo")) & (F.col("ymin") <= F.col("yhi"))
    first = (F.col("gx") == F.floor(F.greatest("xlo", "xmin") / cell)) & (F.col("gy") == F.floor(F.greatest("ylo", "ymin") / cell))
    pairs = b.join(t, ["gx", "gy"]).where(meets & first & near).drop("gx", "gy")
    inside = (F.col("xmin") >= F.col("xlo")) & (F.col("xmax") <= F.col("xhi")) & (F.col("ymin") >= F.col("ylo")) & (F.col("ymax") <= F.col("yhi"))
    cut = let(clip_to_box(flat("a", "b", "c"), F.col("xlo"), F.col("xhi"), F.col("ylo"), F.col("yhi")), polygon_area)
    area = F.array(F.when(inside, triangle_area(F.col("a"), F.col("b"), F.col("c"))).otherwise(cut))
    # exploded, as a condition on a column would work the area out once more
    return pairs.withColumn("clipped_area", F.explode(F.filter(area, lambda x: x > least_area)))


def area_layers(boxes: DataFrame, measured: DataFrame, z_tolerance: float = 0.5) -> DataFrame:
    """area, z, clipped_xy_area, coverage of the horizontal surfaces near each box's lower side, by height to two decimals."""
    near = F.abs(F.col("z_mean") - F.col("zlo")) <= z_tolerance
    hit = overlap_areas(boxes, horizontal(measured), near, 1e-9).withColumn("z", F.bround("z_mean", 2))
    box = (F.col("xhi") - F.col("xlo")) * (F.col("yhi") - F.col("ylo"))
    by = hit.withColumn("box_area", box).groupBy("area", "z", "box_area").agg(F.sum("clipped_area").alias("clipped_xy_area"))
    return by.select("area", "z", "clipped_xy_area", F.coalesce(F.try_divide("clipped_xy_area", "box_area"), F.lit(0.0)).alias("coverage"))


def stair_triangles(boxes: DataFrame, measured: DataFrame) -> DataFrame:
    """Triangles over each stair box, from two below to ten above it."""
    return overlap_areas(boxes, measured, (F.col("z_max") >= F.col("zlo") - 2.0) & (F.col("z_min") <= F.col("zhi") + 10.0), 1e-7)


def stair_levels(relevant: DataFrame) -> DataFrame:
    """area, z, clipped_xy_area, up, down of level surfaces in bins of 0.05 with an area of 0.01 or more."""
    level = relevant.where((F.abs("normal_z") >= HORIZONTAL_NZ) & (F.col("z_max") - F.col("z_min") <= 0.05)).withColumn("z", bin_of(F.col("z_mean"), 0.05))
    return level.groupBy("area", "z").agg(F.sum("clipped_area").alias("clipped_xy_area"), F.count_if(F.col("normal_z") > 0).alias("up"), F.count_if(F.col("normal_z") <= 0).alias("down")).where("clipped_xy_area >= 0.01")


def slopes(relevant: DataFrame, *by: str) -> DataFrame:
    """Area and slopes of surfaces steeper than 5 and not above 55 degrees, with an area of 0.01 or more. relevant is
    read a few times, as medians are narrowed in passes."""
    s = relevant.where((F.col("slope_degrees") > 5) & (F.col("slope_degrees") <= 55))
    found = s.groupBy(*by).agg(F.sum("clipped_area").alias("clipped_xy_area"), F.min("slope_degrees").alias("slope_min"), F.max("slope_degrees").alias("slope_max"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max")).where("clipped_xy_area >= 0.01")
    return found.join(exact_medians(s, list(by), "slope_degrees", "slope_median"), list(by))


def plane_z_at(a: Column, b: Column, c: Column, x: Column, y: Column) -> Column:
    """Height of a triangle over a point, null outside it or where it stands upright."""
    det = (b["y"] - c["y"]) * (a["x"] - c["x"]) + (c["x"] - b["x"]) * (a["y"] - c["y"])
    u = F.try_divide((b["y"] - c["y"]) * (x - c["x"]) + (c["x"] - b["x"]) * (y - c["y"]), det)
    v = F.try_divide((c["y"] - a["y"]) * (x - c["x"]) + (a["x"] - c["x"]) * (y - c["y"]), det)
    w = 1 - u - v
    return F.when((F.abs(det) >= 1e-12) & (F.least(u, v, w) >= -1e-8), u * a["z"] + v * b["z"] + w * c["z"])


def top_surface_grid(relevant: DataFrame, grid: int = 9) -> DataFrame:
    """area, i, j, z: the highest surface over the centre of each cell of a grid over each box. relevant: stair_triangles()."""
    cells = relevant.where(F.abs("normal_z") >= 0.05)
    lo = lambda a: F.greatest(F.lit(0), F.floor((F.col(f"{a}min") - F.col(f"{a}lo")) * grid / (F.col(f"{a}hi") - F.col(f"{a}lo")) - 0.5).cast("int"))
    hi = lambda a: F.least(F.lit(grid - 1), F.ceil((F.col(f"{a}max") - F.col(f"{a}lo")) * grid / (F.col(f"{a}hi") - F.col(f"{a}lo")) - 0.5).cast("int"))
    over = lambda a: F.explode(F.when(lo(a) <= hi(a), F.sequence(lo(a), hi(a))))
    cells = cells.withColumn("i", over("x")).withColumn("j", over("y"))
    x = F.col("xlo") + (F.col("i") + 0.5) * (F.col("xhi") - F.col("xlo")) / grid
    y = F.col("ylo") + (F.col("j") + 0.5) * (F.col("yhi") - F.col("ylo")) / grid
    z = plane_z_at(F.col("a"), F.col("b"), F.col("c"), x, y)
    return cells.withColumn("z", z).where((F.col("z") >= F.col("zlo") - 2.0) & (F.col("z") <= F.col("zhi") + 10.0)).groupBy("area", "i", "j").agg(F.max("z").alias("z"))


def clusters(values: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """key, cluster, mean, min, max, n: sorted values, each in the last cluster while it is within tolerance above that cluster's mean.

    A value more than the tolerance above the one before it always begins a cluster. Such gaps are found between bins
    that are a tolerance wide, and each run of values without one is folded in order, with counts for repeats: within a
    run a value depends on all before it.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col(value) / tolerance))
    by_bin = Window.partitionBy(key).orderBy("bin")
    bins = counted.groupBy(key, "bin").agg(F.min(value).alias("least"), F.max(value).alias("most"))
    begins = F.coalesce((F.col("least") - F.lag("most").over(by_bin) > tolerance).cast("int"), F.lit(1))
    bins = bins.withColumn("begins", begins).select(F.col(key).alias("bin_key"), "bin", F.sum("begins").over(by_bin).alias("run"))
    runs = counted.join(bins, counted[key].eqNullSafe(bins["bin_key"]) & (counted["bin"] == bins["bin"]))
    ordered = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias("vs"))
    cluster = "struct<sum:double,n:bigint,lo:double,hi:double>"
    zero = F.array().cast(f"array<{cluster}>")
    one = lambda e: F.struct((e["v"] * e["n"]).alias("sum"), e["n"].alias("n"), e["v"].alias("lo"), e["v"].alias("hi"))

    def add(done: Column, e: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct((last["sum"] + e["v"] * e["n"]).alias("sum"), (last["n"] + e["n"]).alias("n"), last["lo"].alias("lo"), e["v"].alias("hi"))
        fits = (F.size(done) > 0) & (F.try_subtract(e["v"], last["sum"] / last["n"]) <= tolerance)
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(head, F.array(grown))).otherwise(F.concat(done, F.array(one(e))))

    made = ordered.select(key, "run", F.aggregate("vs", zero, add).alias("made"))
    before = F.sum(F.size("made")).over(Window.partitionBy(key).orderBy("run")) - F.size("made")
    folded = made.withColumn("before", before).select(key, "before", F.posexplode("made").alias("pos", "c")).withColumn("cluster", (F.col("before") + F.col("pos")).cast("int"))
    return folded.select(key, "cluster", (F.col("c.sum") / F.col("c.n")).alias("mean"), F.col("c.lo").alias("min"), F.col("c.hi").alias("max"), "c.n")


def bounds(points: DataFrame, *by: str) -> DataFrame:
    """Least and greatest x, y, z of points, by group."""
    return points.groupBy(*by).agg(*(f(a).alias(f"{a}{s}") for a in "xyz" for f, s in ((F.min, "min"), (F.max, "max"))))


def transform_point(x: str, y: str, z: str) -> Column:
    """A point under the affine map of the flattened matrix columns r00 .. r22, tx, ty, tz."""
    p = [F.col(c) for c in (x, y, z)]
    return F.struct(*((F.col(f"r{i}0") * p[0] + F.col(f"r{i}1") * p[1] + F.col(f"r{i}2") * p[2] + F.col(f"t{a}")).alias(a) for i, a in enumerate("xyz")))


def instance_bounds(instances: DataFrame, *by: str) -> DataFrame:
    """Bounds of boxes (lo, hi) under their matrices, from all eight transformed corners, by group."""
    corners = F.array(*(F.struct(*(F.col(f"{end}.{a}").alias(a) for end, a in zip(ends, "xyz"))) for ends in product(("lo", "hi"), repeat=3)))
    moved = instances.withColumn("corner", F.explode(corners)).withColumns({f"corner_{a}": F.col(f"corner.{a}") for a in "xyz"})
    return bounds(moved.select(*by, transform_point("corner_x", "corner_y", "corner_z").alias("p")).select(*by, "p.*"), *by)


def area_layer_tops(boxes: DataFrame, measured: DataFrame, z_tolerance: float = 0.5, objects: int = 8, faces: int = 5) -> DataFrame:
    """area, z, kind, rank, name, polygon_index, clipped_xy_area: of each layer of area_layers, the objects and the faces
    with the largest areas within the box; areas are compared to nine decimals, ties go by name and index."""
    near = F.abs(F.col("z_mean") - F.col("zlo")) <= z_tolerance
    hit = overlap_areas(boxes, horizontal(measured), near, 1e-9).withColumn("z", F.bround("z_mean", 2))
    total = F.round(F.sum("clipped_area"), 9).alias("clipped_xy_area")
    face = hit.groupBy("area", "z", "name", "polygon_index").agg(total)
    object_ = hit.groupBy("area", "z", "name").agg(total).withColumn("polygon_index", F.lit(None).cast("int"))
    order = [F.desc("clipped_xy_area"), "name", "polygon_index"]
    columns = ["area", "z", "kind", "rank", "name", "polygon_index", "clipped_xy_area"]
    top = lambda df, kind, k: top_per_group(df, ["area", "z"], order, k).withColumn("kind", F.lit(kind)).select(*columns)
    return top(object_, "object", objects).unionByName(top(face, "face", faces))


def polygons(measured: DataFrame) -> DataFrame:
    """Triangles of one polygon together: area, flat area, height weighted by area, bounds and the greatest normal."""
    return measured.groupBy("name", "polygon_index").agg(
        F.sum("area_3d").alias("area"),
        F.sum(F.col("area_3d") * F.abs("normal_z")).alias("xy_area"),
        (F.sum(F.col("area_3d") * F.col("z_mean")) / F.sum("area_3d")).alias("z"),
        *(F.min(f"{a}min").alias(f"{a}min") for a in "xy"),
        *(F.max(f"{a}max").alias(f"{a}max") for a in "xy"),
        F.max("normal_z").alias("normal_z"),
    )


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
