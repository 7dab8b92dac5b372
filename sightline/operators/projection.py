"""Pinhole projection of points into cameras, and of pixels back onto planes.

Cameras come with their camera-to-world matrix flattened: r00 .. r22, tx, ty, tz. The camera looks along its local -z,
pixels count from the top left, and clipping uses the depth along the axis, both ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import canonical_id, float_hex
from ..functions.columns import finite, first_failure, norm

NOT_PARALLEL = 1e-12


def flattened(cameras: DataFrame) -> DataFrame:
    """cameras with camera_to_world as columns and the matrix's last row as w0 .. w3."""
    m = F.col("camera_to_world")
    cells = {f"r{i}{j}": m[i][j] for i in range(3) for j in range(3)} | {t: m[i][3] for i, t in enumerate(("tx", "ty", "tz"))} | {f"w{j}": m[3][j] for j in range(4)}
    return cameras.withColumns(cells)


def _r(i: int, j: int) -> Column:
    return F.col(f"r{i}{j}")


def determinant() -> Column:
    return _r(0, 0) * (_r(1, 1) * _r(2, 2) - _r(1, 2) * _r(2, 1)) - _r(0, 1) * (_r(1, 0) * _r(2, 2) - _r(1, 2) * _r(2, 0)) + _r(0, 2) * (_r(1, 0) * _r(2, 1) - _r(1, 1) * _r(2, 0))


def rigid() -> Column:
    """The pose is a rotation and a translation: last row (0, 0, 0, 1), columns orthonormal, determinant one."""
    ok = finite(*(_r(i, j) for i in range(3) for j in range(3)), *map(F.col, ("tx", "ty", "tz")))
    for j, want in enumerate((0, 0, 0, 1)):
        ok = ok & (F.abs(F.col(f"w{j}") - want) <= 1e-6)
    for a in range(3):
        for b in range(a, 3):
            ok = ok & (F.abs(_r(0, a) * _r(0, b) + _r(1, a) * _r(1, b) + _r(2, a) * _r(2, b) - (1 if a == b else 0)) <= 1e-5)
    return ok & (F.abs(determinant() - 1) < 1e-5)


def project_world(points: DataFrame, x: str = "X", y: str = "Y", z: str = "Z") -> DataFrame:
    """points joined with their camera's columns, plus depth, u, v, reason and in_frustum.

    Behind, nearer or farther than the clipping range there is no pixel; outside the image the pixel is kept.
    """
    d = [F.col(a) - F.col(t) for a, t in ((x, "tx"), (y, "ty"), (z, "tz"))]
    det = determinant()

    def cofactor(i: int, j: int) -> Column:
        a, b = [k for k in range(3) if k != i]
        c, e = [k for k in range(3) if k != j]
        sign = 1 if (i + j) % 2 == 0 else -1
        return sign * (_r(a, c) * _r(b, e) - _r(a, e) * _r(b, c))

    local = [(cofactor(0, i) * d[0] + cofactor(1, i) * d[1] + cofactor(2, i) * d[2]) / det for i in range(3)]
    near_far = F.col("depth").isNotNull() & (F.col("depth") > 0) & (F.col("depth") >= F.col("clip_start")) & (F.col("depth") <= F.col("clip_end"))
    placed = points.withColumns({"lx": local[0], "ly": local[1], "depth": -local[2]})
    placed = placed.withColumn("u", F.when(near_far, F.col("fx") * F.col("lx") / F.col("depth") + F.col("cx"))).withColumn("v", F.when(near_far, F.col("cy") - F.col("fy") * F.col("ly") / F.col("depth")))
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))
    reason = F.coalesce(
        first_failure((F.col("depth") <= 0, "BEHIND_CAMERA"), (F.col("depth") < F.col("clip_start"), "NEAR_CLIPPED"), (F.col("depth") > F.col("clip_end"), "FAR_CLIPPED"), (~inside, "OUTSIDE_FOV")),
        F.lit("IN_FRUSTUM"),
    )
    return placed.withColumn("reason", reason).withColumn("in_frustum", F.col("reason") == "IN_FRUSTUM").drop("lx", "ly")


def inverse_project(frames: DataFrame, cameras: DataFrame, plane_of: str = "plane_id", planes: DataFrame | None = None) -> DataFrame:
    """frames with world position x, y, z on their plane, projection_quality and failure (null where it worked).

    frames has camera_id, status, u, v and, where planes is given, plane_id. Cameras (flattened) and planes are
    configuration tables. The first failing check in order names the failure: FRAME_NOT_OBSERVED, CAMERA_MISMATCH,
    PIXEL_OUTSIDE_IMAGE, INVALID_CAMERA_POSE, INVALID_PLANE, RAY_PARALLEL_TO_PLANE, INTERSECTION_BEHIND_CAMERA,
    NEAR_CLIPPED, FAR_CLIPPED, NUMERICAL_FAILURE.
    """
    both = frames.join(cameras.withColumn("has_camera", F.lit(True)), "camera_id", "left")
    if planes is not None:
        p = planes.select(F.col("plane_id").alias(plane_of), *(F.col(f"point.{a}").alias(f"p{a}") for a in "xyz"), *(F.col(f"normal.{a}").alias(f"n{a}") for a in "xyz"))
        both = both.join(p, plane_of, "left")
    rx, ry = (F.col("u") - F.col("cx")) / F.col("fx"), (F.col("cy") - F.col("v")) / F.col("fy")
    both = both.withColumns({f"d{a}": _r(i, 0) * rx + _r(i, 1) * ry - _r(i, 2) for i, a in enumerate("xyz")})
    direction, normal = F.struct(F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z")), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))
    facing = F.col("nx") * F.col("dx") + F.col("ny") * F.col("dy") + F.col("nz") * F.col("dz")
    offset = F.col("nx") * (F.col("px") - F.col("tx")) + F.col("ny") * (F.col("py") - F.col("ty")) + F.col("nz") * (F.col("pz") - F.col("tz"))
    both = both.withColumn("facing", facing).withColumn("quality", F.least(F.lit(1.0), F.abs(F.col("facing")) / norm(direction)))
    both = both.withColumn("depth", F.when(F.abs(F.col("facing")) > NOT_PARALLEL, offset / F.col("facing")))
    both = both.withColumns({a: F.col(t) + F.col("depth") * F.col(f"d{a}") for a, t in zip("xyz", ("tx", "ty", "tz"))})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))
    failure = first_failure(
        (no(F.col("status") == "OBSERVED"), "FRAME_NOT_OBSERVED"),
        (F.col("has_camera").isNull(), "CAMERA_MISMATCH"),
        (no(inside), "PIXEL_OUTSIDE_IMAGE"),
        (no(rigid()), "INVALID_CAMERA_POSE"),
        (no(F.abs(norm(normal) - 1) <= 1e-6), "INVALID_PLANE"),
        (F.abs(F.col("facing")) <= NOT_PARALLEL, "RAY_PARALLEL_TO_PLANE"),
        (no(finite(F.col("depth"))), "NUMERICAL_FAILURE"),
        (F.col("depth") <= 0, "INTERSECTION_BEHIND_CAMERA"),
        (F.col("depth") < F.col("clip_start"), "NEAR_CLIPPED"),
        (F.col("depth") > F.col("clip_end"), "FAR_CLIPPED"),
        (no(finite(F.col("x"), F.col("y"), F.col("z"))), "NUMERICAL_FAILURE"),
    )
    both = both.withColumn("failure", failure)
    ok = F.col("failure").isNull()
    return both.withColumns({a: F.when(ok, F.col(a)) for a in "xyz"} | {"projection_quality": F.when(ok, F.col("quality"))}).select(*frames.columns, "x", "y", "z", "projection_quality", "failure")


def point_id(camera: Column, target: Column, frame_id: Column, timestamp: Column, plane: Column) -> Column:
    """A point's identity: the same for the same frame and plane in every run."""
    return canonical_id("projected:", camera, target, frame_id, float_hex(timestamp), plane)


def camera_basis(cameras: DataFrame) -> DataFrame:
    """camera_id, forward and up axes in the world, from the flattened matrix."""
    return cameras.select("camera_id", *((-_r(i, 2)).alias(f"forward_{a}") for i, a in enumerate("xyz")), *(_r(i, 1).alias(f"up_{a}") for i, a in enumerate("xyz")))


def intrinsics(view: DataFrame) -> DataFrame:
    """Focal lengths and centre in pixels from a camera's view frame (left, right, bottom, top at distance one)."""
    c = F.col
    fx, fy = c("width") / (c("right") - c("left")), c("height") / (c("top") - c("bottom"))
    return view.withColumn("fx", fx).withColumn("fy", fy).withColumn("cx", -c("left") * fx).withColumn("cy", c("top") * fy)


def floor_and_zone(name: Column) -> tuple[Column, Column]:
    """Floor and zone of a name like CAM_1F_HALL_WEST_03: the part after CAM, and the rest without a trailing number."""
    parts = F.split(name, "_")
    named = name.rlike(r"^CAM_\d+F_")
    rest = F.when(F.element_at(parts, -1).rlike(r"^\d+$"), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0)))).otherwise(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))))
    return F.when(named, parts[1]), F.when(named, F.nullif(F.array_join(rest, "_"), F.lit("")))
