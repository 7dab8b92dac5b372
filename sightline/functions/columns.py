"""Vectors, tolerances, polylines and bins as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*columns: Column) -> Column:
    """Neither null, NaN nor infinite. Spark holds NaN above infinity, so one comparison tells both apart."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))
    return out


def vec(x, y, z) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"), F.lit(z).cast("double").alias("z"))


def minus(a: Column, b: Column) -> Column:
    return F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y"), (a["z"] - b["z"]).alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]) + (b["z"] - a["z"]) * (b["z"] - a["z"]))


def pairs_of(array: Column, f) -> Column:
    """f over neighbouring elements; empty for arrays of fewer than two."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), f)


def total(array: Column) -> Column:
    """Sum of an array of doubles from the left."""
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def segment_lengths(polyline: Column) -> Column:
    return pairs_of(polyline, distance)


def strictly_increasing(array: Column) -> Column:
    return F.forall(pairs_of(array, lambda a, b: a < b), lambda ok: ok)


def all_distinct(array: Column) -> Column:
    return F.size(F.array_distinct(array)) == F.size(array)


def ulp(x: Column) -> Column:
    """Distance from |x| to the next double. log2 may be off by one near powers of two, so its floor is corrected."""
    a = F.abs(x)
    e = F.floor(F.log2(F.greatest(a, F.lit(2.0**-1022))))
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    return F.when(a < F.lit(2.0**-1022), F.lit(2.0**-1074)).otherwise(F.pow(F.lit(2.0), e - 52))


def exceeds(value: Column, limit: Column) -> Column:
    """Above the limit by more than rounding: 1e-12 or four units in the last place of either."""
    slack = F.greatest(F.lit(1e-12), 4 * F.greatest(ulp(value), ulp(limit)))
    return (value > limit) & ((value - limit) > slack)


def is_close(a: Column, b: Column, rel: float = 1e-12, abs_: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def bin_of(x: Column, width: float) -> Column:
    """Centre of x's bin; halves go to the even bin."""
    return F.rint(x / width) * width


def first_failure(*cases: tuple[Column, str]) -> Column:
    """Name of the first case that holds, else null."""
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in cases))
