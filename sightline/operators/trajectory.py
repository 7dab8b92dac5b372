"""Sampling of configured 3D paths.

Time is a count of ticks. A trajectory's tick is 1 / (10^decimals * rate) of a second, decimals being the most that any of
its own keyframe times has, so that grid and keyframe times are whole numbers and quotients of them are rounded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import distance
from ..functions.exact import WHOLE, ratio

MAX_SAMPLES = 1_000_000
#: Ticks stay below this, so that differences of two are longs.
MAX_TICKS = 2**62
#: Fixed value: the last frame number of an evaluator.
LAST_FRAME = 1_048_574


def keyframe_ticks(keyframes: DataFrame) -> DataFrame:
    """keyframes (trajectory_id, sample_rate_hz, timestamp, x, y, z, floor_id, zone_id, semantic_region) with tick and
    per_second, its trajectory's ticks of a second. timestamp is a decimal, of 18 decimals at most; other numbers are taken as they are
    written. Times of 2^62 ticks or more fail."""
    time = F.col("timestamp").cast("string").cast("decimal(38,18)")
    # whole seconds and what is left apart: a product of all digits at once would not fit
    timed = keyframes.withColumn("__rest", time % F.lit(1).cast("decimal(1,0)")).withColumn("__seconds", (time - F.col("__rest")).cast(WHOLE))
    digits = F.rtrim(F.lpad((F.abs("__rest") * F.lit(10**18).cast("decimal(19,0)")).cast(WHOLE).cast("string"), 18, "0"), F.lit("0"))
    powers = F.array(*(F.lit(10**n).cast("decimal(19,0)") for n in range(19)))
    timed = timed.withColumn("__unit", F.element_at(powers, F.max(F.length(digits)).over(Window.partitionBy("trajectory_id")) + 1))
    timed = timed.withColumn("per_second", (F.col("__unit") * F.col("sample_rate_hz")).cast(WHOLE))
    tick = (F.col("__seconds") * F.col("per_second") + (F.col("__rest") * F.col("__unit")).cast(WHOLE) * F.col("sample_rate_hz")).cast(WHOLE)
    sound = (F.abs(tick) < MAX_TICKS) & (F.col("per_second") < MAX_TICKS)
    return timed.withColumn("tick", F.when(sound | F.col("timestamp").isNull(), tick.try_cast("long")).otherwise(F.raise_error(F.lit("keyframe time has too many ticks")).cast("long"))).withColumn("per_second", F.col("per_second").try_cast("long")).drop("__seconds", "__rest", "__unit")


def sample_trajectories(keyframes: DataFrame, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """trajectory_id, sample_no, timestamp, X, Y, Z, VX, VY, VZ, floor_id, zone_id, semantic_region for every grid and keyframe time.

    Position is linear between keyframes, velocity that of the segment to the right (of the last sample, to the left),
    and labels those of the keyframe at or before the sample. A trajectory of more than max_samples fails before its
    samples are made. Each keyframe makes the samples up to the next one, so that only keyframes are shuffled.
    """
    keys = keyframe_ticks(keyframes)
    whole = Window.partitionBy("trajectory_id")
    order = whole.orderBy("tick")
    at = F.struct("tick", "x", "y", "z")
    keys = keys.withColumns({"after": F.lead(at).over(order), "before": F.lag(at).over(order), "first": F.min("tick").over(whole), "step": F.expr("per_second div sample_rate_hz")})
    # the grid times between a keyframe and the next one, by number
    keys = keys.withColumn("low", F.expr("(tick - first) div step + 1")).withColumn("inner", F.coalesce(F.greatest(F.expr("(after.tick - first - 1) div step") - F.col("low") + 1, F.lit(0)), F.lit(0)))
    keys = keys.withColumns({"upto": F.sum(F.col("inner") + 1).over(order), "total": F.sum(F.col("inner") + 1).over(whole)})
    seconds = lambda ticks: ratio(ticks, F.col("per_second"))

    def velocity(axis: str) -> Column:
        right = (F.col(f"after.{axis}") - F.col(axis)) / F.col("to_next")
        left = (F.col(axis) - F.col(f"before.{axis}")) / F.col("from_last")
        return F.when(F.col("after").isNotNull(), right).otherwise(left)

    keys = keys.withColumn("to_next", seconds(F.col("after.tick") - F.col("tick"))).withColumn("from_last", seconds(F.col("tick") - F.col("before.tick")))
    keys = keys.withColumns({f"v{a}": velocity(a) for a in "xyz"})
    checked = F.when(F.col("total") > max_samples, F.raise_error(F.lit("too many samples")).cast("long")).otherwise(F.col("inner"))
    both = keys.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), checked)))
    both = both.withColumn("time", F.when(F.col("nth") == 0, F.col("tick")).otherwise(F.col("first") + (F.col("low") + F.col("nth") - 1) * F.col("step")))
    both = both.withColumn("alpha", ratio(F.col("time") - F.col("tick"), F.col("after.tick") - F.col("tick")))

    def position(axis: str) -> Column:
        return F.when(F.col("nth") == 0, F.col(axis)).otherwise(F.col(axis) + F.col("alpha") * (F.col(f"after.{axis}") - F.col(axis)))

    return both.select(
        "trajectory_id",
        (F.col("upto") - F.col("inner") - 1 + F.col("nth")).cast("int").alias("sample_no"),
        seconds(F.col("time")).alias("timestamp"),
        *(position(a).alias(a.upper()) for a in "xyz"),
        *(F.col(f"v{a}").alias(f"V{a.upper()}") for a in "xyz"),
        "floor_id",
        "zone_id",
        "semantic_region",
    )


def evaluated(samples: DataFrame, positions: DataFrame, asset_sha256: str, tolerance_m: float = 1e-3) -> DataFrame:
    """samples with positions from an external evaluator, joined by sample number; the job fails where one is missing or
    further away than the tolerance."""
    p = positions.select("trajectory_id", "sample_no", F.struct("x", "y", "z").alias("p"))
    own = F.struct(F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z"))
    both = samples.join(p, ["trajectory_id", "sample_no"], "left")
    ok = F.coalesce(distance(own, F.col("p")) <= tolerance_m, F.lit(False))
    checked = both.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("evaluated position missing or too far away")).cast("boolean")))
    return checked.withColumns({a.upper(): F.col(f"p.{a}") for a in "xyz"}).drop("p").withColumn("sample_source", F.lit("BLENDER_EVALUATED")).withColumn("source_asset_sha256", F.lit(asset_sha256))


def frame_at(timestamp: Column, fps: Column) -> Column:
    """Frame number of a time from zero on; a number that an evaluator cannot hold fails."""
    frame = 1 + timestamp * fps
    return F.when((timestamp >= 0) & (frame <= LAST_FRAME), frame).otherwise(F.raise_error(F.lit("frame out of range")).cast("double"))


def expected_samples(keyframes: DataFrame) -> DataFrame:
    """trajectory_id, grid_samples: how many grid times each trajectory has, from its ends alone."""
    span = keyframe_ticks(keyframes).groupBy("trajectory_id", "sample_rate_hz", "per_second").agg(F.min("tick").alias("first"), F.max("tick").alias("last"))
    return span.select("trajectory_id", F.expr("(last - first) div (per_second div sample_rate_hz) + 1").alias("grid_samples"))
