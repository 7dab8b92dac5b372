"""Sampled times, positions and velocities against fractions."""

import random
from bisect import bisect_right
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sightline.functions.exact import ratio
from sightline.operators import trajectory

KEYS = "trajectory_id string, sample_rate_hz int, timestamp decimal(38,18), x double, y double, z double, floor_id string, zone_id string, semantic_region string"


def rows_of(name, rate, times, rng):
    return [(name, rate, Decimal(t), *(rng.uniform(-50, 50) for _ in "xyz"), f"F{i}", None, "room") for i, t in enumerate(times)]


def by_fractions(keys):
    rate, times = keys[0][1], [Fraction(k[2]) for k in keys]
    first, last = times[0], times[-1]
    for no, t in enumerate(sorted({first + Fraction(i, rate) for i in range(int((last - first) * rate) + 1)} | set(times))):
        at = bisect_right(times, t) - 1
        here = min(at, len(times) - 2)
        a, b, width = keys[here], keys[here + 1], times[here + 1] - times[here]
        alpha = float((t - times[here]) / width)
        place = keys[at][3:6] if t == times[at] else [p + alpha * (q - p) for p, q in zip(a[3:6], b[3:6])]
        yield (keys[0][0], no, float(t), *place, *((q - p) / float(width) for p, q in zip(a[3:6], b[3:6])), keys[at][6])


def test_samples_are_those_of_fractions(spark):
    rng = random.Random(3)
    keys = [
        rows_of("six", 10, ["0", "0.7", "1.400001"], rng),
        rows_of("seven", 7, ["0.0000001", "1.1234567", "3"], rng),
        rows_of("twelve", 3, ["1.000000000001", "1.5", "2.333333333333"], rng),
        rows_of("eighteen", 2, ["0.000000000000000001", "0.5", "2.100000000000000007"], rng),
        rows_of("late", 30, ["1700000000.1234567", "1700000000.2", "1700000001.7654321"], rng),
        rows_of("before", 4, ["-2.00000001", "-0.3", "0.25"], rng),
    ]
    df = spark.createDataFrame([r for k in keys for r in k], KEYS)
    columns = ["trajectory_id", "sample_no", "timestamp", "X", "Y", "Z", "VX", "VY", "VZ", "floor_id"]
    got = sorted(tuple(r) for r in trajectory.sample_trajectories(df).select(columns).collect())
    assert got == sorted(r for k in keys for r in by_fractions(k))
    counted = {r["trajectory_id"]: r["grid_samples"] for r in trajectory.expected_samples(df).collect()}
    assert counted == {k[0][0]: int((Fraction(k[-1][2]) - Fraction(k[0][2])) * k[0][1]) + 1 for k in keys}


def test_ratio_is_rounded_once(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(-(10**d), 10**d), rng.randrange(1, 10**e)) for d in (3, 17, 18) for e in (2, 17, 18) for _ in range(200)]
    pairs += [(2**53 + 1, 2), (2**54 + 2, 4), (2**60 + 128, 1), (2**60 + 129, 1), (0, 10**18), (-(2**63) + 1, 3)]
    df = spark.createDataFrame(pairs, "p long, q long")
    assert [r[0] for r in df.select(ratio(F.col("p"), F.col("q"))).collect()] == [float(Fraction(p, q)) for p, q in pairs]


def test_times_out_of_range_fail(spark):
    rng = random.Random(1)
    far = spark.createDataFrame(rows_of("far", 10, ["0.000000000000000001", "1000"], rng), KEYS)
    with pytest.raises(Exception, match="too many ticks"):
        trajectory.sample_trajectories(far).collect()
