"""Sums and medians against fractions and statistics.median."""

import math
import random
import statistics
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from sightline.functions import exact
from sightline.plans import queries

SF = "/root/testdata/sf0.001"


def total(xs):
    return float(sum(map(Fraction, xs)))


def lists():
    rng = random.Random(2)
    yield from ([], [0.0], [-0.0, 0.0], [0.1] * 10, [1e308, 1e308, -1e308], [1.0, 1e100, 1.0, -1e100] * 50, [5e-324, 5e-324], [1e-310, 2.5, -2.5], [2.0**53, 1.0], [2.0**53, 1.0, 5e-324], [2.0**53, 3.0], [-(2.0**53), -1.0, -5e-324], [1e16, 1.0, 1e-16], [2.0**1023, -(2.0**970)], [4.0, -(2.0**-50), 2.0**-110])
    for _ in range(120):
        wide = rng.choice([1, 10, 300])
        xs = [rng.choice([1, -1]) * rng.random() * 10 ** rng.uniform(-wide, min(wide, 290)) for _ in range(rng.randint(1, 40))]
        yield xs
        yield [*xs, *(-x for x in xs[1:]), rng.random()]  # cancels but for two


def test_exact_sum_of_arrays(spark):
    cases = list(enumerate(lists()))
    got = dict(spark.createDataFrame(cases, "i int, xs array<double>").select("i", exact.exact_sum(F.col("xs"))).collect())
    for i, xs in cases:
        assert got[i] == total(xs), (xs, got[i])
    odd = spark.createDataFrame([(0, [1.0, math.inf]), (1, [math.inf, -math.inf]), (2, None), (3, [1.0, None])], "i int, xs array<double>").select("i", exact.exact_sum(F.col("xs")).alias("s")).collect()
    odd = dict(odd)
    assert odd[0] == math.inf and math.isnan(odd[1]) and odd[2] is None and odd[3] is None


def test_exact_sums_merge(spark):
    cases = list(enumerate(lists()))
    rows = [(i, x) for i, xs in cases for x in xs] + [(-1, None), (None, 0.1), (None, 0.2), (-2, math.inf), (-2, 1.0)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = dict(exact.exact_sums(df, ["k"], "v").collect())
    assert all(got[i] == total(xs) for i, xs in cases if xs)
    assert got[-1] is None and got[None] == total([0.1, 0.2]) and got[-2] == math.inf
    assert exact.exact_sums(df.limit(0), ["k"], "v").count() == 0


def test_running_sums(spark):
    """Limbs of parts, merged, are the limbs of the whole."""
    cases = [(i, xs[:3], xs[3:], xs) for i, xs in enumerate(lists())]
    df = spark.createDataFrame(cases, "i int, a array<double>, b array<double>, xs array<double>")
    both = exact.rounded(exact.merged(F.concat(exact.limbs_of(F.col("a")), exact.limbs_of(F.col("b")))))
    assert all(r["s"] == total(r["xs"]) for r in df.select("xs", both.alias("s")).collect())


def test_exact_medians(spark):
    rng = random.Random(4)
    groups = {k: [rng.choice([rng.uniform(-5, 5), rng.gauss(0, 1e-300), float(rng.randint(-3, 3)), 10 ** rng.uniform(-300, 300)]) for _ in range(n)] for k, n in enumerate((1, 2, 3, 50, 51, 400))}
    groups |= {6: [1.5 + i * 2.0**-50 for i in range(101)], 7: [0.0, -0.0], 8: [-1.0] * 9 + [1.0] * 9, None: [3.0, 1.0], 9: [5e-324, 1e-323, -5e-324]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [(3, None), (10, None)]
    rng.shuffle(rows)
    got = dict(exact.exact_medians(spark.createDataFrame(rows, "k int, v double").repartition(5), ["k"], "v").collect())
    assert got == {k: statistics.median(xs) for k, xs in groups.items()}
    df = spark.createDataFrame([(x,) for x in sorted({y for xs in groups.values() for y in xs})], "x double")
    keys = [r[0] for r in df.orderBy("x").select(exact.in_order(F.col("x"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) >= len(keys) - 1  # 0 and -0 are one


def test_exact_totals_query(spark):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_orderkey", F.col("l_extendedprice").cast("double").alias("p"), F.col("l_discount").cast("double").alias("d")).collect():
        want[r["l_suppkey"]] += [r["p"] * r["d"], 2.0 ** (40 + r["l_orderkey"] % 20), -(2.0 ** (40 + r["l_orderkey"] % 20))]
    got = {r["l_suppkey"]: r["total"] for r in queries.exact_totals(spark, SF).collect()}
    assert got == {k: total(xs) for k, xs in want.items()}
