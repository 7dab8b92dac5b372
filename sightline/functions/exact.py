"""Exactly rounded sums and exact order statistics of doubles, in built-in functions that merge before a shuffle.

A double is a whole number of 53 bits times a power of two. It is laid on a number line of limbs, 32 bits each: as a
decimal number of units of 2^(32 k) for its limb k. Limbs are whole numbers, so they are added in any order without
rounding; a sum of doubles is a few limbs, whatever it is a sum of. Carrying from the lowest limb to the highest leaves
balanced digits, of which the highest three and the sign of the rest decide how the sum is rounded, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import materialised
from .columns import ulp

BITS = 32
WHOLE = "decimal(38,0)"
#: Limbs above a sum's largest that carries can reach.
CARRIED = 4
#: A sum's limbs: k and the units of 2^(32 k), one element a limb.
LIMBS = f"array<struct<k:int,d:{WHOLE}>>"
#: Bits that each pass of exact_medians looks at, from a double's 64 in order.
PASSES = (40, 20, 0)


def let(x: Column, f) -> Column:
    """f of x, with x worked out, and written into the plan, once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def limb(x: Column) -> Column:
    """A finite double as (k, d): d units of 2^(32 k), exactly."""

    def laid(u: Column) -> Column:
        p = F.round(F.log2(u)).cast("int")
        k = F.floor(p / BITS).cast("int")
        return F.struct(k.alias("k"), ((x / u).cast("long").cast(WHOLE) * F.pow(F.lit(2.0), p - BITS * k).cast("decimal(10,0)")).cast(WHOLE).alias("d"))

    return let(ulp(x), laid)


def merged(limbs: Column) -> Column:
    """Limbs in order, one of each k, from an array in which a k may repeat."""

    def by_key(limbs: Column) -> Column:
        of = lambda k: F.aggregate(F.filter(limbs, lambda x: x["k"] == k), F.lit(0).cast(WHOLE), lambda s, x: (s + x["d"]).cast(WHOLE))
        return F.transform(F.array_sort(F.array_distinct(F.transform(limbs, lambda x: x["k"]))), lambda k: F.struct(k.alias("k"), of(k).alias("d")))

    return let(limbs, by_key).cast(LIMBS)


def limbs_of(array: Column) -> Column:
    """The limbs of the sum of an array of finite doubles."""
    return merged(F.transform(array, limb))


def rounded(limbs: Column) -> Column:
    """The double nearest to a sum's limbs, ties to even; 0 of no limbs, null of null."""
    one = F.lit(1 << BITS).cast(WHOLE)
    nothing = F.struct(F.lit(0).cast(WHOLE).alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def carried(limbs: Column) -> Column:
        keys = F.transform(limbs, lambda x: x["k"])

        def step(state: Column, k: Column) -> Column:
            def split(here: Column) -> Column:
                left = (here % one).cast("long")
                digit = F.when(left >= 1 << (BITS - 1), left - (1 << BITS)).when(left < -(1 << (BITS - 1)), left + (1 << BITS)).otherwise(left)
                return F.struct(((here - digit.cast(WHOLE)) / one).cast(WHOLE).alias("carry"), F.concat(state["digits"], F.array(digit)).alias("digits"))

            return let(F.aggregate(F.filter(limbs, lambda x: x["k"] == k), state["carry"], lambda s, x: (s + x["d"]).cast(WHOLE)), split)

        digits = F.aggregate(F.sequence(F.array_min(keys), F.array_max(keys) + CARRIED), nothing, step, lambda s: s["digits"])
        return F.struct(F.array_min(keys).alias("low"), digits.alias("digits"))

    def value(c: Column) -> Column:
        def headed(top: Column) -> Column:
            at = lambda i: F.coalesce(F.get(c["digits"], top - i), F.lit(0)).cast(WHOLE)
            head = ((at(0) * one + at(1)).cast(WHOLE) * one + at(2)).cast(WHOLE)
            rest = F.aggregate(F.slice(c["digits"], F.lit(1), F.greatest(top - 2, F.lit(0))), F.lit(0), lambda s, d: F.when(d != 0, F.signum(d).cast("int")).otherwise(s))
            # one bit more tells a tie from what is beside it; two factors, as one may be out of range
            scale = BITS * (c["low"] + top - 2) - 1
            half = F.floor(scale / 2)
            return (2 * head + rest.cast(WHOLE)).cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), scale - half)

        return let(F.array_max(F.transform(c["digits"], lambda d, i: F.when(d != 0, i))), lambda top: F.when(top.isNull(), F.lit(0.0)).otherwise(headed(top)))

    return let(limbs, lambda x: F.when(F.size(x) == 0, F.lit(0.0)).when(x.isNotNull(), let(carried(x), value)))


def exact_sum(array: Column) -> Column:
    """The correctly rounded sum of an array of doubles, in whatever order they stand; 0 for none, null for a null array
    or element. Where one is not finite, the plain sum."""
    whole = F.forall(array, lambda x: F.abs(x) < float("inf"))
    return F.when(whole, rounded(limbs_of(array))).when(~whole, F.aggregate(array, F.lit(0.0), lambda s, x: s + x))


def exact_sums(df: DataFrame, keys: list[str], value: str, name: str = "total") -> DataFrame:
    """keys, name: the correctly rounded sum of value for each distinct keys. Null values are passed over; a group with no
    value has null, and one with a value that is not finite its plain sum.

    Values are added limb by limb before the shuffle; a group comes together as its limbs, 70 at most.
    """
    x = F.col(value).cast("double")
    sound = F.abs(x) < float("inf")
    by = [f"__{i}" for i in range(len(keys))]
    laid = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(b) for k, b in zip(keys, by)), F.when(sound, limb(x)).alias("l"), F.when(~sound, x).alias("odd"))
    parts = laid.groupBy(*by, F.col("l.k").alias("k")).agg(F.sum("l.d").cast(WHOLE).alias("d"), F.sum("odd").alias("odd"))
    found = parts.groupBy(*by).agg(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "d"))).alias("limbs"), F.sum("odd").alias("odd"))
    found = found.select(*by, F.coalesce("odd", rounded(F.col("limbs").cast(LIMBS))).alias("__total"))
    same = F.lit(True)
    for k, b in zip(keys, by):
        same = same & F.col(k).eqNullSafe(F.col(b))
    return df.select(*keys).distinct().join(found, same, "left").select(*keys, F.col("__total").alias(name))


def ratio(p: Column, q: Column) -> Column:
    """p / q of longs, q positive, as the double nearest to it. Up to 2^53 the quotient of doubles is that; beyond, 36 digits
    and a last one for what remains are read as a number."""
    ten = F.lit(10**18).cast(WHOLE)

    def long_division(x: Column) -> Column:
        u, by = F.abs(x["p"].cast(WHOLE)), x["q"].cast(WHOLE)
        div = lambda a: F.call_function("div", a, by).cast("string")
        more = lambda a: ((a % by).cast(WHOLE) * ten).cast(WHOLE)
        written = lambda a, b: F.concat(F.when(x["p"] < 0, "-").otherwise(""), div(u), F.lit("."), F.lpad(div(a), 18, "0"), F.lpad(div(b), 18, "0"), F.when(b % by == 0, "0").otherwise("1"))
        return let(more(u), lambda a: let(more(a), lambda b: written(a, b))).cast("double")

    small = p.between(-(2**53), 2**53) & (q <= 2**53)
    return F.when(small, p.cast("double") / q.cast("double")).otherwise(let(F.struct(p.alias("p"), q.alias("q")), long_division))


def in_order(x: Column) -> Column:
    """A finite double as a long that is ordered as it is; -0 and 0 are one."""
    whole = lambda u: (F.abs(x) / u).cast("long") + (F.round(F.log2(u)).cast("long") + 1074) * (1 << 52)
    bits = F.when(F.abs(x) < 2.0**-1022, (F.abs(x) / F.lit(2.0**-1074)).cast("long")).otherwise(let(ulp(x), whole))
    return F.when(x < 0, -bits).otherwise(bits)


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, name: the median of value for each distinct keys, the mean of the middle two where their number is even.

    Null values are passed over; values must be finite. The ranks of the middle values are narrowed in three passes: each
    counts the values by the next bits of their order, which Spark adds up before the shuffle, and goes on with what
    falls where the rank is. No group's values come together; a pass has 2^24 counts a group at most.
    """
    ordered = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("x"))
    ordered = materialised(ordered.withColumn("bits", in_order(F.col("x"))), "values-in-order")  # read in every pass
    by = [f"k{i}" for i in range(len(keys))]
    ranks = ordered.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank")))).alias("r")).select(*by, "r.*", F.lit(None).cast("long").alias("prefix"))
    above = 64
    for shift in PASSES:
        same = F.lit(True)
        for k in by:
            same = same & ordered[k].eqNullSafe(F.col(f"r_{k}"))
        target = ranks.withColumnsRenamed({k: f"r_{k}" for k in by})
        inside = same if above == 64 else same & (F.shiftright("bits", above) == F.col("prefix"))
        counts = ordered.join(target, inside).groupBy(*by, "which", "rank", F.shiftright("bits", shift).alias("prefix")).agg(F.count("*").alias("n"), F.min("x").alias("least"))
        so_far = F.sum("n").over(Window.partitionBy(*by, "which").orderBy("prefix"))
        ranks = counts.withColumn("upto", so_far).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        ranks = ranks.select(*by, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "prefix", "least")
        if shift:
            ranks = ranks.drop("least")
        above = shift
    middle = ranks.groupBy(*by).agg(((F.min("least") + F.max("least")) / 2).alias(name))
    return middle.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})
