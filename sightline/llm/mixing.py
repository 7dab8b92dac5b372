"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents are packed into one stream of words, cut into blocks of BLOCK_WORDS words. The mix is a
sequence of slots in output shards of SHARD_SLOTS slots. Each shard draws how many of its slots every source fills: the
whole part of the expected count, and a multinomial draw for what remains. A source's slots are numbered over all
shards; slot j takes block permutation(j mod blocks) of pass j div blocks, where each source and pass has its own
pseudorandom permutation. Blocks and slots meet in a join on source and block index.

Only ids, sources and sizes are shuffled; the per-source totals (one row a source) are all that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, written

BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
CHUNK_ROWS = 4_096
#: Tasks that permute slots, for each shard's worth of words.
SLOT_TASKS = 2
ROUNDS = 24
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source, in the order of sizes: share of all words by weight, at most `most` times a
    source's words; what exceeds that goes to the others by weight until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    targets, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        level = rest / sum(w[i] for i in open_)
        full = {i for i in open_ if level * w[i] > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = level * w[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
        rest -= sum(most * sizes[i] for i in full)
        open_ -= full
    return targets


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, chosen by key: ROUNDS rounds of swap-or-not."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x + n, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, partner)) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def shard_counts(spark, expected: list[float], seed: int) -> DataFrame:
    """shard, source_no, n: how many slots of each shard a source fills. expected: blocks to take of each source."""
    total = max(0, round(sum(expected)))
    shards, last = max(1, math.ceil(total / SHARD_SLOTS)), total - (max(1, math.ceil(total / SHARD_SLOTS)) - 1) * SHARD_SLOTS
    p = [e / sum(expected) if total else 0.0 for e in expected]

    def drawn(ids: DataFrame, slots: int) -> DataFrame:
        whole = [math.floor(slots * x) for x in p]
        rest = [slots * x - n for x, n in zip(p, whole)]
        draws = slots - sum(whole)
        fixed = ids.select("shard", F.posexplode(F.array(*(F.lit(n).cast("long") for n in whole))).alias("source_no", "n"))
        if draws <= 0:
            return fixed
        steps, so_far = [], 0.0
        for x in rest[:-1]:
            so_far += x / sum(rest)
            steps.append(F.lit(so_far))
        draw = ids.select("shard", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        picked = F.size(F.filter(F.array(*steps), lambda s: s <= uniform(F.lit(seed), F.col("shard"), F.col("draw")))) if steps else F.lit(0)
        return fixed.unionAll(draw.select("shard", picked.alias("source_no"), F.lit(1).cast("long").alias("n")))

    full = drawn(spark.range(shards - 1).select(F.col("id").alias("shard")), SHARD_SLOTS)
    return full.unionAll(drawn(spark.range(shards - 1, shards).select(F.col("id").alias("shard")), last)).groupBy("shard", "source_no").agg(F.sum("n").alias("n")).where("n > 0")


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, slots) of the mix.

    documents has one row per row of docs: doc_id, text_hash, place (number among rows equal in both), size, source,
    source_size, target, taken, and parts: array of (first word, words, times). slots has shard, slot (number within
    its source), source_no, pass and block. A word is a run of anything but ASCII white space; null text has none and
    nothing is taken of it. Sources weigh by their place in code point order, null being one source, the last.
    No part is taken more than twice. Repeated rows are documents of their own. An empty table gives empty results.
    """
    spark = docs.sparkSession
    sizes = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # one row a source
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = source_targets([r["size"] for r in totals])
    blocks = [-(-r["size"] // BLOCK_WORDS) for r in totals]
    plan = F.broadcast(
        spark.createDataFrame(
            [(i, r["source"], r["size"], t, b) for i, (r, t, b) in enumerate(zip(totals, targets, blocks))],
            "source_no int, plan_source string, source_size long, target double, blocks long",
        )
    )
    sized = sizes.join(plan, sizes["source"].eqNullSafe(F.col("plan_source"))).drop("plan_source")

    # place of each document in its source's stream: sums of chunks first, then within a chunk
    chunks = max(1, -(-sum(r["rows"] for r in totals) // CHUNK_ROWS))
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)))
    in_source = Window.partitionBy("source_no").orderBy("chunk")
    starts = sized.groupBy("source_no", "chunk").agg(F.sum("size").alias("words")).select("source_no", "chunk", (F.sum("words").over(in_source) - F.col("words")).alias("chunk_start"))
    order = ["doc_id", "text_hash", "size"]
    in_chunk = Window.partitionBy("source_no", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    packed = (
        sized.withColumn("offset", F.sum("size").over(in_chunk) - F.col("size"))
        .withColumn("place", F.row_number().over(Window.partitionBy("source_no", "chunk", "doc_id", "text_hash").orderBy("offset", "size")))
        .join(starts, ["source_no", "chunk"])
        .withColumn("offset", F.col("offset") + F.col("chunk_start"))
    )
    b = F.lit(BLOCK_WORDS).cast("long")
    end = F.col("offset") + F.col("size")
    pieces = packed.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"offset div {BLOCK_WORDS}"), F.expr(f"(offset + size - 1) div {BLOCK_WORDS}")))).alias("block"))
    first = F.greatest("offset", F.col("block") * b)
    pieces = pieces.withColumn("first_word", first - F.col("offset")).withColumn("words", F.least(end, (F.col("block") + 1) * b) - first)

    counts = shard_counts(spark, [t * n / r["size"] if r["size"] else 0.0 for t, n, r in zip(targets, blocks, totals)], seed)
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("n")
    slots = (
        counts.withColumn("before", before)
        .repartition(min(max(1, -(-sum(r["size"] for r in totals) // (BLOCK_WORDS * SHARD_SLOTS))) * SLOT_TASKS, 100_000), "source_no", "shard")  # else few tasks permute all slots
        .select("shard", "source_no", F.explode(F.expr("sequence(before, before + n - 1)")).alias("slot"))
        .join(plan.select("source_no", "blocks"), "source_no")
        .withColumn("pass", F.expr("slot div blocks"))
        .where(F.col("pass") < int(MOST))  # a draw above what two passes hold stays empty
        .withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("pass")))
        .select("shard", "slot", "source_no", "pass", "block")
    )
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    row = ["doc_id", "text_hash", "place", "size", "source_no", "offset"]
    documents = (
        pieces.join(times, ["source_no", "block"], "left")
        .groupBy(*row)
        .agg(
            F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).alias("taken"),
            F.array_sort(F.collect_list(F.when(F.col("times") > 0, F.struct("first_word", "words", "times")))).alias("parts"),
        )
        .join(plan, "source_no")
        .select("doc_id", "text_hash", "place", "size", F.col("plan_source").alias("source"), "source_size", "target", "taken", "parts")
    )
    return documents, slots


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of which the mix takes words, with docs' columns; text is what is taken.

    A document taken whole once keeps its text as it is. Otherwise text is the taken words, one space apart, first
    those of all parts, then on a new line those of parts taken a second time. n_chars, where docs has it, is the new
    text's length. Null and empty texts have no words and go. An empty table stays empty.
    """
    documents, _ = mix(docs, seed)
    keep = documents.where("taken > 0").select(F.col("doc_id").alias("__sightline_id"), F.col("text_hash").alias("__sightline_hash"), F.col("place").alias("__sightline_place"), F.col("source").alias("__sightline_source"), F.col("size").alias("__sightline_size"), F.col("taken").alias("__sightline_taken"), F.col("parts").alias("__sightline_parts"))
    rows = docs.withColumn("__sightline_own_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("__sightline_own_place", F.row_number().over(Window.partitionBy("doc_id", "__sightline_own_hash", "source").orderBy(F.lit(0))))
    # the place is compared beside the key, so that the window's partitioning serves the join too
    joined = rows.join(keep, rows["doc_id"].eqNullSafe(keep["__sightline_id"]) & (F.col("__sightline_own_hash") == F.col("__sightline_hash")) & (F.col("__sightline_own_place") - F.col("__sightline_place") == 0) & rows["source"].eqNullSafe(keep["__sightline_source"]))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def part(least: int) -> Column:
        wanted = F.filter("__sightline_parts", lambda p: p["times"] >= least)
        return F.array_join(F.flatten(F.transform(wanted, lambda p: F.slice(F.col("__sightline_words"), (p["first_word"] + 1).cast("int"), p["words"].cast("int")))), " ")

    once = F.aggregate("__sightline_parts", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    whole = once == F.col("__sightline_size")
    text = F.concat_ws("\n", F.when(whole, F.col("text")).otherwise(part(1)), F.when(F.col("__sightline_taken") > once, F.when(F.col("__sightline_taken") == 2 * F.col("__sightline_size"), F.col("text")).otherwise(part(2))))
    joined = joined.withColumn("__sightline_words", words).withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
