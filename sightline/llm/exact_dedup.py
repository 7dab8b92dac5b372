"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by normalised content: Spark samples splitters over a bounded prefix of the text, its 64-bit
hash and a salt. Inside a partition the external sort goes by prefix, hash, salt, whole text and id, so equal texts lie
next to each other, and the window compares each whole text with its neighbour's. The row with the smallest id leads
its run.

A text with more than hot_rows copies gets a salt, so that its copies spread over many partitions; the leaders of its
runs, one a salt, are then grouped by whole text. Which texts are hot is found beforehand by counting hashes, which
Spark combines before the shuffle; at most rows / hot_rows hashes are hot, and hot_rows grows with the table, so that
the broadcast of hot hashes is bounded by HOT_HASHES rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, broadcast_if_small, written

HOT_HASHES = 100_000
PREFIX_CHARS = 32


def exact_duplicates(docs: DataFrame, hot_rows: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space. keep_id is the smallest id
    of the group; null ids sort last and lead only groups without any other id. Null and empty texts are one group,
    the text being empty. Of rows that share both text and smallest id one is kept. Other columns of docs are not
    read. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ").alias("norm"))
    base = base.withColumn("hash", F.xxhash64("norm"))
    hot_rows = max(hot_rows, docs.count() // HOT_HASHES)
    hot = written(base.groupBy("hash").agg(F.count("*").alias("copies")).where(F.col("copies") > hot_rows), "hot-texts")

    by = ["prefix", "hash", "salt"]
    run = Window.partitionBy(*by, "norm")
    runs = (
        base.join(F.broadcast(hot), "hash", "left")  # HOT_HASHES rows at most
        .withColumn("salt", F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / hot_rows))).otherwise(F.lit(0)))
        .withColumn("prefix", F.substring("norm", 1, PREFIX_CHARS))
        .repartitionByRange(*by)
        .withColumn("place", F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last())))
        .withColumn("run_keep", F.min("doc_id").over(run))
        .withColumn("run_size", F.count("*").over(run))
        .select(
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            "run_keep",
            "run_size",
            (F.col("place") == 1).alias("leads"),
            F.col("copies").isNotNull().alias("hot"),
            F.when(F.col("copies").isNotNull() & (F.col("place") == 1), F.col("norm")).alias("hot_text"),
        )
    )
    runs = written(runs, "content-sorted")
    merged = (
        runs.where(F.col("hot_text").isNotNull())
        .groupBy("hot_text")
        .agg(F.min("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
        .select(F.sha2("hot_text", 256).alias("text_sha256"), F.lit(True).alias("hot"), "all_keep", "all_size")
    )
    return runs.join(F.broadcast(merged), ["text_sha256", "hot"], "left").select(
        "doc_id",
        F.coalesce("all_keep", "run_keep").alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("leads") & F.coalesce("all_keep", "run_keep").eqNullSafe(F.col("run_keep"))).alias("kept"),
        "text_sha256",
    )
