"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is the hash of the words of a window at the positions that a fixed mask looks at; words under its zeros may
differ. Wherever as many words of a window differ as the rule below lets differ, one of its masks looks at none of
them. Seeds of the benchmark's items and of all documents meet in a join. A hit fixes how document and item lie
against each other; along that line the words are compared one by one, and the document is contaminated where some
window of SPAN words agrees in at least AGREE of them.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

SPAN = 13
#: Words that must agree, as a part of the window.
AGREE = 0.75
#: Items with fewer words give no evidence and are passed over.
LEAST_WORDS = 8
BROADCAST_SEEDS = 500_000
BROADCAST_DOCS = 1_000_000
#: All of ASCII but letters and digits parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def masks(span: int) -> tuple[str, ...]:
    """Masks for windows of span words, of which one looks at no word that differs wherever AGREE lets words differ.

    The window is cut into two blocks more than words may differ, so two blocks at least agree whole; each pair of
    blocks has a mask.
    """
    n = span - math.ceil(span * AGREE) + 2
    block = [i * n // span for i in range(span)]
    return tuple("".join("01"[b in pair] for b in block) for pair in combinations(range(n), 2))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def seeds(df: DataFrame, family: tuple[str, ...], keep: str) -> DataFrame:
    """keep, pos, seed for every window of df's column hashes and every mask of family; all masks have one length."""
    span = len(family[0])
    used = sorted({i for m in family for i, on in enumerate(m) if on == "1"})
    windows = F.size("hashes") - span + 1
    shifted = [F.slice("hashes", F.lit(i + 1), windows).alias(f"w{i}") for i in used]
    placed = df.where(F.size("hashes") >= span).select(keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    hashes = [F.xxhash64(F.lit(m), *(F.col(f"w.w{i}") for i, on in enumerate(m) if on == "1")) for m in family]
    return placed.select(keep, "pos", F.explode(F.array(*hashes)).alias("seed"))


def hashed(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, overlap, n_agree for each contaminated pair of a document and an item.

    overlap is how many words of the item lie against the document on the best line, n_agree how many of them agree.
    Texts are compared as lower-case words of letters and digits; null texts have none. An item of LEAST_WORDS to SPAN
    words must agree within one window of its own length. Rows of one doc_id count as one document, rows of one
    item_id as one item. Rows without id are passed over.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    items = written(benchmark.select("item_id", words(F.col("text")).alias("item_words")).where(F.col("item_id").isNotNull() & (F.size("item_words") >= LEAST_WORDS)).distinct(), "benchmark-items")
    item_hashes = items.select("item_id", F.transform("item_words", lambda w: F.xxhash64(w)).alias("hashes"))
    short = sorted(r[0] for r in items.where(F.size("item_words") < SPAN).select(F.size("item_words")).distinct().collect())  # five lengths at most
    doc_hashes = hashed(docs, "doc_id")

    def hits(family: tuple[str, ...], of_items: DataFrame) -> DataFrame:
        wanted = written(seeds(of_items, family, "item_id").withColumnRenamed("pos", "item_pos").distinct(), "benchmark-seeds")
        found = seeds(doc_hashes, family, "doc_id").join(broadcast_if_small(wanted, wanted.count(), BROADCAST_SEEDS), "seed")
        return found.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("line"))

    lines = hits(masks(SPAN), item_hashes)
    for n in short:
        lines = lines.unionAll(hits(masks(n), item_hashes.where(F.size("hashes") == n)))
    lines = written(lines.distinct(), "seed-hits")

    with_text = docs.join(broadcast_if_small(lines, lines.count(), BROADCAST_DOCS), "doc_id").select("item_id", "doc_id", "line", words(F.col("text")).alias("doc_words"))
    pairs = with_text.join(broadcast_if_small(items, items.count(), BROADCAST_SEEDS // 10), "item_id")
    begin = F.greatest(F.lit(0), -F.col("line"))
    overlap = F.least(F.size("item_words"), F.size("doc_words") - F.col("line")) - begin
    window = F.least(F.lit(SPAN), F.size("item_words"))
    same = F.zip_with(F.slice("item_words", F.col("begin") + 1, F.col("overlap")), F.slice("doc_words", F.col("begin") + F.col("line") + 1, F.col("overlap")), lambda a, b: (a == b).cast("int"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("overlap") - F.col("window") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda s, x: s + x)))
    judged = (
        pairs.withColumn("begin", begin)
        .withColumn("overlap", overlap)
        .withColumn("window", window)
        .where(F.col("overlap") >= F.col("window"))
        .withColumn("same", same)
        .withColumn("best", best)
        .where(F.col("best") >= F.ceil(F.col("window") * AGREE))
        .withColumn("n_agree", F.aggregate("same", F.lit(0), lambda s, x: s + x))
    )
    return judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_agree", "overlap")).alias("m")).select("doc_id", "item_id", "m.overlap", "m.n_agree")


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, item_id (the one with most agreeing words; of ties the smallest), n_agree.

    Null and empty texts are in no item and hold none, and long ones are looked at whole. Rows of one doc_id have one
    result; rows without one are not contaminated. An empty table gives an empty result.
    """
    found = contaminated_documents(docs, benchmark)
    top = F.min(F.struct((-F.col("n_agree")).alias("less"), "item_id"))
    found = written(found.groupBy("doc_id").agg(F.count("*").alias("n_items"), top.alias("top")), "contaminated")
    return (
        docs.select("doc_id")
        .join(broadcast_if_small(found, found.count(), BROADCAST_DOCS), "doc_id", "left")
        .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "top.item_id", F.coalesce(-F.col("top.less"), F.lit(0)).cast("long").alias("n_agree"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id has no passage of an item; rows without id stay, null and empty texts too.
    An empty table stays empty."""
    found = written(contaminated_documents(docs, benchmark).select(F.col("doc_id").alias("__sightline_leak")).distinct(), "contaminated")
    return docs.join(broadcast_if_small(found, found.count(), BROADCAST_DOCS), docs["doc_id"] == F.col("__sightline_leak"), "left_anti")
