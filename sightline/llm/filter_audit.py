"""Filter interaction audit: every order in which filters can be applied, replayed on the documents' flags.

Each document has one flag a filter: whether it fails. Flags are crossed with all orders of the filters, a broadcast
table of n! rows (120 for five filters). In each order the document's first failure is the step that removes it; the
steps are then exploded and counted under conditions, one row a part, order and step, which Spark combines before the
shuffle. Texts are read once, for the flags; what is crossed is a row of a few bytes a document.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

LETTERS = "ABCDE"
#: Documents that one task crosses with all orders, and the most tasks.
TASK_ROWS = 20_000
MOST_TASKS = 100_000
#: Rows without id are spread over so many keys where they meet a table by id.
SPREAD = 1_000


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text alone. Every comparison is of whole numbers."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, part, A, B, C, D, E (whether the document fails), good, toxic.

    A: under 100 words; B: under 80 % of its words distinct; C: over 10 % of its code points are A to Z; D: holds one
    of # $ % & * |; E: identical to the text of a row with a smaller doc_id, wherever that row stands. Texts are
    identical when their SHA-256 digests are. Null text counts as empty, and an empty text fails A and, as a copy, E.
    A row without doc_id has no smaller one and passes E. part is part_col, null being the empty string. good and
    toxic are true where a row of labels with that doc_id has quality or toxic 1; rows of labels may repeat. An empty
    table gives an empty result; other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    failures = text_failures(text)
    base = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(part_col), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            *(c.alias(k) for k, c in failures.items()),
        ),
        "filter-flags",
    )
    # the smallest id of each text meets its own row by id and text, so that no group of copies is one key
    first = base.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("leads", F.lit(True))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.lit(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    return (
        base.join(first, ["digest", "doc_id"], "left")
        .withColumn("E", F.col("doc_id").isNotNull() & F.col("leads").isNull())
        .withColumn("spread", spread.cast("long"))
        .join(marks, ["doc_id", "spread"], "left")
        .select("doc_id", "part", *failures, "E", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )


def filter_orders(spark, letters: str) -> DataFrame:
    """filter_order, bits: every order of the filters, and the bit of the filter at each step."""
    rows = [("".join(p), [1 << letters.index(x) for x in p]) for p in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def filter_interactions(flags: DataFrame, n_rows: int, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    flags has part, good, toxic and a boolean column for each letter, null counting as passed; n_rows is about how
    many rows it has, to deal them out. One row per part that has a document, order of all letters and step, from 1;
    the filter at a step is that letter. kept: documents that no step so far removed; removed: those that this one
    does; redundant: those that fail its filter and were removed before; unique_fails: those that fail its filter
    alone; good_lost and toxic_lost: the removed that are good or toxic; shapley: what the filter removes, summed over
    all orders. Flags without rows give no rows.
    """
    n = len(letters)
    mask = sum((F.when(F.col(x), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(letters)), F.lit(0))
    bit = lambda k: F.get("bits", F.lit(k))
    first = F.lit(n + 1)
    for k in reversed(range(n)):
        first = F.when(F.col("fails").bitwiseAND(bit(k)) != 0, F.lit(k + 1)).otherwise(first)
    crossed = (
        flags.select("part", mask.alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .repartition(max(1, min(n_rows // TASK_ROWS + 1, MOST_TASKS)))
        .crossJoin(F.broadcast(filter_orders(flags.sparkSession, letters)))  # n! rows, whatever the documents are
        .withColumn("first", first)
    )
    steps = crossed.withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(1, n + 1))))).withColumn("bit", F.get("bits", F.col("step") - 1))
    here, before, fails = F.col("first") == F.col("step"), F.col("first") < F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    counted = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(fails & before).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    named = counted.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
