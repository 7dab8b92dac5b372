"""What the operators share: table access and tables written to the cluster's shared folder.

Columns that an operator adds to a caller's table for a while begin with __sightline_, so that no other name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, materialised

__all__ = ["PLAIN_READS", "SPACE", "WORD", "broadcast_if_small", "discard", "table", "written"]

#: ASCII white space; every word and normalisation rule of the operators uses this class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Vectored reads ask for a whole column chunk at once; plain ones are to need less memory outside the heap.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**PLAIN_READS).parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back."""
    return materialised(df, label, PLAIN_READS)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast df where its counted rows are within limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df
