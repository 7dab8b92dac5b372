"""Arrow helpers for what has no builtin: hexadecimal doubles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def float_hex(x: pd.Series) -> pd.Series:
    """Exact text form of a double."""
    return x.map(lambda v: None if v is None or pd.isna(v) else float(v).hex())


@F.pandas_udf(T.ArrayType(T.StringType()))
def hex_list(x: pd.Series) -> pd.Series:
    """Exact text forms of an array of doubles."""
    return x.map(lambda v: None if v is None else [float(y).hex() for y in v])


def canonical_id(prefix: str, *parts: Column) -> Column:
    """prefix and the sha256 of the parts as a compact JSON array of strings; null stays null."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts)), {"ignoreNullFields": "false"}), 256))
