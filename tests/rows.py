"""Rows of a Spark query and of its SQL in DuckDB, in a form that can be compared."""

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "__float__") and not isinstance(value, (int, bool)):
        return round(float(value), 5)
    return value


def sorted_rows(rows, columns):
    order = sorted(columns)
    return sorted((tuple(plain(r[c]) for c in order) for r in rows), key=lambda t: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in t))


def spark_rows(df):
    return sorted_rows((r.asDict() for r in df.collect()), df.columns)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted_rows((dict(zip(columns, r)) for r in cursor.fetchall()), columns), sorted(columns)
