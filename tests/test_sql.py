"""Every scene query that has SQL, against it."""

import pytest

from rows import spark_rows, sql_rows
from sightline.plans.contracts import SQL as CONTRACTS
from sightline.plans.queries import QUERIES
from sightline.plans.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"
#: Contracts are made over suppliers, of which the smallest tables have ten.
SF2 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    sf = SF2 if name in CONTRACTS else SF
    df = QUERIES[name](spark, sf)
    rows, columns = sql_rows(ORACLE_SQL[name], sf)
    assert sorted(df.columns) == columns
    assert spark_rows(df) == rows
