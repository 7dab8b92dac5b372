"""Extension point: path proposals of a caller's own generator, a partition of requests at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

#: From a request's row to (polyline as x, y, z triples, score) pairs.
Generator = Callable[[Row], Iterator[tuple[list[tuple[float, float, float]], float | None]]]


def register_propose_paths(spark: SparkSession, generator: Generator, name: str = "propose_paths") -> None:
    """Register name as a table function: SELECT * FROM propose_paths(TABLE(requests) PARTITION BY target_id).

    It gives request_id, proposal_no, polyline and score for every proposal of every request (a row with request_id).
    """

    @udtf(returnType="request_id string, proposal_no int, polyline array<struct<x:double,y:double,z:double>>, score double")
    class ProposePaths:
        def eval(self, request: Row):
            for no, (line, score) in enumerate(generator(request)):
                yield request["request_id"], no, [(float(x), float(y), float(z)) for x, y, z in line], score

    spark.udtf.register(name, ProposePaths)


def proposals(requests: DataFrame, generator: Generator, partition_by: str = "request_id") -> DataFrame:
    """The proposals of all requests, partition by partition."""
    spark = requests.sparkSession
    register_propose_paths(spark, generator, "sightline_propose_paths")
    return spark.sql(f"SELECT * FROM sightline_propose_paths(TABLE({{requests}}) PARTITION BY {partition_by})", requests=requests)
