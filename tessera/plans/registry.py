"""Names of queries, bound to functions of (spark, folder) and to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.graphview import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Spark 4.1 takes a union of sides dealt by one key as dealt by it, even after adaptive execution has read a
            # side's shuffle locally for a broadcast join: joins above it then miss rows, or its sides cannot be zipped
            spark.conf.set("spark.sql.unionOutputPartitioning", "false")
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
