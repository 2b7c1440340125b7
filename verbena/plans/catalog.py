"""The library's queries by name, and DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbena.plans import catalogue_queries, core_queries, operator_queries, search_queries, state_queries, text_queries
from verbena.plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for _module in (core_queries, text_queries, catalogue_queries, state_queries, operator_queries, search_queries):
    QUERIES.update(_module.R.queries)
    ORACLE.update(_module.R.oracle)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.ingest_outcomes(spark, sf_dir)
