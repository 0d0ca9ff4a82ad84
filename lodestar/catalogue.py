"""Every query of the library outside the llm subpackage, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import fixtures, queries_graph, queries_rest

QUERIES = {**queries_graph.QUERIES, **queries_rest.QUERIES, **fixtures.QUERIES}
ORACLE_SQL = {**queries_graph.ORACLE_SQL, **queries_rest.ORACLE_SQL, **fixtures.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["impact_ranked"](spark, sf_dir)
