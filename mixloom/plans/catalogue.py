"""All registered queries of the core, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixloom.plans import queries_data, queries_more, queries_text


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return queries()["conv_turn_stats"](spark, sf)


def queries() -> dict:
    return queries_text.QUERIES | queries_data.QUERIES | queries_more.QUERIES


def oracle_sql() -> dict[str, str]:
    return queries_text.SQL | queries_data.SQL | queries_more.SQL
