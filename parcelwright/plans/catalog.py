"""The registered queries of the core and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelwright.plans import land, matched, measures, placed, relational, shaped


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**land.QUERIES, **relational.QUERIES, **shaped.QUERIES, **matched.QUERIES, **measures.QUERIES, **placed.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**land.ORACLE, **relational.ORACLE, **shaped.ORACLE, **matched.ORACLE, **measures.ORACLE, **placed.ORACLE}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return relational.village_candidates(spark, folder)
