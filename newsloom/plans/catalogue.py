"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import news, opinions, relational, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (news, opinions, relational, storage):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["quote_attribution"](spark, sf_dir)
