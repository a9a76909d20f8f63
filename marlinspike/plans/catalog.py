"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlinspike.plans import matching, problems, quality, rules, scalars, storage, streams

_PARTS = [problems, rules, scalars, storage, quality, matching, streams]


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flagship(spark, sf_dir)
