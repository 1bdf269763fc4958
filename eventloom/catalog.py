"""All queries of the engine by name, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.plans import behaviour, insights, operations, streams  # noqa: F401  they fill the registry
from eventloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["funnel_ordered"](spark, sf_dir)
