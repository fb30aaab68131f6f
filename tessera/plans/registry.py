"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import citing, ingesting, library, register, retrieval


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prepare_context(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(register.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(register.SQL)


_ = (citing, ingesting, library)
