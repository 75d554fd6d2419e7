"""Access to the driver's tables, and the shape every query module exports."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "pages", "conversations",
]


class Query(NamedTuple):
    """A DataFrame builder and the SQL that must give the same rows, where SQL can."""

    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in names]
