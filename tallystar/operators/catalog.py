"""Table catalogue: descriptions and samples of an allow-listed set of tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DICTIONARY = "table string, column string, type string, description string"


def _known(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise ValueError(f"Invalid table name: {name}. Valid tables: {', '.join(tables)}")
    return tables[name]


def table_list(tables: Mapping[str, DataFrame]) -> list[str]:
    return list(tables)


def data_dictionary(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column with its type and the comment kept in the schema."""
    rows = [
        (name, f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment"))
        for name, df in tables.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, _DICTIONARY)


def describe_table(tables: Mapping[str, DataFrame], name: str) -> str:
    """Readable description of one table."""
    lines = [
        f"- {f.name} ({f.dataType.simpleString()})" + (f": {c}" if (c := (f.metadata or {}).get("comment")) else "")
        for f in _known(tables, name).schema.fields
    ]
    return "\n".join([f"Table: {name}", "", "Columns:", *lines])


def describe_all(tables: Mapping[str, DataFrame]) -> str:
    return "\n\n".join(describe_table(tables, name) for name in tables)


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table, from file footers where the source allows it."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def sample_rows(tables: Mapping[str, DataFrame], name: str, order_by: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by key, so that a sample is the same every time."""
    return _known(tables, name).orderBy(order_by).limit(n)
