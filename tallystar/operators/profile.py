"""Column statistics of a result, exact at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallystar.functions.numeric import tolerant_number
from tallystar.session import scratch_path

# --- fixed values: sizes of result previews ---

PROFILE_ABOVE_ROWS = 1000
PREVIEW_ROWS = 10
PROFILED_COLUMNS = 5

# --- end of fixed values ---

def numeric_columns(df: DataFrame, limit: int = PROFILED_COLUMNS) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)][:limit]


def _middle_ranks(n: int) -> tuple[int, int]:
    return (n + 1) // 2, n // 2 + 1


def exact_medians(df: DataFrame, columns: Sequence[str], counts: dict[str, int]) -> dict[str, float | None]:
    """Exact medians in two jobs at any size and for any values; NaN counts as the largest value.

    Rows are first reduced to distinct values with their counts, all columns at once. These are cut into ranges
    by value; totals per range say which range holds a middle rank, and only inside it the running count is taken.
    """
    wanted = [c for c in columns if counts[c]]
    if not wanted:
        return dict.fromkeys(columns)
    entry = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in wanted])
    found = df.select(F.inline(entry)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    path = scratch_path(df.sparkSession, "medians")
    found.repartitionByRange("column", "value").withColumn("range", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("column", "range").agg(F.sum("n").alias("total")).withColumn(
        "start", F.coalesce(F.sum("total").over(before), F.lit(0)))
    middle = F.create_map(*[F.lit(x) for c in wanted for x in (c, _middle_ranks(counts[c])[0])])[F.col("column")]
    last = F.create_map(*[F.lit(x) for c in wanted for x in (c, _middle_ranks(counts[c])[1])])[F.col("column")]
    holding = starts.where((F.col("start") < last) & (F.col("start") + F.col("total") >= middle)).drop("total")
    so_far = Window.partitionBy("column", "range").orderBy("value")
    placed = ranged.join(holding, ["column", "range"]).withColumn("upto", F.col("start") + F.sum("n").over(so_far))
    picked = placed.groupBy("column").agg(*[
        F.min(F.when(F.col("upto") >= rank, F.col("value"))).alias(name) for name, rank in (("low", middle), ("high", last))])
    medians = {r["column"]: (r["low"] + r["high"]) / 2 for r in picked.collect()}
    return {c: medians.get(c) for c in columns}


_PROFILE_SCHEMA = "column string, row_count long, min double, max double, mean double, median double"


_STATS_SCHEMA = "column string, min double, max double, mean double, count long"


def result_profile(df: DataFrame, limit: int = PROFILED_COLUMNS) -> DataFrame:
    """Row count and min, max, mean and exact median of the first numeric columns."""
    columns = numeric_columns(df, limit)
    spark = df.sparkSession
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in columns:
        for fn in (F.count, F.min, F.max, F.avg):
            aggs.append(fn(c).alias(f"{c}__{fn.__name__}"))
    row: Row = df.agg(*aggs).first()
    counts = {c: row[f"{c}__count"] for c in columns}
    medians = exact_medians(df.select(*columns), columns, counts)
    number = lambda v: None if v is None else float(v)
    rows = [
        (c, row["__rows"], number(row[f"{c}__min"]), number(row[f"{c}__max"]), number(row[f"{c}__avg"]), medians[c])
        for c in columns
    ]
    return spark.createDataFrame(rows, _PROFILE_SCHEMA)


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Min, max, mean and count of every column that is at least half numbers.

    Text that reads as a number counts as one. All columns are aggregated in one pass over
    the table; only the single result row is turned into one row per column.
    """
    columns = list(columns if columns is not None else df.columns)
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df.sparkSession.createDataFrame([], _STATS_SCHEMA)

    def value(c: str):
        kind = df.schema[c].dataType
        return tolerant_number(F.col(c).cast("int") if isinstance(kind, T.BooleanType) else F.col(c))

    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        v = value(c)
        aggs.append(
            F.struct(
                F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count(v).alias("count")
            ).alias(f"s{i}")
        )
    entries = F.array(*[F.struct(F.lit(c).alias("column"), f"s{i}.*") for i, c in enumerate(columns)])
    return (
        df.agg(*aggs)
        .select("__rows", F.inline(entries))
        .where((F.col("count") > 0) & (F.col("count") * 2 >= F.col("__rows")))
        .drop("__rows")
    )
