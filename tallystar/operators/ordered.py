"""Ordered computations inside groups of any size, over keys of any type.

A plain window would sort a whole group in one task, and one group may hold a large share of the table. Here all rows
are dealt into ranges of (group, order, ties) whose bounds Spark samples, and written in that order, each with its range
and its place. A range is then a window of its own, and the ranges of a group are stitched together by a second window
over one row per range and group. Rows that agree in all these columns are dealt out by a row number, so that even one
order value of a third of all rows is cut.

Null groups form one group, null order values come first; no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystar.session import scratch_path

_RANGE, _AT, _SALT, _KIND, _TARGET = "__range", "__at", "__salt", "__kind", "__target"


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """The rows as a written table, with the range they lie in and their place in the order of the columns."""
    dealt = df.withColumn(_SALT, F.monotonically_increasing_id()).repartitionByRange(*order, _SALT)
    placed = dealt.sortWithinPartitions(*order).drop(_SALT).withColumns(
        {_RANGE: F.spark_partition_id(), _AT: F.monotonically_increasing_id()})
    path = scratch_path(df.sparkSession, "ordered")
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def _stitched(rows: DataFrame, per_range: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with the columns of their range and group; null groups meet."""
    keys = [_RANGE, *group]
    other = per_range.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = [rows[k].eqNullSafe(other[f"__of_{k}"]) for k in keys]
    return rows.join(other, same).drop(*[f"__of_{k}" for k in keys])


def running_number(df: DataFrame, group: Sequence[str], order: str, ties: Sequence[str] = (), name: str = "step") -> DataFrame:
    """1-based position of each row in its group, ordered by ``order`` then ``ties``."""
    placed = _placed(df, *group, order, *ties)
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(_RANGE, *group)
        .agg(F.count(F.lit(1)).alias("__n"), F.min(_AT).alias("__first"))
        .select(_RANGE, *group, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    )
    # Places of a group in one range follow each other.
    position = (F.col(_AT) + F.col("__shift") + 1).cast("int")
    return _stitched(placed, starts, group).select(*[F.col(f"`{c}`") for c in df.columns if c != name], position.alias(name))


def first_following(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    is_target: Column,
    payload: Sequence[str],
    name: str = "following",
    is_asking: Column | None = None,
) -> DataFrame:
    """For each asking row (all by default), a struct of the nearest strictly later target row of its group, or null.

    Targets that share one ``order`` value are not told apart.
    """
    target = F.coalesce(is_target, F.lit(False))
    asking = F.lit(True) if is_asking is None else F.coalesce(is_asking, F.lit(False))
    # A target stands before the rows of its own order value that ask, so what follows a row is later.
    kinds = F.concat(F.when(target, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                     F.when(asking, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    events = df.withColumn(_KIND, F.explode(kinds))
    placed = _placed(events, *group, order, _KIND).withColumn(_TARGET, F.when(F.col(_KIND) == 0, F.struct(order, *payload)))

    later_ranges = Window.partitionBy(*group).orderBy(F.desc(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    per_range = (
        placed.groupBy(_RANGE, *group)
        .agg(F.min_by(_TARGET, F.when(F.col(_KIND) == 0, F.col(_AT))).alias("__first"))
        .select(_RANGE, *group, F.last("__first", ignorenulls=True).over(later_ranges).alias("__next"))
    )
    inside = Window.partitionBy(_RANGE, *group).orderBy(F.desc(_AT)).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("__near", F.last(_TARGET, ignorenulls=True).over(inside)).where(F.col(_KIND) == 1)
    return _stitched(near, per_range, group).select(
        *[F.col(f"`{c}`") for c in df.columns if c != name], F.coalesce("__near", "__next").alias(name))
