"""Star joins, vintage and level slices, group summaries and rankings.

Joins carry no broadcast hint: Catalyst broadcasts a dimension only when its measured size
is below ``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution otherwise runs a
sort-merge join whose skewed partitions it splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.functions.text import like_pattern
from tallystar.schema import METRO_LEVEL, OWNERSHIP_TYPES, STATE_LEVEL


def ownership_types(spark: SparkSession) -> DataFrame:
    """The fixed ownership codes, as a relation whose size Catalyst knows and broadcasts."""
    values = ", ".join(f"({code}, '{text}')" for code, text in OWNERSHIP_TYPES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(own_code, own_description)")


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Inner join of a fact with ``(dimension, fact key, dimension key)`` entries.

    Facts without a partner in any dimension drop out; the dimension's key is not repeated.
    """
    joined = fact
    for dim, fact_key, dim_key in dimensions:
        keyed = dim.withColumnRenamed(dim_key, "__key")
        joined = joined.join(keyed, F.col(fact_key) == F.col("__key")).drop("__key")
    return joined


def latest_vintage(df: DataFrame, year: str, source: DataFrame | None = None) -> DataFrame:
    """Rows of the highest year, found by an uncorrelated scalar subquery on ``source``."""
    top = (source or df).agg(F.max(year))
    return df.where(F.col(year) == top.scalar())


def latest_dated_year(df: DataFrame, date: str) -> DataFrame:
    """As :func:`latest_vintage` for a date column.

    Kept as a lower bound on the column itself, so the scan can skip row groups by it.
    """
    first_day = df.agg(F.date_trunc("year", F.max(date)).cast(df.schema[date].dataType)).scalar()
    return df.where(F.col(date) >= first_day)


def at_levels(df: DataFrame, level: str, *levels: int) -> DataFrame:
    return df.where(F.col(level).isin(*levels))


def state_slice(df: DataFrame, level: str = "area_type") -> DataFrame:
    return at_levels(df, level, STATE_LEVEL)


def metro_slice(df: DataFrame, level: str = "area_type") -> DataFrame:
    return at_levels(df, level, METRO_LEVEL)


def occupation_summary(
    facts: DataFrame,
    occupation: str,
    year: str,
    employment: str,
    wage: str,
    titles: DataFrame | None = None,
    level: str = "area_type",
    levels: Sequence[int] = (STATE_LEVEL, METRO_LEVEL),
) -> DataFrame:
    """Count, employment sum and wage spread per occupation and year over rows with both measures.

    ``titles`` holds one row per occupation. It is joined to the groups, not to the facts: a
    frequent occupation is reduced by partial aggregation before anything is shuffled by it.
    """
    rows = at_levels(facts, level, *levels).where(F.col(employment).isNotNull() & F.col(wage).isNotNull())
    groups = rows.groupBy(occupation, year).agg(
        F.count(F.lit(1)).alias("area_count"),
        F.sum(employment).alias("total_national_employment"),
        F.avg(wage).alias("avg_annual_wage"),
        F.min(wage).alias("min_annual_wage"),
        F.max(wage).alias("max_annual_wage"),
        F.stddev(wage).alias("wage_std_dev"),
    )
    return groups if titles is None else groups.join(titles, occupation)


def contains_text(column: str, part: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in ``part`` keep their wildcard meaning."""
    return F.ilike(F.col(column), like_pattern(F.lit(part)))


def top_rows(
    df: DataFrame, measure: str, tie_break: Sequence[str], limit: int = 10, where: Column | None = None
) -> DataFrame:
    """The ``limit`` rows with the highest measure, planned as a per-task top-k and a merge."""
    rows = df.where(F.col(measure).isNotNull())
    if where is not None:
        rows = rows.where(where)
    return rows.orderBy(F.desc(measure), *tie_break).limit(limit)


def sum_by_title(
    facts: DataFrame,
    key: str,
    measure: str,
    titles: DataFrame,
    title_key: str,
    title: str,
    name: str = "total_jobs",
) -> DataFrame:
    """Measure summed per title, highest first; facts are summed per key before the join."""
    per_key = facts.groupBy(key).agg(F.sum(measure).alias("__sum"))
    named = per_key.join(titles.select(title_key, title), F.col(key) == F.col(title_key))
    return named.groupBy(title).agg(F.sum("__sum").alias(name)).orderBy(F.desc(name), title)


def distinct_titles(df: DataFrame, title: str) -> DataFrame:
    return df.select(title).distinct()
