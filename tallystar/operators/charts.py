"""Chart-ready series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystar.session import scratch_path

def _points(df: DataFrame, label: str, series: str, value: Column, names: Sequence | None) -> DataFrame:
    """The value of every label and series that occur together, computed once and written."""
    kept = df if names is None else df.where(F.col(series).isin(*names))
    path = scratch_path(df.sparkSession, "chart-points")
    points = kept.groupBy(F.col(label).alias("label"), F.col(series).alias("series")).agg(value.alias("value"))
    points.write.parquet(path)
    return df.sparkSession.read.schema(points.schema).parquet(path)


def _names(points: DataFrame, names: Sequence | None) -> Column:
    """The series of a chart in order, as one array: given, or all that occur."""
    if names is not None:
        return F.array(*[F.lit(n) for n in names])
    return points.agg(F.sort_array(F.collect_set("series")).alias("names")).scalar()


def _filled(df: DataFrame, label: str, series: str, value: Column, names: Sequence | None) -> tuple[DataFrame, Column]:
    """A row for every label and series, null where they do not meet."""
    points = _points(df, label, series, value, names)
    all_names = _names(points, names)
    labels = (points if names is None else df.select(F.col(label).alias("label"))).select("label").distinct()
    grid = labels.withColumn("names", all_names).select("label", F.posexplode("names").alias("place", "series"))
    met = points.withColumnsRenamed({"label": "l", "series": "s"})
    same = F.col("label").eqNullSafe(F.col("l")) & F.col("series").eqNullSafe(F.col("s"))
    return grid.join(met, same, "left").select("label", "place", "series", "value"), all_names


def chart_series(df: DataFrame, label: str, series: str, value: Column, names: Sequence | None = None) -> DataFrame:
    """``label, series, value`` with a row for every label and series, null where missing."""
    filled, _ = _filled(df, label, series, value, names)
    return filled.select(F.col("label").alias(label), "series", "value")


def chart_document(
    df: DataFrame, label: str, series: str, value: Column, kind: str, title: str, names: Sequence | None = None,
    x_title: str | None = None, y_title: str | None = None,
) -> DataFrame:
    """One row with the chart as JSON: ordered labels and one aligned value array per series.

    The document is a single value, so it holds as many labels and series as the chart has.
    """
    filled, _ = _filled(df, label, series, value, names)
    lines = filled.groupBy("place", "series").agg(F.sort_array(F.collect_list(F.struct("label", "value"))).alias("points"))
    whole = lines.agg(F.sort_array(F.collect_list(F.struct("place", "series", "points"))).alias("lines"))
    datasets = F.transform("lines", lambda line: F.struct(
        line["series"].alias("name"), F.transform(line["points"], lambda p: p["value"]).alias("values")))
    chart = F.struct(
        F.lit(kind).alias("type"),
        F.lit(title).alias("title"),
        F.struct(F.transform(F.get("lines", F.lit(0))["points"], lambda p: p["label"]).alias("labels"),
                 datasets.alias("datasets")).alias("data"),
        F.struct(F.lit(x_title).alias("x_title"), F.lit(y_title).alias("y_title")).alias("options"),
    )
    return whole.select(F.to_json(chart, {"ignoreNullFields": "false"}).alias("chart"))
