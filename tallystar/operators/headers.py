"""Column layouts: mapping headers onto the canonical schema, and comparing layouts.

A layout table has one row per file and the header as an array. Everything about one header
is computed inside its row with array functions, so no shuffle is needed to plan a file.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystar.functions.text import bind, normalize_header
from tallystar.schema import ALIAS_TO_CANONICAL, CANONICAL_COLUMNS, COLUMN_DEFAULTS, METADATA_COLUMNS


def alias_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(ALIAS_TO_CANONICAL.items())])


def canonical_name(raw: Column) -> Column:
    """Alias target, else the upper-cased key, else the upper-cased raw header."""
    return bind(
        normalize_header(raw),
        lambda key: F.coalesce(F.try_element_at(alias_map(), key), F.when(key != "", F.upper(key)), F.upper(raw)),
    )


def rename_entries(header: Column) -> Column:
    """Array of ``(pos, raw, canonical, kept)``; the first column of a canonical name is kept."""
    def plan(names: Column) -> Column:
        return F.transform(
            F.arrays_zip(header.alias("raw"), names.alias("canonical")),
            lambda e, i: F.struct(
                i.alias("pos"),
                e["raw"].alias("raw"),
                e["canonical"].alias("canonical"),
                (F.array_position(names, e["canonical"]) == i + 1).alias("kept"),
            ),
        )

    return bind(F.transform(header, canonical_name), plan)


def rename_plan(layouts: DataFrame, header: str = "header") -> DataFrame:
    """One row per file column: ``pos, raw, canonical, kept`` beside the file's other columns."""
    rest = [c for c in layouts.columns if c != header]
    return layouts.select(*rest, F.inline(rename_entries(F.col(header))))


def schema_difference(layouts: DataFrame, header: str = "header") -> DataFrame:
    """Canonical columns a file lacks, its extra columns in file order, and dropped duplicates."""
    rest = [c for c in layouts.columns if c != header]
    canonical = F.array(*[F.lit(c) for c in CANONICAL_COLUMNS])
    known = F.array(*[F.lit(c) for c in CANONICAL_COLUMNS + METADATA_COLUMNS])
    planned = layouts.withColumn("__entries", rename_entries(F.col(header)))
    kept = F.transform(F.filter("__entries", lambda e: e["kept"]), lambda e: e["canonical"])
    dropped = F.transform(F.filter("__entries", lambda e: ~e["kept"]), lambda e: e["raw"])
    return planned.select(
        *rest,
        F.array_except(canonical, kept).alias("added_columns"),
        F.array_except(kept, known).alias("extra_columns"),
        dropped.alias("dropped_columns"),
    )


def default_for(column: str) -> str | None:
    return COLUMN_DEFAULTS.get(column)


def header_variants(layouts: DataFrame, header: str = "header") -> DataFrame:
    """``normalized, raw, files``: how many file columns carry each spelling."""
    return (
        layouts.select(F.explode(header).alias("raw"))
        .withColumn("normalized", normalize_header(F.col("raw")))
        .where(F.col("normalized") != "")
        .groupBy("normalized", "raw")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def variant_maps(variants: DataFrame) -> DataFrame:
    """Report form, one map of spelling to count per normalized name."""
    entry = F.struct("raw", "files")
    return variants.groupBy("normalized").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("variants")
    )


def common_columns(variants: DataFrame, limit: int = 10) -> DataFrame:
    """Most used normalized names with their most frequent spelling."""
    best = F.max_by("raw", F.struct(F.col("files"), F.col("raw")))
    return (
        variants.groupBy("normalized")
        .agg(F.sum("files").alias("total"), best.alias("example"))
        .orderBy(F.desc("total"), "normalized")
        .limit(limit)
    )


def rare_columns(variants: DataFrame, limit: int = 10) -> DataFrame:
    """Names that occur exactly once, in name order."""
    return (
        variants.groupBy("normalized")
        .agg(F.sum("files").alias("total"), F.min("raw").alias("example"))
        .where("total = 1")
        .select("normalized", "example")
        .orderBy("normalized")
        .limit(limit)
    )
