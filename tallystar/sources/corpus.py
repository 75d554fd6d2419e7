"""CSV corpora whose files disagree about their headers.

Only the head of each file is read to learn its layout. Files are then read by byte ranges, each row of the manifest
carrying the layout of its file, so neither the plan nor the driver grows with the number of files or layouts.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.functions.numeric import is_bad_number, sanitize_numeric
from tallystar.functions.text import detect_year, normalize_header, path_name, path_parent, suppress_text
from tallystar.operators.headers import default_for, rename_entries, schema_difference
from tallystar.schema import (
    CANONICAL_COLUMNS,
    CANONICAL_TYPES,
    METADATA_COLUMNS,
    NUMERIC_COLUMNS,
    SCHEMA_VERSION,
    SKIPPED_NAME_PARTS,
    SUPPRESSION_TOKENS,
)
from tallystar.sources.paths import open_bytes
from tallystar.sources.ranges import SPLIT_BYTES, Manifest, plan_ranges, read_ranges
from tallystar.tasks import ship_by_value

DEFAULT_SAMPLE_ROWS = 200
EXAMPLE_ROWS = 5

ship_by_value(__name__)

RAGGED = "(cells beyond the header)"

_FILES = "file_path string, folder string, file_name string, size_bytes long"
_HEADS = f"{_FILES}, header array<string>, samples array<array<string>>"


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Non-empty data files directly inside the folders of ``root``, in path order.

    Only names and sizes are listed; ``content`` is never selected, so no file is opened.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root}/*/")
    name = path_name(F.col("path"))
    skipped = F.lower(name).rlike("|".join(SKIPPED_NAME_PARTS))
    return (
        listed.where((F.col("length") > 0) & ~skipped)
        .select(
            F.col("path").alias("file_path"),
            path_name(path_parent(F.col("path"))).alias("folder"),
            name.alias("file_name"),
            F.col("length").alias("size_bytes"),
        )
        .orderBy("file_path")
    )


def _head_reader(sample_rows: int, open_file):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                with open_file(record.file_path) as stream:
                    handle = io.TextIOWrapper(stream, encoding="utf-8", errors="ignore", newline="")
                    lines = list(itertools.islice(csv.reader(handle), sample_rows + 1))
                header, samples = (lines[0], lines[1:]) if lines and lines[0] else ([], [])
                rows.append((*record, header, samples))
            yield pd.DataFrame(rows, columns=[*batch.columns, "header", "samples"])

    return read


def read_heads(files: DataFrame, sample_rows: int = DEFAULT_SAMPLE_ROWS, open_file=open_bytes) -> DataFrame:
    """Header and first records of each file; both empty where the first line is.

    Each task opens its share of the files and stops after the sample, so the cost does not
    depend on file sizes. Pass ``sample_rows=0`` where only headers are wanted, and as ``open_file`` a function from
    path to binary stream for a store that Arrow does not know.
    """
    # A fixed count: adaptive execution would merge these few bytes of paths into one task.
    tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
    spread = files.select("file_path", "folder", "file_name", "size_bytes").repartition(tasks, "file_path")
    return spread.mapInPandas(_head_reader(sample_rows, open_file), _HEADS)


def file_inventory(heads: DataFrame) -> DataFrame:
    """Per file: year, size, columns with examples, and the suppression tokens seen."""
    samples = F.col("samples")
    examples = lambda i: F.filter(
        F.transform(F.slice(samples, 1, EXAMPLE_ROWS), lambda r: F.get(r, i)),
        lambda v: v.isNotNull() & (v != ""),
    )
    columns = F.transform(
        F.col("header"),
        lambda h, i: F.struct(
            h.alias("raw_name"), normalize_header(h).alias("normalized_name"), examples(i).alias("example_values")
        ),
    )
    cells = F.flatten(F.transform(samples, lambda r: F.slice(r, 1, F.greatest(F.size("header"), F.lit(1)))))
    tokens = F.array_sort(F.array_distinct(F.filter(cells, lambda v: v.isin(*SUPPRESSION_TOKENS))))
    return heads.where(F.size("header") > 0).select(
        "file_path",
        "folder",
        detect_year(F.col("file_name"), path_parent(F.col("file_path"))).alias("year"),
        "size_bytes",
        F.size("header").alias("column_count"),
        F.size("samples").alias("row_samples"),
        columns.alias("columns"),
        tokens.alias("suppression_tokens"),
    )


@dataclass(frozen=True)
class CorpusPlan:
    """How to read a corpus: byte ranges of all files with their layouts, and the extra columns of all layouts."""

    manifest: Manifest
    extras: list[str]


def plan_corpus(heads: DataFrame, split_bytes: int | None = SPLIT_BYTES, multi_line: bool = True,
                open_file=open_bytes) -> CorpusPlan:
    """Plan the reading of all files with a header.

    Paths and layouts stay a table. Only the distinct names of extra columns reach the driver, as they make the schema.
    """
    kept = F.filter(rename_entries(F.col("header")), lambda e: e["kept"])
    places = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["canonical"], e["pos"])))
    files = heads.where(F.size("header") > 0).select(
        "file_path", "size_bytes", F.size("header").alias("width"), places.alias("places"))
    manifest = plan_ranges(files, split_bytes, multi_line, open_file)
    names = manifest.ranges.where("start = 0").select(F.explode(F.map_keys("places")).alias("name")).distinct()
    # A column without a name cannot be told from another.
    known = ["", *CANONICAL_COLUMNS, *METADATA_COLUMNS]
    extras = names.where(~F.col("name").isin(known)).orderBy("name").collect()
    return CorpusPlan(manifest, [row["name"] for row in extras])


def read_corpus(plan: CorpusPlan) -> DataFrame:
    """All files as text under canonical names, with defaults, extras and the file path.

    A record with more cells than its header has ``_too_long``. Quotes are escaped by doubling.
    """
    defaults = {name: default for name in CANONICAL_COLUMNS if (default := default_for(name)) is not None}
    return read_ranges(plan.manifest, [*CANONICAL_COLUMNS, *plan.extras], defaults)


def lineage_columns(path: Column) -> list[Column]:
    name, parent = path_name(path), path_parent(path)
    return [
        name.alias("_source_file"),
        path_name(parent).alias("_source_folder"),
        detect_year(name, parent).alias("_data_year"),
    ]


def with_lineage(rows: DataFrame) -> DataFrame:
    """Replace the file path by file name, folder name and detected year."""
    names = [c for c in rows.columns if c not in ("_source_path", "_too_long")]
    return rows.select(*names, *lineage_columns(F.col("_source_path")))


def standardize(plan: CorpusPlan, mode: str = "strict") -> DataFrame:
    """The corpus in the canonical schema, see :func:`standardize_rows`."""
    return standardize_rows(read_corpus(plan), mode)


def standardize_rows(raw: DataFrame, mode: str = "strict") -> DataFrame:
    """Text rows of :func:`read_corpus` or of sheets in the canonical schema: canonical columns, extras, lineage.

    ``strict`` fails on a numeric column with other text and on a row with more cells than its header.
    ``quarantine`` nulls such a value and names its column, or ``RAGGED``, in ``_bad_columns``; see
    :func:`split_failed` for whole-file rejection.
    """
    if mode == "strict":
        long_row = F.raise_error(F.concat(F.lit("row longer than its header in "), F.col("_source_path")))
        raw = raw.withColumn("_source_path", F.when(F.col("_too_long"), long_row).otherwise(F.col("_source_path")))
    columns = [
        (
            sanitize_numeric(F.col(name), CANONICAL_TYPES[name], mode)
            if name in NUMERIC_COLUMNS
            else suppress_text(F.col(name))
        ).alias(name)
        for name in raw.columns
        if name not in ("_source_path", "_too_long")
    ]
    columns += lineage_columns(F.col("_source_path"))
    if mode == "quarantine":
        bad = [F.when(is_bad_number(F.col(n), CANONICAL_TYPES[n]), F.lit(n)) for n in NUMERIC_COLUMNS]
        bad.append(F.when(F.col("_too_long"), F.lit(RAGGED)))
        columns += [F.array_compact(F.array(*bad)).alias("_bad_columns"), F.col("_source_path")]
    return raw.select(*columns)


def file_results(quarantined: DataFrame) -> DataFrame:
    """Per file: rows, rows with a bad number, and the columns those were in."""
    bad = F.size("_bad_columns") > 0
    return quarantined.groupBy("_source_path").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("bad_rows"),
        F.array_compact(
            F.array(*[F.when(F.bool_or(F.array_contains("_bad_columns", n)), F.lit(n)) for n in (*NUMERIC_COLUMNS, RAGGED)])
        ).alias("bad_columns"),
    )


def split_failed(quarantined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of clean files, and the results of all files; one bad number or ragged row fails its file."""
    results = file_results(quarantined)
    failed = results.where("bad_rows > 0").select("_source_path")
    clean = quarantined.join(failed, "_source_path", "left_anti").drop("_bad_columns", "_source_path")
    return clean, results


def standardize_report(spark: SparkSession, heads: DataFrame, results: DataFrame) -> DataFrame:
    """Per file: status, rows, columns and what the layout added, kept as extra or dropped."""
    planned = schema_difference(heads.where(F.size("header") > 0).select("file_path", "header"))
    counted = results.withColumnRenamed("_source_path", "file_path")
    width = F.lit(len(CANONICAL_COLUMNS) + len(METADATA_COLUMNS)) + F.size("extra_columns")
    failed = F.coalesce(F.col("bad_rows"), F.lit(0)) > 0
    return planned.join(counted, "file_path", "left").select(
        "file_path",
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        width.alias("columns"),
        "added_columns",
        "extra_columns",
        "dropped_columns",
        F.when(failed, F.concat(F.lit("bad values in "), F.array_join("bad_columns", ", "))).alias("error"),
    )


def report_totals(report: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return report.agg(
        F.count_if(ok).alias("files_processed"),
        F.count_if(~ok).alias("files_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("total_rows"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.current_timestamp().alias("generated_at"),
    )


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").json(path)
