"""The survey pipeline: CSV corpus to inventory, standardized files, audited warehouse."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.operators import headers, warehouse
from tallystar.plans.guarded_sql import GuardedSql
from tallystar.sources import corpus, workbooks

FACT_TABLE = "fact"


@dataclass
class StandardizeOutcome:
    rows_path: str
    report_path: str
    files_processed: int
    files_failed: int
    total_rows: int


def convert(spark: SparkSession, source: str, output: str, pattern: str = "*.xlsx", force: bool = False) -> DataFrame:
    """Convert new workbooks to one CSV directory per sheet; returns this run's report.

    Workbooks with a converted sheet in an earlier report are skipped unless ``force`` is set.
    """
    listed = workbooks.list_workbooks(spark, source, pattern)
    report_path = f"{output}/report"
    try:
        done = spark.read.parquet(report_path).where("sheets_converted > 0")
    except AnalysisException:
        done = spark.createDataFrame([], "path string")
    pending = warehouse.pending_inputs(listed, done, "path", force)
    paths = [r["path"] for r in pending.select("path").collect()]
    run_id = uuid.uuid4().hex
    if paths:
        decoded = workbooks.convert_workbooks(spark, paths, f"{output}/decoded/{run_id}", pattern)
        workbooks.write_sheet_csv(workbooks.workbook_rows(decoded), f"{output}/csv/{run_id}")
        report = workbooks.conversion_report(decoded, with_path=True).withColumn("run", F.lit(run_id))
        report.write.mode("append").parquet(report_path)
    if not paths and not done.columns[1:]:
        raise FileNotFoundError(f"no workbooks under {source}")
    return spark.read.parquet(report_path).where(F.col("run") == run_id)


def analyze(spark: SparkSession, root: str, output: str, sample_rows: int = corpus.DEFAULT_SAMPLE_ROWS) -> DataFrame:
    """Write the column inventory and the header variants as JSON; returns the variants."""
    heads_path = f"{output}/heads"
    corpus.read_heads(corpus.scan_corpus(spark, root), sample_rows).write.mode("overwrite").parquet(heads_path)
    heads = spark.read.parquet(heads_path)
    corpus.write_report(corpus.file_inventory(heads), f"{output}/column_inventory")
    variants = headers.header_variants(heads.select("file_path", "header"))
    corpus.write_report(headers.variant_maps(variants), f"{output}/column_variants")
    return variants


def standardize(spark: SparkSession, root: str, output: str, multi_line: bool = True,
                split_bytes: int | None = corpus.SPLIT_BYTES) -> StandardizeOutcome:
    """Standardize a corpus; a file with a bad number is left out and reported.

    The CSV files are parsed once, into a staged table. Results per file and the rows of the
    clean files are then read from that table.
    """
    heads = corpus.read_heads(corpus.scan_corpus(spark, root), sample_rows=0)
    plan = corpus.plan_corpus(heads, split_bytes, multi_line)
    if plan.manifest.ranges.isEmpty():
        raise FileNotFoundError(f"no data files under {root}")
    return _publish(spark, corpus.standardize(plan, "quarantine"), heads, output)


def standardize_workbooks(spark: SparkSession, source: str, output: str, pattern: str = "*.xlsx") -> StandardizeOutcome:
    """Standardize the sheets of workbooks, each as a file of its own, without writing such files.

    The workbooks are decoded once, into a table; their own failures are in ``conversion_report``.
    """
    decoded = workbooks.convert_workbooks(spark, source, f"{output}/decoded", pattern)
    corpus.write_report(workbooks.conversion_report(decoded), f"{output}/conversion_report")
    rows = workbooks.workbook_rows(decoded)
    heads_path = f"{output}/heads"
    workbooks.sheet_heads(rows).write.parquet(heads_path)
    heads = spark.read.parquet(heads_path)
    return _publish(spark, corpus.standardize_rows(workbooks.sheet_records(rows, heads), "quarantine"), heads, output)


def _publish(spark: SparkSession, quarantined: DataFrame, heads: DataFrame, output: str) -> StandardizeOutcome:
    """Stage the rows, then write those of clean files, the report of all files and its totals."""
    staged_path = f"{output}/staged"
    quarantined.write.mode("overwrite").parquet(staged_path)
    clean, results = corpus.split_failed(spark.read.parquet(staged_path))
    rows_path, report_path = f"{output}/rows", f"{output}/standardization_report"
    warehouse.write_standardized(clean, rows_path)
    report = corpus.standardize_report(spark, heads, results)
    corpus.write_report(report, report_path)
    written = spark.read.schema(report.schema).json(report_path)
    corpus.write_report(corpus.report_totals(written), f"{output}/standardization_totals")
    totals = spark.read.json(f"{output}/standardization_totals").first()
    return StandardizeOutcome(
        rows_path, report_path, totals["files_processed"], totals["files_failed"], totals["total_rows"]
    )


def expected_rows(spark: SparkSession, report_path: str) -> DataFrame:
    """Rows per folder and file that a standardization report promises."""
    report = spark.read.json(report_path).where("status = 'ok' AND rows > 0")
    return report.groupBy(F.substring_index("file_path", "/", -2).alias("path")).agg(F.sum("rows").alias("rows"))


def migrate(spark: SparkSession, outcome: StandardizeOutcome, base: str) -> DataFrame:
    """Replace the warehouse by the standardized rows and record the vintages."""
    rows = spark.read.parquet(outcome.rows_path)
    fact = warehouse.load_table(
        warehouse.load_projection(rows), base, FACT_TABLE, expected_rows(spark, outcome.report_path)
    )
    audit = warehouse.vintage_audit(
        fact.withColumn("path", F.concat_ws("/", "SOURCE_FOLDER", "SOURCE_FILE")), "path"
    )
    warehouse.upsert_vintages(spark, f"{base}/data_vintages", audit)
    return fact


def run(spark: SparkSession, root: str, output: str) -> DataFrame:
    """All stages; returns the load summary."""
    analyze(spark, root, f"{output}/analysis")
    outcome = standardize(spark, root, f"{output}/standardized")
    return warehouse.load_summary(migrate(spark, outcome, f"{output}/warehouse"))


def guarded_warehouse(spark: SparkSession, base: str) -> GuardedSql:
    """Read-only SQL over the published fact table and its vintages."""
    path = warehouse.current_version(spark, base, FACT_TABLE)
    return GuardedSql(
        spark,
        {
            FACT_TABLE: lambda session: warehouse.read_fact(session, path),
            "data_vintages": lambda session: warehouse.read_vintages(session, f"{base}/data_vintages"),
        },
    )
