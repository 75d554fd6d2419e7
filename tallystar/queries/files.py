"""Queries that read files: corpora, archives, workbooks, Parquet trees, and the warehouse load."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystar.functions.text import path_name
from tallystar.operators import warehouse
from tallystar.plans import pipeline
from tallystar.queries import inputs
from tallystar.queries.inputs import FILE_SQL, LAYOUTS, SURVEY_SQL
from tallystar.queries.tables import Query, table
from tallystar.schema import CANONICAL_COLUMNS, CANONICAL_TYPES, NUMERIC_COLUMNS
from tallystar.session import scratch_path
from tallystar.sources import archives, corpus, workbooks

_TEXT_KEYS = ["AREA", "AREA_TITLE", "OCC_CODE", "OCC_TITLE", "TOT_EMP", "A_MEAN", "NOTES"]


def corpus_scan(spark, sf_dir):
    return corpus.scan_corpus(spark, inputs.corpus_root(spark, sf_dir)).select("folder", "file_name")


def header_sample(spark, sf_dir):
    heads = inputs.corpus_heads(spark, sf_dir)
    return heads.select(
        "folder",
        "file_name",
        F.array_join("header", "|").alias("header"),
        F.size("samples").alias("row_samples"),
    )


def hetero_csv_read(spark, sf_dir):
    plan = inputs.corpus_plan(spark, sf_dir)
    rows = corpus.read_corpus(plan)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _TEXT_KEYS])


def file_inventory(spark, sf_dir):
    heads = inputs.corpus_heads(spark, sf_dir)
    found = corpus.file_inventory(heads)
    return found.select(
        path_name(F.col("file_path")).alias("file_name"),
        "folder",
        "year",
        "column_count",
        "row_samples",
        F.array_join(F.transform("columns", lambda c: c["normalized_name"]), "|").alias("normalized"),
        F.array_join("suppression_tokens", "|").alias("tokens"),
    )


def lineage(spark, sf_dir):
    rows = corpus.with_lineage(corpus.read_corpus(inputs.corpus_plan(spark, sf_dir)))
    return rows.groupBy("_source_file", "_source_folder", "_data_year").agg(F.count(F.lit(1)).alias("rows"))


def standardize(spark, sf_dir):
    return corpus.standardize(inputs.corpus_plan(spark, sf_dir))


def standardize_report(spark, sf_dir):
    heads, plan = inputs.corpus_heads(spark, sf_dir, 0), inputs.corpus_plan(spark, sf_dir)
    _, results = corpus.split_failed(corpus.standardize(plan, mode="quarantine"))
    report = corpus.standardize_report(spark, heads, results)
    return report.select(
        path_name(F.col("file_path")).alias("file_name"),
        "status",
        "rows",
        "columns",
        F.array_join("added_columns", ",").alias("added"),
        F.array_join("extra_columns", ",").alias("extra"),
        F.array_join("dropped_columns", ",").alias("dropped"),
    )


def parquet_scan(spark, sf_dir):
    rows = warehouse.read_parquet_tree(spark, inputs.standardized_root(spark, sf_dir))
    return rows.groupBy("_source_folder").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("TOT_EMP").alias("tot_emp")
    )


def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "roundtrip")
    rows = table(spark, sf_dir, "lineitem").withColumn("folder", F.col("l_returnflag"))
    warehouse.write_standardized(rows, path, "folder")
    back = spark.read.parquet(path)
    return back.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "folder")


def warehouse_load(spark, sf_dir):
    rows = warehouse.load_projection(
        warehouse.read_parquet_tree(spark, inputs.standardized_root(spark, sf_dir))
    )
    expected = (
        inputs.survey_rows(spark, sf_dir)
        .groupBy(F.expr(f"{_FOLDER} || '/' || {FILE_SQL} || '.csv'").alias("path"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    base = scratch_path(spark, "warehouse")
    return warehouse.load_table(rows, base, "fact", expected).drop("IMPORTED_AT")


def archive_members(spark, sf_dir):
    found = archives.read_archives(spark, inputs.archive_root(spark, sf_dir))
    return found.select(
        path_name(F.col("archive")).alias("archive"),
        "member",
        "base_name",
        "size_bytes",
        F.col("error").isNull().alias("ok"),
    )


def workbook_rows(spark, sf_dir):
    decoded = workbooks.convert_workbooks(
        spark, inputs.workbook_root(spark, sf_dir), scratch_path(spark, "decoded")
    )
    rows = workbooks.workbook_rows(decoded)
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select(
        "file", "sheet", "row_no",
        cell(0).alias("order_key"), cell(1).alias("priority"), cell(2).alias("gap"),
        cell(3).cast("double").alias("price"),
    )


def conversion_report(spark, sf_dir):
    decoded = workbooks.read_workbooks(spark, inputs.workbook_root(spark, sf_dir))
    return workbooks.conversion_report(decoded).select("file", "success", "sheets_converted", "sheets_failed")


# --- SQL counterparts ---


def _by_year(pick, missing: str = "NULL") -> str:
    cases = "".join(
        f" WHEN {year} THEN {value}" for year, layout in LAYOUTS.items() if (value := pick(layout)) is not None
    )
    return f"CASE data_year{cases} ELSE {missing} END" if cases else missing


def _source(target: str):
    return lambda layout: next((src for _, src, canonical in layout if canonical == target), None)


_NULLS = "('', '#', '**', '*', '~')"
_SQL_TYPES = {"bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE"}


def _canonical_sql(name: str) -> str:
    if name == "I_GROUP":
        return f"nullif({_by_year(_source(name), chr(39) + 'cross-industry' + chr(39))}, '') AS I_GROUP"
    value = _by_year(_source(name))
    if name in NUMERIC_COLUMNS:
        kind = _SQL_TYPES[CANONICAL_TYPES[name].simpleString()]
        return f"CAST(CASE WHEN trim({value}) NOT IN {_NULLS} THEN trim({value}) END AS {kind}) AS {name}"
    return f"CAST(CASE WHEN {value} NOT IN {_NULLS} THEN {value} END AS VARCHAR) AS {name}"


_STANDARD = ", ".join(_canonical_sql(c) for c in CANONICAL_COLUMNS)
_FILE = f"{FILE_SQL} || '.csv'"
_FOLDER = "'vintage_' || CAST(data_year AS STRING)"
_FILES = f"SELECT DISTINCT {_FOLDER} AS folder, {_FILE} AS file_name, data_year, block FROM ({SURVEY_SQL})"


def _header_text(layout, sep="|") -> str:
    return "'" + sep.join(header for header, _, _ in layout) + "'"


def _normal(header: str) -> str:
    return "_".join(header.replace("*", "").lower().split())


def _targets(layout) -> list[str]:
    return [canonical for _, _, canonical in layout if canonical]


def _quoted(items) -> str:
    return "'" + ",".join(items) + "'"


_ADDED = _by_year(lambda lay: _quoted(c for c in CANONICAL_COLUMNS if c not in _targets(lay)))
_EXTRA = _by_year(lambda lay: _quoted(c for c in _targets(lay) if c not in CANONICAL_COLUMNS))
_DROPPED = _by_year(lambda lay: _quoted(h for h, _, canonical in lay if canonical is None))
_WIDTH = _by_year(lambda lay: str(35 + sum(c not in CANONICAL_COLUMNS for c in _targets(lay))))
_CELLS = _by_year(lambda lay: "[" + ", ".join(src for _, src, _ in lay) + "]")

_STANDARD_SQL = f"""
SELECT {_STANDARD}, {_by_year(_source("NOTES"))} AS NOTES,
       {_FILE} AS _source_file, {_FOLDER} AS _source_folder, data_year AS _data_year
FROM ({SURVEY_SQL})
"""

def _sheets(spark, sf_dir):
    path = scratch_path(spark, "sheets")
    return path, pipeline.standardize_workbooks(spark, inputs.titled_workbook_root(spark, sf_dir), path)


def sheets_standardize(spark, sf_dir):
    """Rows of workbook sheets of several layouts in the canonical schema, without the sheet that has a bad figure."""
    _, outcome = _sheets(spark, sf_dir)
    rows = spark.read.parquet(outcome.rows_path)
    return rows.select("AREA", "OCC_CODE", "TOT_EMP", "A_MEAN", "NOTE", "I_GROUP", "_source_file", "_source_folder", "_data_year")


def sheets_report(spark, sf_dir):
    """The JSON report of the same sheets, as it was written."""
    _, outcome = _sheets(spark, sf_dir)
    return spark.read.json(outcome.report_path).select(
        F.substring_index("file_path", "/", -2).alias("sheet"), "status", "rows", "columns",
        F.array_join("extra_columns", ",").alias("extra"), F.array_join("dropped_columns", ",").alias("dropped"),
        F.size("added_columns").cast("long").alias("added"), F.coalesce("error", F.lit("")).alias("error"))


def inventory_report(spark, sf_dir):
    """The JSON inventory and header variants of the corpus, as they were written: columns of files, files of variants."""
    path = scratch_path(spark, "analysis")
    pipeline.analyze(spark, inputs.corpus_root(spark, sf_dir), path)
    found = spark.read.json(f"{path}/column_inventory").select(
        path_name(F.col("file_path")).alias("file_name"), "year", "row_samples", F.posexplode("columns").alias("pos", "c"))
    return found.select("file_name", F.col("year").cast("int"), F.col("row_samples").cast("int"), "pos",
                        F.col("c.raw_name").alias("raw_name"), F.col("c.normalized_name").alias("normalized_name"))


_BOOKS = f"""
SELECT {inputs.BOOK_SQL} AS book, o_orderstatus, o_orderkey, o_orderpriority, o_totalprice FROM orders
"""

QUERIES = {
    "corpus_scan": Query(corpus_scan, f"SELECT folder, file_name FROM ({_FILES})"),
    "header_sample": Query(
        header_sample,
        f"""SELECT {_FOLDER} AS folder, {_FILE} AS file_name, {_by_year(_header_text)} AS header,
        CAST(least(count(*), 200) AS INTEGER) AS row_samples
        FROM ({SURVEY_SQL}) GROUP BY data_year, block""",
    ),
    "hetero_csv_read": Query(
        hetero_csv_read,
        f"SELECT {', '.join(f'coalesce({_by_year(_source(c))}, {chr(39) * 2}) AS {c}' for c in _TEXT_KEYS)} FROM ({SURVEY_SQL})",
    ),
    "file_inventory": Query(
        file_inventory,
        f"""WITH numbered AS (
          SELECT *, row_number() OVER (PARTITION BY data_year, block ORDER BY o_orderkey) AS rn FROM ({SURVEY_SQL})
        ), sampled AS (SELECT * FROM numbered WHERE rn <= 200),
        tokens AS (
          SELECT data_year, block, string_agg(cell, '|' ORDER BY cell) AS tokens FROM (
            SELECT DISTINCT data_year, block, unnest({_CELLS}) AS cell FROM sampled
          ) WHERE cell IN {_NULLS} GROUP BY data_year, block
        )
        SELECT {_FILE} AS file_name, {_FOLDER} AS folder, data_year AS year,
          CAST({_by_year(lambda lay: str(len(lay)))} AS INTEGER) AS column_count,
          CAST(count(*) AS INTEGER) AS row_samples,
          {_by_year(lambda lay: "'" + "|".join(_normal(h) for h, _, _ in lay) + "'")} AS normalized,
          coalesce(any_value(tokens), '') AS tokens
        FROM sampled LEFT JOIN tokens USING (data_year, block) GROUP BY data_year, block""",
    ),
    "lineage": Query(
        lineage,
        f"""SELECT {_FILE} AS _source_file, {_FOLDER} AS _source_folder, data_year AS _data_year, count(*) AS rows
        FROM ({SURVEY_SQL}) GROUP BY data_year, block""",
    ),
    "standardize": Query(standardize, _STANDARD_SQL),
    "standardize_report": Query(
        standardize_report,
        f"""SELECT {_FILE} AS file_name, 'ok' AS status, count(*) AS rows, CAST({_WIDTH} AS INTEGER) AS columns,
        {_ADDED} AS added, {_EXTRA} AS extra, {_DROPPED} AS dropped
        FROM ({SURVEY_SQL}) GROUP BY data_year, block""",
    ),
    "parquet_scan": Query(
        parquet_scan,
        f"""SELECT _source_folder, count(*) AS rows, CAST(sum(TOT_EMP) AS BIGINT) AS tot_emp
        FROM ({_STANDARD_SQL}) GROUP BY _source_folder""",
    ),
    "parquet_roundtrip": Query(
        parquet_roundtrip,
        "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag AS folder FROM lineitem",
    ),
    "warehouse_load": Query(
        warehouse_load,
        f"""SELECT {", ".join(c for c in CANONICAL_COLUMNS if c != "AREA_TYPE")},
        CAST(AREA_TYPE AS INTEGER) AS AREA_TYPE, _data_year AS SURVEY_YEAR, 'May' AS SURVEY_MONTH,
        _source_file AS SOURCE_FILE, _source_folder AS SOURCE_FOLDER FROM ({_STANDARD_SQL})""",
    ),
    "archive_members": Query(
        archive_members,
        f"""SELECT 'bundle_' || lpad(CAST(book AS VARCHAR), 5, '0') || '.zip' AS archive,
        'nested/status_' || o_orderstatus || '.csv' AS member, 'status_' || o_orderstatus || '.csv' AS base_name,
        CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS size_bytes, true AS ok
        FROM ({_BOOKS}) GROUP BY book, o_orderstatus
        UNION ALL SELECT 'broken.zip', NULL, NULL, NULL, false""",
    ),
    "workbook_rows": Query(
        workbook_rows,
        f"""SELECT 'book_' || lpad(CAST(book AS VARCHAR), 5, '0') || '.xlsx' AS file,
        'Status_' || o_orderstatus AS sheet,
        CAST(row_number() OVER (PARTITION BY book, o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS row_no,
        CAST(o_orderkey AS VARCHAR) AS order_key, o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS gap,
        o_totalprice AS price FROM ({_BOOKS})""",
    ),
    "conversion_report": Query(
        conversion_report,
        f"""SELECT 'book_' || lpad(CAST(book AS VARCHAR), 5, '0') || '.xlsx' AS file, true AS success,
        count(DISTINCT o_orderstatus) AS sheets_converted, CAST(0 AS BIGINT) AS sheets_failed
        FROM ({_BOOKS}) GROUP BY book
        UNION ALL SELECT 'broken.xlsx', false, 0, 0""",
    ),
    "sheets_standardize": Query(
        sheets_standardize,
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS AREA, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS OCC_CODE,
        CASE WHEN o_orderkey % 7 <> 0 AND o_orderstatus <> 'O' THEN o_orderkey % 1000 END AS TOT_EMP,
        CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS A_MEAN,
        CASE WHEN o_orderstatus = 'F' THEN 'n' || CAST(o_orderkey % 1000 AS VARCHAR) END AS NOTE, 'cross-industry' AS I_GROUP,
        'May_2019_' || o_orderstatus || '.csv' AS _source_file, 'titled_' || lpad(CAST(book AS VARCHAR), 5, '0') AS _source_folder,
        2019 AS _data_year FROM ({_BOOKS}) WHERE NOT (book = 0 AND o_orderstatus = 'P')""",
    ),
    "sheets_report": Query(
        sheets_report,
        f"""SELECT 'titled_' || lpad(CAST(book AS VARCHAR), 5, '0') || '/May_2019_' || o_orderstatus || '.csv' AS sheet,
        CASE WHEN book = 0 AND o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status,
        count(*) + CAST(book = 0 AND o_orderstatus = 'P' AS BIGINT) AS rows,
        CAST({len(CANONICAL_COLUMNS) + 3} + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 1 ELSE 0 END AS BIGINT) AS columns,
        CASE o_orderstatus WHEN 'F' THEN 'NOTE' ELSE '' END AS extra, CASE o_orderstatus WHEN 'P' THEN 'Area' ELSE '' END AS dropped,
        CAST({len(CANONICAL_COLUMNS)} - CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 2 END AS BIGINT) AS added,
        CASE WHEN book = 0 AND o_orderstatus = 'P' THEN 'bad values in TOT_EMP' ELSE '' END AS error
        FROM ({_BOOKS}) GROUP BY book, o_orderstatus""",
    ),
    "inventory_report": Query(
        inventory_report,
        " UNION ALL ".join(
            f"""SELECT {_FILE} AS file_name, data_year AS year, CAST(least(count(*), 200) AS INTEGER) AS row_samples,
            CAST({pos} AS INTEGER) AS pos, '{h.replace("'", "''")}' AS raw_name, '{_normal(h)}' AS normalized_name
            FROM ({SURVEY_SQL}) WHERE data_year = {year} GROUP BY data_year, block"""
            for year, layout in inputs.LAYOUTS.items() for pos, (h, _, _) in enumerate(layout)
        ),
    ),
}
