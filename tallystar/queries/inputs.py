"""Inputs derived from the driver's tables: survey rows, CSV corpora, workbooks and archives.

Files are written once per session and table directory, below the shared scratch root. Their
number grows with the tables: a file holds at most ``BLOCK_ORDERS`` order keys of one year.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.queries.tables import tables
from tallystar.session import scratch_path
from tallystar.sources import corpus
from tallystar.sources.paths import arrow_location
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

BLOCK_ORDERS = 50_000
BOOK_ORDERS = 10_000

# Text of one survey row, valid in both SQL dialects.
SURVEY_SQL = f"""
SELECT o_orderkey,
  CAST(year(o_orderdate) + 20 AS INTEGER) AS data_year,
  CAST(floor(o_orderkey / {BLOCK_ORDERS}) AS INTEGER) AS block,
  lpad(CAST(n_nationkey AS STRING), 7, '0') AS area,
  n_name AS area_title,
  CAST(n_regionkey + 1 AS STRING) AS area_type,
  CASE WHEN c_custkey % 7 = 0 THEN '#' ELSE left(c_mktsegment, 2) END AS prim_state,
  '000000' AS naics,
  c_mktsegment AS naics_title,
  'sector' AS i_group,
  left(o_orderpriority, 1) AS own_code,
  '11-' || CAST(o_custkey AS STRING) AS occ_code,
  o_orderpriority || ', "' || o_orderstatus || '" staff' AS occ_title,
  CASE WHEN o_orderstatus = 'P' THEN '**' ELSE 'detailed' END AS o_group,
  CASE WHEN o_orderkey % 11 = 0 THEN '**' WHEN o_orderkey % 13 = 0 THEN ' # '
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS tot_emp,
  CASE WHEN o_orderkey % 17 = 0 THEN '*' WHEN o_orderkey % 19 = 0 THEN '~'
       ELSE CAST(o_totalprice AS STRING) END AS a_mean,
  CAST(o_custkey AS STRING) AS rate,
  CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE '' END AS annual,
  'note ' || o_orderstatus AS notes
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

# Per year: header as written, survey column under it, canonical column it must become.
# A null target marks a duplicate that must be dropped.
LAYOUTS: dict[int, list[tuple[str, str, str | None]]] = {
    2015: [
        ("area", "area", "AREA"), ("area_title", "area_title", "AREA_TITLE"),
        ("area_type", "area_type", "AREA_TYPE"), ("occ code", "occ_code", "OCC_CODE"),
        ("occ title", "occ_title", "OCC_TITLE"), ("group", "o_group", "O_GROUP"),
        ("tot_emp", "tot_emp", "TOT_EMP"), ("a_mean", "a_mean", "A_MEAN"), ("annual", "annual", "ANNUAL"),
    ],
    2016: [
        ("AREA", "area", "AREA"), ("AREA_TITLE", "area_title", "AREA_TITLE"),
        ("AREA_TYPE", "area_type", "AREA_TYPE"), ("PRIM_STATE", "prim_state", "PRIM_STATE"),
        ("NAICS", "naics", "NAICS"), ("NAICS_TITLE", "naics_title", "NAICS_TITLE"),
        ("I_GROUP", "i_group", "I_GROUP"), ("OWN_CODE", "own_code", "OWN_CODE"),
        ("OCC_CODE", "occ_code", "OCC_CODE"), ("OCC_TITLE", "occ_title", "OCC_TITLE"),
        ("O_GROUP", "o_group", "O_GROUP"), ("TOT_EMP", "tot_emp", "TOT_EMP"),
        ("A_MEAN", "a_mean", "A_MEAN"), ("ANNUAL", "annual", "ANNUAL"),
    ],
    2017: [
        ("OCC_CODE", "occ_code", "OCC_CODE"), ("OCC_TITLE", "occ_title", "OCC_TITLE"),
        ("GROUP", "o_group", "O_GROUP"), ("AREA", "area", "AREA"), ("AREA_TITLE", "area_title", "AREA_TITLE"),
        ("AREA_TYPE", "area_type", "AREA_TYPE"), ("LOC_Q", "rate", "LOC_QUOTIENT"),
        ("PCT_TOT", "rate", "PCT_TOTAL"), ("TOT_EMP", "tot_emp", "TOT_EMP"), ("A_MEAN", "a_mean", "A_MEAN"),
    ],
    2018: [
        ("Area", "area", "AREA"), ("Area Title*", "area_title", "AREA_TITLE"), ("AREA ", "own_code", None),
        ("Area Type", "area_type", "AREA_TYPE"), ("Occ Code", "occ_code", "OCC_CODE"),
        ("OccTitle", "occ_title", "OCC_TITLE"), ("Total Emp", "tot_emp", "TOT_EMP"),
        ("Annual  Mean", "a_mean", "A_MEAN"),
    ],
    2019: [
        ("area", "area", "AREA"), ("area_title", "area_title", "AREA_TITLE"),
        ("area_type", "area_type", "AREA_TYPE"), ("naics", "naics", "NAICS"), ("i_group", "i_group", "I_GROUP"),
        ("occ_code", "occ_code", "OCC_CODE"), ("occ_title", "occ_title", "OCC_TITLE"),
        ("o_group", "o_group", "O_GROUP"), ("jobs_1000_orig", "rate", "JOBS_1000"),
        ("tot_emp", "tot_emp", "TOT_EMP"), ("a_mean", "a_mean", "A_MEAN"), ("Notes", "notes", "NOTES"),
    ],
    2020: [
        ("Ownership Code", "own_code", "OWN_CODE"), ("AREA", "area", "AREA"),
        ("AREA_TITLE", "area_title", "AREA_TITLE"), ("AREA_TYPE", "area_type", "AREA_TYPE"),
        ("OCC_CODE", "occ_code", "OCC_CODE"), ("OCC_TITLE", "occ_title", "OCC_TITLE"),
        ("O_GROUP", "o_group", "O_GROUP"), ("A_MEAN", "a_mean", "A_MEAN"), ("TOT_EMP", "tot_emp", "TOT_EMP"),
    ],
    2021: [
        ("AREA", "area", "AREA"), ("AREA_TITLE", "area_title", "AREA_TITLE"),
        ("AREA_TYPE", "area_type", "AREA_TYPE"), ("PRIM_STATE", "prim_state", "PRIM_STATE"),
        ("OCC_CODE", "occ_code", "OCC_CODE"), ("OCC_TITLE", "occ_title", "OCC_TITLE"),
        ("O_GROUP", "o_group", "O_GROUP"), ("TOT_EMP", "tot_emp", "TOT_EMP"), ("PCT_RPT", "rate", "PCT_RPT"),
        ("A_MEAN", "a_mean", "A_MEAN"),
    ],
}

FILE_SQL = "'rows_' || CAST(data_year AS STRING) || '_' || lpad(CAST(block AS STRING), 5, '0')"

_written: dict[tuple[str, str, str], str] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, write) -> str:
    """Path of an input of this session, written on first use."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = scratch_path(spark, kind)
        write(path)
        _written[key] = path
    return _written[key]


def survey_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = tables(spark, sf_dir, "orders", "customer", "nation")
    return spark.sql(
        SURVEY_SQL.replace("FROM orders", "FROM {orders} AS orders")
        .replace("JOIN customer", "JOIN {customer} AS customer")
        .replace("JOIN nation", "JOIN {nation} AS nation"),
        orders=orders, customer=customer, nation=nation,
    )


def corpus_root(spark: SparkSession, sf_dir: str) -> str:
    """A CSV corpus, one folder per year with its own header spelling and column order.

    The survey rows are joined once and become lines of text; a task then writes the file of a year and block at a time.
    """
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = None
    for year, layout in LAYOUTS.items():
        cells = F.struct(*[F.col(source).alias(f"c{i}") for i, (_, source, _) in enumerate(layout)])
        lines = (F if lines is None else lines).when(F.col("data_year") == year, F.to_csv(cells, options))
    heads = {year: ",".join(header for header, _, _ in layout) for year, layout in LAYOUTS.items()}

    def write(path: str) -> None:
        def build(table: pa.Table) -> pa.Table:
            table = table.sort_by([("o_orderkey", "ascending")])
            year, block = table.column("data_year")[0].as_py(), int(table.column("block")[0].as_py())
            name = f"rows_{year}_{block:05d}.csv"
            content = "\n".join([heads[year], *table.column("line").to_pylist(), ""]).encode()
            _write_binary(f"{path}/vintage_{year}", name, content)
            return pa.table({"name": [name], "size": [len(content)]})

        rows = survey_rows(spark, sf_dir).where(F.col("data_year").isin(list(LAYOUTS)))
        rows.select("data_year", "block", "o_orderkey", lines.alias("line")).groupBy("data_year", "block").applyInArrow(
            build, "name string, size long").count()

    return _once("corpus", spark, sf_dir, write)


def corpus_heads(spark: SparkSession, sf_dir: str, sample_rows: int = corpus.DEFAULT_SAMPLE_ROWS) -> DataFrame:
    return corpus.read_heads(corpus.scan_corpus(spark, corpus_root(spark, sf_dir)), sample_rows)


def corpus_plan(spark: SparkSession, sf_dir: str) -> corpus.CorpusPlan:
    return corpus.plan_corpus(corpus_heads(spark, sf_dir, sample_rows=0))


def standardized_root(spark: SparkSession, sf_dir: str) -> str:
    """The standardized corpus as Parquet, one directory per source folder."""
    from tallystar.operators.warehouse import write_standardized

    def write(path: str) -> None:
        rows = corpus.standardize(corpus_plan(spark, sf_dir))
        # The folder is also kept as a column, for readers that ignore directory names.
        write_standardized(rows.withColumn("folder", F.col("_source_folder")), path, "folder")

    return _once("standardized", spark, sf_dir, write)


# --- workbooks and archives ---

_MAIN_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(column: int, row: int, value) -> str:
    ref = f"{chr(65 + column)}{row}"
    if value is None:
        return ""
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook with inline strings."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = list(sheets)
        entries = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)
        )
        links = "".join(
            f'<Relationship Id="rId{i}" Type="{_REL_NS}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(names) + 1)
        )
        book.writestr("xl/workbook.xml", f'<workbook {_MAIN_NS} xmlns:r="{_REL_NS}"><sheets>{entries}</sheets></workbook>')
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        )
        for i, name in enumerate(names, 1):
            body = "".join(
                f'<row r="{r}">' + "".join(_cell(c, r, v) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(sheets[name], 1)
            )
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_MAIN_NS}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _write_binary(path: str, name: str, content: bytes) -> None:
    system, inner = arrow_location(path)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/{name}") as out:
        out.write(content)


BOOK_SQL = f"CAST(floor(o_orderkey / {BOOK_ORDERS}) AS INTEGER)"


def _book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.select(
        F.expr(BOOK_SQL).alias("book"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )


def _each_book(spark: SparkSession, sf_dir: str, path: str, make) -> None:
    """Build one file per book; a book holds at most BOOK_ORDERS rows."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        book = int(pdf["book"].iloc[0])
        name, content = make(book, pdf.sort_values("o_orderkey"))
        _write_binary(path, name, content)
        return pd.DataFrame({"name": [name], "size": [len(content)]})

    _book_rows(spark, sf_dir).groupBy("book").applyInPandas(build, "name string, size long").count()


def workbook_root(spark: SparkSession, sf_dir: str) -> str:
    """One workbook per ten thousand orders with a sheet per order status, and one broken file."""

    def make(book: int, pdf: pd.DataFrame):
        sheets = {
            f"Status {status}": [
                [str(r.o_orderkey), r.o_orderpriority, None, float(r.o_totalprice)] for r in part.itertuples()
            ]
            for status, part in pdf.groupby("o_orderstatus")
        }
        return f"book_{book:05d}.xlsx", workbook_bytes(sheets)

    def write(path: str) -> None:
        _each_book(spark, sf_dir, path, make)
        _write_binary(path, "broken.xlsx", b"not a workbook")

    return _once("workbooks", spark, sf_dir, write)


# Headers of the sheets of an order status, and the cells below: key, priority, price, key modulo 1000.
SHEETS = {
    "F": (["AREA", "OCC Code", "TOT_EMP", "A_MEAN", "Note"], ["key", "priority", "rest", "price", "note"]),
    "O": (["occ_code", "area*", "", "a_mean"], ["priority", "key", "rest", "price"]),
    "P": (["Area", "Area", "Total Emp"], ["key", "rest", "rest"]),
}


def titled_workbook_root(spark: SparkSession, sf_dir: str) -> str:
    """One workbook per ten thousand orders with a sheet per order status: empty rows, a header, then the orders.

    Headers differ between sheets; every seventh employment figure is suppressed. Sheets of one book have a bad figure.
    """
    def rows(pdf: pd.DataFrame, cells: list[str]):
        for r in pdf.itertuples():
            rest = r.o_orderkey % 1000
            value = {"key": str(r.o_orderkey), "priority": r.o_orderpriority, "price": float(r.o_totalprice), "note": f"n{rest}",
                     "rest": "**" if r.o_orderkey % 7 == 0 else str(rest)}
            yield [value[c] for c in cells]

    def make(book: int, pdf: pd.DataFrame):
        sheets = {}
        for status, part in pdf.groupby("o_orderstatus"):
            header, cells = SHEETS[status]
            # Sheet P of the first book holds a text where a number should be.
            bad = [["1", "x", "unknown"]] if book == 0 and status == "P" else []
            sheets[f"May 2019 {status}"] = [[None, None], header, [], *rows(part, cells), *bad]
        return f"titled_{book:05d}.xlsx", workbook_bytes(sheets)

    return _once("titled-workbooks", spark, sf_dir, lambda path: _each_book(spark, sf_dir, path, make))


def archive_root(spark: SparkSession, sf_dir: str) -> str:
    """One ZIP per ten thousand orders with nested CSV members per order status, and one broken file."""

    def make(book: int, pdf: pd.DataFrame):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("nested/", "")
            for status, part in pdf.groupby("o_orderstatus"):
                lines = "".join(f"{k}\n" for k in part["o_orderkey"])
                archive.writestr(f"nested/status_{status}.csv", lines)
        return f"bundle_{book:05d}.zip", out.getvalue()

    def write(path: str) -> None:
        _each_book(spark, sf_dir, path, make)
        _write_binary(path, "broken.zip", b"not an archive")

    return _once("archives", spark, sf_dir, write)
