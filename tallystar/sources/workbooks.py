"""Spreadsheet workbooks (OOXML) as rows of cell texts."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.functions.text import path_name, safe_name
from tallystar.operators.headers import default_for, rename_entries
from tallystar.schema import CANONICAL_COLUMNS, METADATA_COLUMNS
from tallystar.tasks import ship_by_value

# --- fixed values: names and codes of the OOXML format ---

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}

# --- end of fixed values ---

_ROW, _CELL, _VALUE, _TEXT = (f"{_MAIN}{name}" for name in ("row", "c", "v", "t"))

ship_by_value(__name__)

_ROWS = "path string, sheet string, row_no int, cells array<string>, error string"
_CHUNK = 2000
_LETTERS = re.compile(r"[A-Z]+")
_places: dict[str, int] = {}  # a sheet has at most 16,384 columns


def _column_index(reference: str) -> int:
    letters = _LETTERS.match(reference).group(0)
    if letters not in _places:
        index = 0
        for letter in letters:
            index = index * 26 + ord(letter) - 64
        _places[letters] = index - 1
    return _places[letters]


def _texts(node) -> str:
    return "".join([t.text or "" for t in node.iter(_TEXT)])


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_texts(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)
    }
    formats = root.find(f"{_MAIN}cellXfs")
    cells = list(formats) if formats is not None else []
    return {i for i, xf in enumerate(cells) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _cell_text(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell)
    value = cell.find(_VALUE)
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "n" and int(cell.get("s", -1)) in dates:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value.text))
        return moment.isoformat(sep=" ") if moment.time() != dt.time() else moment.date().isoformat()
    return value.text


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[int]):
    """Row number and dense cell list of each row, parsed as a stream."""
    with book.open(part) as stream:
        row_no = 0
        for _, node in ElementTree.iterparse(stream):
            if node.tag != _ROW:
                continue
            row_no = int(node.get("r", row_no + 1))
            cells: list[str | None] = []
            for cell in node.iter(_CELL):
                at = _column_index(reference) if (reference := cell.get("r")) else len(cells)
                if at > len(cells):
                    cells.extend([None] * (at - len(cells)))
                cells.append(_cell_text(cell, shared, dates))
            node.clear()
            yield row_no, cells


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")

    def part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    return [(s.get("name"), part(targets[s.get(f"{_REL}id")])) for s in sheets]


_KINDS = {"path": pa.string(), "sheet": pa.string(), "row_no": pa.int32(), "cells": pa.list_(pa.string()), "error": pa.string()}


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.values())], list(_KINDS))


def _workbook_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                book = zipfile.ZipFile(io.BytesIO(content))
                sheets, shared, dates = _sheets(book), _shared_strings(book), _date_styles(book)
            except Exception as error:
                yield _frame([(path, None, None, None, f"Failed to read workbook: {error}")])
                continue
            for sheet, part in sheets:
                rows: list[tuple] = []
                try:
                    # A mark without a row number keeps empty sheets visible.
                    rows.append((path, sheet, None, None, None))
                    for row_no, cells in _sheet_rows(book, part, shared, dates):
                        rows.append((path, sheet, row_no, cells, None))
                        if len(rows) >= _CHUNK:
                            yield _frame(rows)
                            rows = []
                except Exception as error:
                    rows.append((path, sheet, None, None, str(error)))
                if rows:
                    yield _frame(rows)


def list_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """Path and file name of each workbook; no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return listed.select("path", path_name(F.col("path")).alias("file"))


def read_workbooks(spark: SparkSession, path: str | list[str], pattern: str = "*.xlsx") -> DataFrame:
    """Every row of every sheet, plus one mark per sheet and one per failure.

    A workbook cannot be split, so one task decodes it, sheet by sheet in chunks of rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return decode_workbooks(files.select("path", "content"))


def convert_workbooks(spark: SparkSession, path: str | list[str], output: str, pattern: str = "*.xlsx") -> DataFrame:
    """Decode every workbook once into a table at ``output`` and read that table.

    Rows and report both need the whole decoding, so it is kept rather than repeated.
    """
    read_workbooks(spark, path, pattern).write.mode("errorifexists").parquet(output)
    return spark.read.parquet(output)


def decode_workbooks(files: DataFrame) -> DataFrame:
    """As :func:`read_workbooks` for ``path, content`` rows, such as archive members."""
    return files.select("path", "content").mapInArrow(_workbook_rows, _ROWS)


def workbook_rows(decoded: DataFrame) -> DataFrame:
    """``file, sheet, row_no, cells`` of the sheets that decoded as a whole."""
    failed = decoded.where("error IS NOT NULL AND sheet IS NOT NULL").select("path", "sheet").distinct()
    rows = decoded.where("row_no IS NOT NULL").join(failed, ["path", "sheet"], "left_anti")
    return rows.select(path_name(F.col("path")).alias("file"), "path", safe_name(F.col("sheet")).alias("sheet"), "row_no", "cells")


def conversion_report(decoded: DataFrame, with_path: bool = False) -> DataFrame:
    """Per workbook: sheets converted and failed, success, and a message; with its full path if asked for."""
    marks = decoded.where("row_no IS NULL")
    per_sheet = marks.groupBy("path", "sheet").agg(F.max("error").alias("error"))
    opened = F.col("sheet").isNotNull()
    per_file = per_sheet.groupBy("path").agg(
        F.count_if(opened & F.col("error").isNull()).alias("sheets_converted"),
        F.count_if(opened & F.col("error").isNotNull()).alias("sheets_failed"),
        F.max(F.when(~opened, F.col("error"))).alias("open_error"),
        F.slice(F.sort_array(F.collect_list(F.when(opened & F.col("error").isNotNull(), F.col("sheet")))), 1, 3).alias("failed"),
    )
    converted = F.col("sheets_converted").cast("string")
    message = (
        F.when(F.col("open_error").isNotNull(), F.col("open_error"))
        .when(F.col("sheets_failed") == 0, F.concat(converted, F.lit(" sheets converted")))
        .otherwise(
            F.concat(
                converted, F.lit(" converted, "), F.col("sheets_failed").cast("string"), F.lit(" failed | Failed: "),
                F.array_join("failed", ", "),
            )
        )
    )
    return per_file.select(
        *(["path"] if with_path else []),
        path_name(F.col("path")).alias("file"),
        (F.col("open_error").isNull() & (F.col("sheets_failed") == 0)).alias("success"),
        "sheets_converted",
        "sheets_failed",
        message.alias("message"),
    )


def sheet_heads(rows: DataFrame) -> DataFrame:
    """``file_path, header, header_row`` of each sheet: its first row that holds a cell.

    The path is what a file of the sheet would have: a folder named as the workbook, and the sheet's name.
    """
    filled = rows.where(F.exists("cells", lambda c: c.isNotNull() & (c != "")))
    firsts = filled.groupBy("path", "sheet").agg(F.min("row_no").alias("header_row"))
    heads = filled.join(firsts, ["path", "sheet"]).where(F.col("row_no") == F.col("header_row"))
    file_path = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("/"), F.col("sheet"), F.lit(".csv"))
    header = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    return heads.select("path", "sheet", "header_row", file_path.alias("file_path"), header.alias("header"))


def sheet_records(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of sheets as text under canonical names, as ``corpus.read_corpus`` gives the rows of files.

    Each row meets the layout of its sheet in a join; the layout says at which cell each column is. Rows without any
    cell, and those above the header, are left out.
    """
    kept = F.filter(rename_entries(F.col("header")), lambda e: e["kept"])
    planned = heads.withColumn("places", F.map_from_entries(F.transform(kept, lambda e: F.struct(e["canonical"], e["pos"]))))
    found = planned.select(F.explode(F.map_keys("places")).alias("name")).distinct()
    extras = found.where(~F.col("name").isin(["", *CANONICAL_COLUMNS, *METADATA_COLUMNS])).orderBy("name").collect()
    names = [*CANONICAL_COLUMNS, *[row["name"] for row in extras]]
    at = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at("places", n), F.lit(-1)))
    layouts = planned.select("path", "sheet", "header_row", "file_path", F.size("header").alias("width"), at.alias("at"))
    filled = lambda c: c.isNotNull() & (c != "")
    met = rows.join(layouts, ["path", "sheet"]).where((F.col("row_no") > F.col("header_row")) & F.exists("cells", filled))

    def cell(i: int, name: str) -> Column:
        place, default = F.get("at", F.lit(i)), default_for(name) if name in CANONICAL_COLUMNS else None
        value = F.nullif(F.get("cells", place), F.lit(""))
        return (value if default is None else F.when(place < 0, F.lit(default)).otherwise(value)).alias(name)

    beyond = F.exists(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells"), F.lit(1))), filled)
    return met.select(*[cell(i, n) for i, n in enumerate(names)], F.col("file_path").alias("_source_path"), beyond.alias("_too_long"))


def write_sheet_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV directory per workbook and sheet; cells become positional columns."""
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    cells = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)]
    (
        rows.select("file", "sheet", "row_no", *cells)
        .repartitionByRange("file", "sheet", "row_no")
        .sortWithinPartitions("file", "sheet", "row_no")
        .drop("row_no")
        .write.mode(mode)
        .option("escape", '"')
        .partitionBy("file", "sheet")
        .csv(path)
    )
