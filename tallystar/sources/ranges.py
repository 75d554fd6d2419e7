"""CSV files of many layouts read by byte ranges.

A manifest has one row per range of a file: path, bounds, whether the range starts inside a quoted field, and where the
file has each column. Ranges are dealt to tasks by a shuffle of these rows, so paths never reach the driver, many small
files share a task, and a large file is read by many. A record belongs to the range in which its first byte lies.

Whether a range starts inside quotes follows from the number of quotes before it, which is counted only in files of more
than one range. This holds for files that quote as RFC 4180 does; where unquoted fields hold quotes, read files whole
(``split_bytes=None``) or say that no field holds a line break (``multi_line=False``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystar.session import scratch_path
from tallystar.sources.paths import open_bytes
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

SPLIT_BYTES = 64 << 20
OPENING_SHARE = 32
BATCH_ROWS = 8192
_PIECE = 1 << 20
_ENDED = re.compile(r"[^\r]*\r\n?|[^\r]+")


@dataclass(frozen=True)
class Manifest:
    """The written table of ranges, the number of tasks to read them in, and how to open a file."""

    ranges: DataFrame
    tasks: int
    multi_line: bool
    open_file: object


def _count_quotes(open_file):
    def run(batches):
        for batch in batches:
            found = []
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file_path", "start", "stop"))):
                quotes = 0
                with open_file(path) as stream:
                    stream.seek(start)
                    while start < stop and (piece := stream.read(min(_PIECE, stop - start))):
                        quotes += piece.count(b'"')
                        start += len(piece)
                found.append(quotes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_path"), batch.column("start"), pa.array(found, pa.int64())], ["file_path", "start", "quotes"])
    return run


def plan_ranges(files: DataFrame, split_bytes: int | None = SPLIT_BYTES, multi_line: bool = True,
                open_file=open_bytes) -> Manifest:
    """The manifest of files given as (file_path, size_bytes, places), ``places`` a map from column to cell number."""
    spark = files.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    step = F.lit(split_bytes).cast("long") if split_bytes else F.greatest(F.col("size_bytes"), F.lit(1))
    cut = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size_bytes") - 1, F.lit(0)), step)))
    cut = cut.withColumn("stop", F.least(F.col("start") + step, F.col("size_bytes")))
    if multi_line and split_bytes:
        long_files = cut.where(F.col("size_bytes") > split_bytes).select("file_path", "start", "stop")
        counted = long_files.repartition(4 * parallel).mapInArrow(
            _count_quotes(open_file), "file_path string, start long, quotes long")
        before = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        inside = counted.select("file_path", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("quoted"))
        cut = cut.join(inside, ["file_path", "start"], "left")
    else:
        cut = cut.withColumn("quoted", F.lit(False))
    path = scratch_path(spark, "manifest")
    cut.withColumn("quoted", F.coalesce("quoted", F.lit(False))).write.parquet(path)
    ranges = spark.read.parquet(path)
    # Opening a file costs as much as reading a share of a range.
    aim = split_bytes or SPLIT_BYTES
    cost = ranges.agg(F.sum(F.col("stop") - F.col("start") + aim // OPENING_SHARE)).first()[0] or 0
    tasks = max(parallel, -(-cost // aim))
    return Manifest(ranges, tasks, multi_line, open_file)


def _lines_from(stream, start: int, quoted: bool, multi_line: bool) -> int:
    """Where the first record at or after ``start`` begins."""
    if start == 0:
        return 0
    stream.seek(start - 1)
    if stream.read(1) == b"\n" and not quoted:
        return start
    at = start
    while line := stream.readline():
        at += len(line)
        quoted ^= multi_line and line.count(b'"') % 2 == 1
        if not quoted and line.endswith(b"\n"):
            break
    return at


def range_records(stream, start: int, stop: int, quoted: bool, multi_line: bool) -> Iterator[list]:
    """The records that begin in a range, the first of a file left out; empty cells without quotes are null."""
    import csv
    import sys

    csv.field_size_limit(sys.maxsize)
    at = _lines_from(stream, start, quoted, multi_line)
    stream.seek(at)
    between = True

    def lines():
        nonlocal at, between
        while not (between and at >= stop) and (line := stream.readline()):
            between = False
            at += len(line)
            text = line.decode("utf-8", "replace")
            # A lone carriage return ends a line too.
            yield from _ENDED.findall(text) if "\r" in text[:-2] else (text,)

    def records():
        nonlocal between
        if multi_line:
            told = csv.reader(lines(), quoting=csv.QUOTE_NOTNULL)
            while (record := next(told, None)) is not None:
                between = True
                yield record
        else:
            for line in lines():
                between = True
                yield from csv.reader([line.rstrip("\r\n")], quoting=csv.QUOTE_NOTNULL)

    found = records()
    if start == 0:
        next(found, None)
    return (record for record in found if record)


def _columns(rows: list[list], width: int, path: str, places: Mapping[str, int], names: Sequence[str],
             defaults: Mapping[str, str]) -> list[pa.Array]:
    """Cells of records as columns, then the path, and whether a cell lies beyond the header."""
    long = [len(r) > width and any(c is not None for c in r[width:]) for r in rows]
    cells = list(zip(*(r if len(r) == width else (r + [None] * width)[:width] for r in rows)))
    none = pa.nulls(len(rows), pa.string())
    picked = [pa.array(cells[places[n]], pa.string()) if n in places else pa.repeat(defaults[n], len(rows)) if n in defaults else none
              for n in names]
    return [*picked, pa.repeat(path, len(rows)), pa.array(long, pa.bool_())]


def _reader(names: Sequence[str], defaults: Mapping[str, str], multi_line: bool, open_file):
    import io

    labels = [f"c{i}" for i in range(len(names) + 2)]

    def run(batches):
        for batch in batches:
            wanted = ("file_path", "start", "stop", "quoted", "width", "places")
            for path, start, stop, quoted, width, places in zip(*(batch.column(c).to_pylist() for c in wanted)):
                with open_file(path) as opened:
                    stream = io.BufferedReader(opened, _PIECE)
                    rows, held = [], 0
                    for record in range_records(stream, start, stop, quoted, multi_line):
                        rows.append(record)
                        held += sum(map(len, filter(None, record)))
                        if len(rows) >= BATCH_ROWS or held > 8 * _PIECE:
                            yield pa.RecordBatch.from_arrays(_columns(rows, width, path, dict(places), names, defaults), labels)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays(_columns(rows, width, path, dict(places), names, defaults), labels)
    return run


def read_ranges(manifest: Manifest, names: Sequence[str], defaults: Mapping[str, str]) -> DataFrame:
    """All records as text columns ``names``, then ``_source_path`` and ``_too_long``.

    A column that a file lacks has its default, or null. A cell that a record lacks is null.
    """
    schema = ", ".join([f"c{i} string" for i in range(len(names) + 1)] + [f"c{len(names) + 1} boolean"])
    dealt = manifest.ranges.repartition(manifest.tasks)
    read = dealt.mapInArrow(_reader(list(names), dict(defaults), manifest.multi_line, manifest.open_file), schema)
    return read.toDF(*names, "_source_path", "_too_long")
