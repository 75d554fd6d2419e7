"""JSON-lines logs: reading, summarising and checking what was run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.functions.text import bind, strip_space

# --- fixed values: log fields and event names ---

AGENT_COMPONENT = "text2sql"
SQL_EVENT = "sql_generated"
SUMMARY_CHARS = 50

# --- end of fixed values ---


def read_log_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text logs with a ``line_no`` that orders them: file, block of the file, place in the block.

    Spark packs blocks into tasks by size, so a row counter alone would not follow the files; within a block it does.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path if isinstance(path, str) else list(path)).select(place.alias("line_no"), F.col("value").alias("line"))


def last_lines(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The ``n`` last lines, blank and broken ones included; a top-k, not a global sort."""
    return lines.orderBy(F.desc(order)).limit(n)


_ENTRY = "array<struct<timestamp: string, level: string, component: string, event: string, data: variant>>"


def _entry(line: str) -> Column:
    """The line's object as a one-element array; null unless the whole line is one object.

    Brackets around the line make text after the object an error; alone it would be ignored.
    """
    parsed = F.from_json(F.concat(F.lit("["), strip_space(F.col(line)), F.lit("]")), _ENTRY)
    return bind(parsed, lambda v: F.when((F.size(v) == 1) & F.get(v, F.lit(0)).isNotNull(), v))


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed log entries; blank and malformed lines are left out.

    The generator reads each line once; a filter on parsed columns would read it again.
    """
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, F.inline(_entry(line)))


def malformed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that :func:`parse_log_lines` leaves out as unreadable, with a short preview."""
    text = strip_space(F.col(line))
    broken = lines.where((text != "") & _entry(line).isNull())
    return broken.withColumn(line, text).withColumn("preview", F.left(line, F.lit(SUMMARY_CHARS)))


def _data(key: str, kind: str = "string") -> Column:
    return F.try_variant_get("data", f"$.{key}", kind)


def _plan_size() -> Column:
    as_map = F.size(F.map_keys(_data("plan", "map<string,variant>")))
    return F.coalesce(F.size(_data("plan", "array<variant>")), as_map)


def log_summary(entries: DataFrame) -> DataFrame:
    """One display text per entry: SQL, row count, query, plan size or the raw data."""
    excerpt = lambda label, k: F.concat(
        F.lit(label), F.left(_data(k), F.lit(SUMMARY_CHARS)), F.lit("...")
    )
    raw = F.left(F.coalesce(F.to_json("data"), F.lit("{}")), F.lit(SUMMARY_CHARS))
    text = F.coalesce(
        excerpt("SQL: ", "sql"),
        F.concat(F.lit("Rows: "), _data("row_count")),
        excerpt("Query: ", "query"),
        F.when(_data("plan", "variant").isNotNull(), F.concat(F.lit("Plan: "), _plan_size(), F.lit(" steps"))),
        raw,
    )
    cut = F.when(
        F.length(text) > SUMMARY_CHARS, F.concat(F.left(text, F.lit(SUMMARY_CHARS - 3)), F.lit("..."))
    ).otherwise(text)
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    rest = [c for c in entries.columns if c not in ("timestamp", "level", "component", "event", "data")]
    return entries.select(*rest, named("component"), named("event"), cut.alias("summary"))


def log_events(entries: DataFrame, component: str = AGENT_COMPONENT) -> DataFrame:
    """Entries of matching components with the fields that belong to their event."""
    rest = [c for c in entries.columns if c not in ("timestamp", "level", "data")]
    on = lambda event, value: F.when(F.col("event") == event, value)
    missing = F.lit("N/A")
    return entries.where(F.contains(F.col("component"), F.lit(component))).select(
        *rest,
        on("agent_input", F.coalesce(_data("query"), missing)).alias("query"),
        on(SQL_EVENT, F.coalesce(_data("sql"), missing)).alias("sql"),
        on("query_results", F.coalesce(_data("success", "boolean"), F.lit(False))).alias("success"),
        on("query_results", F.coalesce(_data("row_count", "bigint"), F.lit(0))).alias("row_count"),
        on(
            "query_results",
            F.when(_data("row_count", "bigint") > 0, F.left(F.coalesce(_data("result_preview"), F.lit("")), F.lit(100))),
        ).alias("preview"),
    )


def sql_compare(entries: DataFrame, run: Sequence[str], expected: DataFrame, order: str = "line_no") -> DataFrame:
    """First generated statement per run against the expected one, compared without outer space."""
    first = (
        entries.where(F.col("event") == SQL_EVENT)
        .groupBy(*run)
        .agg(F.min_by(F.coalesce(_data("sql"), F.lit("")), order).alias("actual_sql"))
    )
    same = strip_space(F.col("actual_sql")) == strip_space(F.col("expected_sql"))
    return first.join(expected, list(run)).withColumn("matches", same)
