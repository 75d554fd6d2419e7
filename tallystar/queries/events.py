"""Log and stream queries: events written as JSON log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystar.operators import logs
from tallystar.queries import inputs
from tallystar.queries.files import _STANDARD_SQL
from tallystar.queries.tables import Query, table
from tallystar.session import scratch_path
from tallystar.streaming import jobs

_ID = "CAST(event_id AS STRING)"
_DAY = "CAST(CAST(ts AS DATE) AS STRING)"
_SQL = f"'SELECT value FROM events WHERE user_id = ' || CAST(user_id AS STRING) || ' AND event_id > ' || {_ID}"
_COMPONENT = "CASE WHEN event_id % 2 = 0 THEN 'app.text2sql.agent' ELSE 'app.planner' END"
_EVENT = """CASE event_id % 6 WHEN 0 THEN 'agent_input' WHEN 1 THEN 'sql_generated' WHEN 2 THEN 'query_results'
  WHEN 3 THEN 'planner_output' WHEN 4 THEN 'sql_generated' ELSE event_type END"""
_DATA = f"""CASE event_id % 6
  WHEN 0 THEN ', "data": {{"query": "value of ' || {_ID} || '"}}'
  WHEN 2 THEN ', "data": {{"success": true, "row_count": ' || CAST(user_id AS STRING) || ', "result_preview": "p' || {_ID} || '"}}'
  WHEN 3 THEN ', "data": {{"plan": {{"1": {{"agent": "a"}}, "2": {{"agent": "b"}}}}}}'
  WHEN 5 THEN '' ELSE ', "data": {{"sql": "' || {_SQL} || '"}}' END"""
_BLANK, _BAD = "event_id % 53 = 0", "event_id % 37 = 5"
_LINE = f"""CASE WHEN {_BLANK} THEN '  ' WHEN {_BAD} THEN '{{"timestamp": broken ' || {_ID}
  ELSE '  {{"timestamp": "' || {_DAY} || '", "level": "DEBUG", "component": "' || {_COMPONENT} || '", "event": "'
    || {_EVENT} || '"' || {_DATA} || '}}' END"""


def log_lines_of(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"), "user_id", F.expr(_LINE).alias("line")
    )


def log_lines(spark, sf_dir):
    return logs.parse_log_lines(log_lines_of(spark, sf_dir)).drop("data")


def log_tail(spark, sf_dir):
    return logs.parse_log_lines(logs.last_lines(log_lines_of(spark, sf_dir), 200)).select("line_no", "event")


def log_files_tail(spark, sf_dir):
    """The last lines of a log of three files of very unequal size, as written to disk."""
    base = scratch_path(spark, "log-files")
    numbered = log_lines_of(spark, sf_dir).select(
        "line_no", F.concat(F.col("line_no").cast("string"), F.lit(" "), F.col("line")).alias("value"))
    last = numbered.agg(F.max("line_no").alias("last")).scalar()
    part = F.when(F.col("line_no") < 7, "a").when(F.col("line_no") <= last - 5, "b").otherwise("c")
    for name in ("a", "b", "c"):
        numbered.where(part == name).repartitionByRange(1 if name != "b" else 4, "line_no").sortWithinPartitions(
            "line_no").select("value").write.text(f"{base}/{name}")
    lines = logs.last_lines(logs.read_log_text(spark, [f"{base}/{name}" for name in ("a", "b", "c")]), 300)
    return lines.select(F.substring_index("line", " ", 1).cast("long").alias("line_no"), F.length("line").alias("chars"))


def log_quarantine(spark, sf_dir):
    return logs.malformed_lines(log_lines_of(spark, sf_dir)).select("line_no", "preview")


def log_summary(spark, sf_dir):
    return logs.log_summary(logs.parse_log_lines(log_lines_of(spark, sf_dir))).drop("user_id")


def log_events(spark, sf_dir):
    return logs.log_events(logs.parse_log_lines(log_lines_of(spark, sf_dir))).drop("user_id", "component")


def sql_compare(spark, sf_dir):
    # Lines without the event's name need no parsing.
    named = log_lines_of(spark, sf_dir).where(F.contains(F.col("line"), F.lit(logs.SQL_EVENT)))
    entries = logs.parse_log_lines(named)
    expected = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    expected = expected.select(
        "user_id",
        F.concat(
            F.lit("  SELECT value FROM events WHERE user_id = "), F.col("user_id").cast("string"),
            F.lit(" AND event_id > "), F.col("first_id").cast("string"),
        ).alias("expected_sql"),
    )
    return logs.sql_compare(entries, ["user_id"], expected).drop("expected_sql")


def quota_windows(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("ts", "event_type")
    over = jobs.quota_windows(hits, "ts", "event_type", limit=6)
    return over.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def quota_stream(spark, sf_dir):
    """The windows of ``quota_windows`` from a stream that stops and goes on from its checkpoint.

    The first half of the hits, the second half delivered twice, one hit far ahead that closes all windows, and the
    first half again under other ids, which is too late to count.
    """
    hits = table(spark, sf_dir, "events").select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    base = scratch_path(spark, "quota-stream")
    first, last = hits.agg(F.min("ts"), F.max("ts")).first()
    early = hits.where(F.col("ts") < F.lit(first + (last - first) / 2))
    rest = hits.where(F.col("ts") >= F.lit(first + (last - first) / 2))
    ahead = hits.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.lit(last) + F.expr("INTERVAL 30 DAYS")})
    late = early.withColumn("event_id", -F.col("event_id") - 2)
    for step, parts in enumerate([[early], [rest, rest], [ahead], [late]]):
        for copy, part in enumerate(parts):
            part.write.parquet(f"{base}/in/{step}-{copy}")
        stream = spark.readStream.schema(hits.schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        jobs.stream_quota(stream, f"{base}/out", f"{base}/checkpoint", time="ts", key="event_type", limit=6,
                          lateness="10 minutes", unique="event_id")
    over = spark.read.parquet(f"{base}/out")
    return over.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def stream_load(spark, sf_dir):
    source = inputs.standardized_root(spark, sf_dir)
    base = scratch_path(spark, "stream-load")
    schema = spark.read.option("recursiveFileLookup", True).parquet(source).schema
    renamed = {"_data_year": "SURVEY_YEAR", "_source_file": "SOURCE_FILE", "_source_folder": "SOURCE_FOLDER"}
    jobs.stream_load(
        spark, source, schema, f"{base}/rows", f"{base}/audit", f"{base}/checkpoint", renamed=renamed
    )
    audit = spark.read.parquet(f"{base}/audit")
    # Source files may be split over several Parquet files, so their parts are added up.
    return audit.groupBy("SOURCE_FILE", "SOURCE_FOLDER", "SURVEY_YEAR").agg(F.sum("ROW_COUNT").alias("ROW_COUNT"))


def stream_logs(spark, sf_dir):
    base = scratch_path(spark, "stream-logs")
    lines = log_lines_of(spark, sf_dir)
    lines.select("line").write.text(f"{base}/source")
    jobs.stream_logs(spark, f"{base}/source", f"{base}/rows", f"{base}/bad", f"{base}/checkpoint")
    parsed = spark.read.parquet(f"{base}/rows").groupBy("event").agg(F.count(F.lit(1)).alias("lines"))
    bad = spark.read.parquet(f"{base}/bad").agg(F.count(F.lit(1)).alias("lines"))
    return parsed.unionByName(bad.select(F.lit("(malformed)").alias("event"), "lines"))


_ROWS = f"""WITH rows AS (
  SELECT *, {_COMPONENT} AS component, {_EVENT} AS event, {_SQL} AS sql FROM events WHERE NOT ({_BLANK}) AND NOT ({_BAD})
)"""
_JSON_SQL = """'{"sql":"' || sql || '"}'"""

_QUOTA_SQL = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS hits
  FROM events GROUP BY ALL HAVING count(*) > 6"""

QUERIES = {
    "log_lines": Query(
        log_lines,
        f"""{_ROWS} SELECT event_id AS line_no, user_id, {_DAY} AS timestamp, 'DEBUG' AS level, component, event FROM rows""",
    ),
    "log_tail": Query(
        log_tail,
        f"""{_ROWS}, kept AS (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200)
        SELECT event_id AS line_no, event FROM rows JOIN kept USING (event_id)""",
    ),
    "log_files_tail": Query(
        log_files_tail,
        f"""SELECT event_id AS line_no, CAST(length({_ID} || ' ' || {_LINE}) AS INTEGER) AS chars
        FROM events ORDER BY event_id DESC LIMIT 300""",
    ),
    "log_quarantine": Query(
        log_quarantine,
        f"""SELECT event_id AS line_no, '{{"timestamp": broken ' || event_id AS preview FROM events
        WHERE {_BAD} AND NOT ({_BLANK})""",
    ),
    "log_summary": Query(
        log_summary,
        f"""{_ROWS} SELECT event_id AS line_no, component, event,
        CASE WHEN length(summary) > 50 THEN left(summary, 47) || '...' ELSE summary END AS summary
        FROM (SELECT *, CASE event_id % 6
          WHEN 0 THEN 'Query: ' || left('value of ' || {_ID}, 50) || '...' WHEN 2 THEN 'Rows: ' || user_id
          WHEN 3 THEN 'Plan: 2 steps' WHEN 5 THEN '{{}}' ELSE 'SQL: ' || left(sql, 50) || '...' END AS summary FROM rows)""",
    ),
    "log_events": Query(
        log_events,
        f"""{_ROWS} SELECT event_id AS line_no, event,
        CASE event WHEN 'agent_input' THEN 'value of ' || event_id END AS query,
        CASE event WHEN 'sql_generated' THEN sql END AS sql,
        CASE event WHEN 'query_results' THEN true END AS success,
        CASE event WHEN 'query_results' THEN user_id END AS row_count,
        CASE WHEN event = 'query_results' AND user_id > 0 THEN 'p' || event_id END AS preview
        FROM rows WHERE component LIKE '%text2sql%'""",
    ),
    "sql_compare": Query(
        sql_compare,
        f"""{_ROWS}, first AS (SELECT user_id, arg_min(sql, event_id) AS actual_sql FROM rows
          WHERE event = 'sql_generated' GROUP BY user_id),
        ids AS (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY user_id)
        SELECT user_id, actual_sql,
          actual_sql = 'SELECT value FROM events WHERE user_id = ' || user_id || ' AND event_id > ' || first_id AS matches
        FROM first JOIN ids USING (user_id)""",
    ),
    "quota_windows": Query(quota_windows, _QUOTA_SQL),
    "quota_stream": Query(quota_stream, _QUOTA_SQL),
    "stream_load": Query(
        stream_load,
        f"""SELECT _source_file AS SOURCE_FILE, _source_folder AS SOURCE_FOLDER, _data_year AS SURVEY_YEAR,
        count(*) AS ROW_COUNT FROM ({_STANDARD_SQL}) GROUP BY ALL""",
    ),
    "stream_logs": Query(
        stream_logs,
        f"""{_ROWS} SELECT event, count(*) AS lines FROM rows GROUP BY event
        UNION ALL SELECT '(malformed)', count(*) FROM events WHERE {_BAD} AND NOT ({_BLANK})""",
    ),
}
