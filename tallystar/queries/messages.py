"""Message-log queries: conversations carrying traces, chart specs and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystar.functions.json_text import TRACE_MARKER, json_after_marker
from tallystar.functions.text import mask_sensitive, within_length
from tallystar.operators import traces
from tallystar.queries.tables import Query, table, tables

_KEY = "CAST(conv_id AS STRING)"
_TURN = "CAST(turn AS STRING)"
_NAME = """CASE (conv_id + turn) % 7 WHEN 0 THEN 'initial_plan' WHEN 1 THEN 'cortex_researcher'
  WHEN 2 THEN 'web_researcher' WHEN 3 THEN 'chart_generator' WHEN 4 THEN 'chart_summarizer'
  WHEN 5 THEN 'synthesizer' ELSE 'user' END"""
_BROKEN = "conv_id % 10 = 3"
_TRACE = f"""CASE WHEN {_BROKEN} THEN '{{invalid json here}}' ELSE CASE (conv_id + turn) % 7
  WHEN 0 THEN '{{"plan": {{"1": {{"agent": "a}}b"}}}}, "reasoning_model": "m' || {_KEY} || '", "steps": ' || {_TURN} || '}}'
  WHEN 1 THEN '[{{"sql": "SELECT ' || {_KEY} || '", "params": [], "row_count": ' || {_TURN} || '}}, "text", {{"sql": "SELECT 2"}}]'
  WHEN 2 THEN '[{{"search_query": "q' || {_KEY} || '", "sources": []}}]'
  WHEN 3 THEN '{{"action": "Made charts", "chart_count": 2}}'
  WHEN 5 THEN '{{"answer_length": ' || CAST(length(text) AS STRING) || ', "included_charts": true, "model": "m"}}'
  ELSE '{{"ignored": 1}}' END END"""
_CHARTS = f"""CASE WHEN (conv_id + turn) % 7 <> 4 THEN '' ELSE 'CHART_SPEC: {{"type": "bar", "title": "T' || {_KEY}
  || '"}} then CHART_SPEC: {{"id": "given", "type": "line", "title": "x {{y"}} CHART_SPEC: {{broken ' END"""
_CONTENT = f"text || chr(10) || {_CHARTS} || 'EXECUTION_TRACE: ' || {_TRACE} || ' trailing {{text'"


def agent_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.expr(_NAME).alias("name"), "text", F.expr(_CONTENT).alias("content"))


def json_after_marker_query(spark, sf_dir):
    found = json_after_marker(F.col("content"), TRACE_MARKER)
    return agent_messages(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.get_json_object(found, "$.steps").cast("bigint").alias("steps"),
        F.get_json_object(found, "$[0].sql").alias("first_sql"),
        found.isNotNull().alias("found"),
    )


def trace_flatten(spark, sf_dir):
    return traces.trace_flatten(agent_messages(spark, sf_dir)).drop("plan", "details")


def chart_specs(spark, sf_dir):
    return traces.chart_specs(agent_messages(spark, sf_dir)).select("conv_id", "n", "chart_id", "type", "title")


def chart_counts(spark, sf_dir):
    return traces.chart_counts(agent_messages(spark, sf_dir)).select(
        "conv_id", "turn", "chart_count", "chart_types"
    )


def response_assembly(spark, sf_dir):
    """Answer and counts, and the ordered sources and charts as one text each."""
    made = traces.response_assembly(agent_messages(spark, sf_dir))
    source = lambda s: F.concat_ws(" ", s["step"], s["agent"], s["type"], s["action"], s["sql"])
    chart = lambda c: F.concat_ws(" ", c["n"], c["chart_id"], c["type"], c["title"])
    return made.select(
        "conv_id", "answer", "chart_count", "source_count",
        F.array_join(F.transform("sources", source), "; ").alias("sources"),
        F.array_join(F.transform("charts", chart), "; ").alias("charts"))


def pair_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    paired = traces.pair_calls(
        rows, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant", ["text"]
    )
    return paired.select(
        "conv_id",
        F.col("turn").alias("call_turn"),
        F.col("response.turn").alias("response_turn"),
        F.col("response.text").alias("response_text"),
    )


# A user turn calls, the assistant turn after it answers; every form of answer occurs.
_CALL = f"""CASE WHEN role = 'user' THEN '{{"sql": "SELECT ' || {_KEY} || '", "params": ' ||
  CASE conv_id % 3 WHEN 0 THEN '"[1,2]"' WHEN 1 THEN '""' ELSE '"broken ["' END || '}}' END"""
_ANSWER = f"""CASE WHEN role = 'assistant' THEN CASE conv_id % 5
  WHEN 0 THEN '{{"success": true, "columns": ["a", "b"], "data": [[' || {_TURN} || ', "x"], [2, "y"]], "row_count": 2}}'
  WHEN 1 THEN '{{"success": true, "truncated": true, "columns": ["a"], "sample_data": [[5]], "row_count": ' || CAST(5000 + turn AS STRING)
    || ', "stats": {{"a": {{"min": 1}}}}}}'
  WHEN 2 THEN '{{"success": false, "error": "x"}}' WHEN 3 THEN '{{broken' ELSE '{{"success": true, "data": [[1], [2], [3]]}}' END END"""


def sql_traces(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    calls = F.col("turn") - F.when(F.col("role") == "assistant", 1).otherwise(0)
    messages = rows.select("conv_id", "turn", calls.cast("string").alias("call_id"), F.expr(_CALL).alias("args"),
                           F.expr(_ANSWER).alias("content"))
    return traces.sql_traces(messages)


_PLAN = f"""CASE WHEN conv_id % 4 = 0 THEN text ELSE '<think>maybe {{"9": 1}}' || chr(10) || '</think>Plan: {{"1": {{"agent": "a'
  || {_KEY} || '", "action": "look up {{"}}, "2": {{"agent": "synthesizer", "action": "turn ' || {_TURN} || '"}}}} done' END"""


def plan_steps(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_PLAN).alias("content"))
    return traces.plan_steps(rows, ["conv_id", "turn"])


def search_sources(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hits = F.transform(
        F.sequence(F.lit(0), (F.col("page_id") % 8).cast("int")),
        lambda i: F.struct(
            F.concat("url", F.lit("#"), i.cast("string")).alias("url"),
            F.when(i % 2 == 0, F.col("url")).alias("title"),
            F.col("html").alias("content"),
        ),
    )
    observed = pages.select("page_id", F.to_json(F.struct(hits.alias("results"))).alias("observation"))
    return traces.search_sources(observed, ["page_id"], "observation")


def length_gate(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", within_length(F.col("text")).alias("valid"))


def mask_sensitive_query(spark, sf_dir):
    documents, pages = tables(spark, sf_dir, "documents", "pages")
    messages = documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("m"))
    messages = messages.unionByName(
        pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("m"))
    )
    return messages.select("id", mask_sensitive(F.col("m")).alias("message"))


_WORDS = "password|api_key|secret|token|credential|postgres://|mysql://|mongodb://|://|bearer |authorization|api-key"
_LOG = f"WITH log AS (SELECT conv_id, turn, text, {_CONTENT} AS content, {_NAME} AS name, {_BROKEN} AS broken FROM conversations)"
_ENTRIES = f"""{_LOG}, entries AS (
  SELECT conv_id, turn, text, name, unnest(CASE WHEN name = 'cortex_researcher' THEN [0, 2] ELSE [0] END) AS pos
  FROM log WHERE NOT broken
    AND name IN ('initial_plan', 'cortex_researcher', 'web_researcher', 'chart_generator', 'synthesizer'))"""

QUERIES = {
    "json_after_marker": Query(
        json_after_marker_query,
        f"""{_LOG} SELECT conv_id, turn,
        CASE WHEN NOT broken AND name = 'initial_plan' THEN turn END AS steps,
        CASE WHEN NOT broken AND name = 'cortex_researcher' THEN 'SELECT ' || CAST(conv_id AS VARCHAR) END AS first_sql,
        NOT broken AS found FROM log""",
    ),
    "trace_flatten": Query(
        trace_flatten,
        f"""{_ENTRIES}
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS INTEGER) AS step,
          CASE name WHEN 'initial_plan' THEN 'planner' ELSE name END AS agent,
          CASE name WHEN 'initial_plan' THEN 'planning' WHEN 'cortex_researcher' THEN 'survey_database'
            WHEN 'web_researcher' THEN 'web_search' WHEN 'chart_generator' THEN 'chart_generation' ELSE 'synthesis' END AS type,
          CASE name WHEN 'initial_plan' THEN 'Generated execution plan with ' || turn || ' steps'
            WHEN 'cortex_researcher' THEN 'Executed SQL query returning ' || CASE pos WHEN 0 THEN turn ELSE 0 END || ' rows'
            WHEN 'web_researcher' THEN 'Searched: q' || conv_id WHEN 'chart_generator' THEN 'Made charts'
            ELSE 'Synthesized final answer' END AS action,
          CASE name WHEN 'initial_plan' THEN 'm' || conv_id END AS reasoning_model,
          CASE name WHEN 'cortex_researcher' THEN 'SELECT ' || CASE pos WHEN 0 THEN conv_id ELSE 2 END END AS sql,
          CASE WHEN name = 'cortex_researcher' AND pos = 0 THEN turn END AS row_count,
          CASE name WHEN 'web_researcher' THEN 'q' || conv_id END AS search_query,
          CASE name WHEN 'chart_generator' THEN CAST(2 AS BIGINT) END AS chart_count,
          CASE name WHEN 'synthesizer' THEN CAST(length(text) AS BIGINT) END AS answer_length,
          CASE name WHEN 'synthesizer' THEN true END AS included_charts,
          CASE name WHEN 'chart_generator' THEN 'unknown' WHEN 'synthesizer' THEN 'm' END AS model
        FROM entries""",
    ),
    "sql_traces": Query(
        sql_traces,
        """SELECT u.conv_id, u.turn, 'SELECT ' || u.conv_id AS sql, CASE u.conv_id % 3 WHEN 0 THEN '[1,2]' ELSE '[]' END AS params,
          CASE u.conv_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 5000 + a.turn ELSE 3 END::BIGINT AS row_count,
          CASE u.conv_id % 5 WHEN 0 THEN '[{"a":' || a.turn || ',"b":"x"},{"a":2,"b":"y"}]' WHEN 1 THEN '[{"a":5}]' ELSE '[]' END AS sample_data,
          CASE WHEN u.conv_id % 5 = 1 THEN '{"a":{"min":1}}' END AS stats, u.conv_id % 5 = 1 AS truncated
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant' AND u.conv_id % 5 IN (0, 1, 4)""",
    ),
    "chart_specs": Query(
        chart_specs,
        f"""{_LOG}, charts AS (SELECT conv_id, turn, unnest([0, 1]) AS pos FROM log WHERE name = 'chart_summarizer'),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS n FROM charts)
        SELECT conv_id, CAST(n AS INTEGER) AS n, CASE pos WHEN 0 THEN 'chart_' || n ELSE 'given' END AS chart_id,
          CASE pos WHEN 0 THEN 'bar' ELSE 'line' END AS type,
          CASE pos WHEN 0 THEN 'T' || conv_id ELSE 'x {{y' END AS title FROM numbered""".replace("{{y", "{y"),
    ),
    "chart_counts": Query(
        chart_counts,
        f"""{_LOG} SELECT conv_id, turn, CASE name WHEN 'chart_summarizer' THEN 3 ELSE 0 END AS chart_count,
        CASE name WHEN 'chart_summarizer' THEN 'bar, line' ELSE '' END AS chart_types FROM log""",
    ),
    "pair_calls": Query(
        pair_calls,
        """SELECT u.conv_id, u.turn AS call_turn, min(a.turn) AS response_turn, arg_min(a.text, a.turn) AS response_text
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn
        WHERE u.role = 'user' GROUP BY u.conv_id, u.turn""",
    ),
    "plan_steps": Query(
        plan_steps,
        """SELECT conv_id, turn, unnest(['1', '2']) AS step,
        unnest(CASE WHEN conv_id % 4 = 0 THEN ['cortex_researcher', 'synthesizer'] ELSE ['a' || conv_id, 'synthesizer'] END) AS agent,
        unnest(CASE WHEN conv_id % 4 = 0 THEN ['Query database', 'Summarize results'] ELSE ['look up {', 'turn ' || turn] END) AS action
        FROM conversations""",
    ),
    "search_sources": Query(
        search_sources,
        """SELECT page_id, CAST(pos AS INTEGER) AS pos, url || '#' || pos AS url,
        CASE WHEN pos % 2 = 0 THEN url ELSE '' END AS title, left(html, 200) AS snippet
        FROM (SELECT *, unnest(range(least(page_id % 8 + 1, 5))) AS pos FROM pages)""",
    ),
    "length_gate": Query(length_gate, "SELECT doc_id, length(text) BETWEEN 3 AND 500 AS valid FROM documents"),
    "mask_sensitive": Query(
        mask_sensitive_query,
        f"""SELECT id, CASE WHEN regexp_matches(lower(m), '{_WORDS}') THEN 'An internal error occurred during query processing.'
        ELSE 'Workflow execution failed: ' || CASE WHEN length(m) > 200 THEN left(m, 200) || '...' ELSE m END END AS message
        FROM (SELECT 'd' || doc_id AS id, text AS m FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages)""",
    ),
}

_FLAT, _SPECS = QUERIES["trace_flatten"].oracle, QUERIES["chart_specs"].oracle
QUERIES["response_assembly"] = Query(
    response_assembly,
    f"""{_LOG},
    answers AS (SELECT conv_id, coalesce(arg_max(content, turn) FILTER (name = 'synthesizer'), 'No answer generated.') AS answer
      FROM log GROUP BY conv_id),
    sources AS (SELECT conv_id, count(*) AS n, string_agg(concat_ws(' ', step, agent, type, action, sql), '; ' ORDER BY step) AS sources
      FROM ({_FLAT}) GROUP BY conv_id),
    specs AS (SELECT conv_id, count(*) AS m, string_agg(concat_ws(' ', n, chart_id, type, title), '; ' ORDER BY n) AS charts
      FROM ({_SPECS}) GROUP BY conv_id)
    SELECT conv_id, answer, coalesce(m, 0) AS chart_count, coalesce(n, 0) AS source_count, sources, charts
    FROM answers LEFT JOIN sources USING (conv_id) LEFT JOIN specs USING (conv_id)""",
)
