"""Table jobs over agent message logs: traces, chart specs, plans, sources, answers.

Input is a message table with conversation id, turn, author name and content. JSON inside
the content stays on the JVM: markers are cut out with string functions and read as variants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystar.functions.json_text import (
    CHART_MARKER,
    TRACE_MARKER,
    first_object,
    json_after_marker,
    json_objects_after,
)
from tallystar.functions.text import bind
from tallystar.operators.ordered import first_following, running_number

# --- fixed values: author names in the logs and the texts reported for them ---

PLAN_AUTHORS = ["initial_plan", "replan"]
SQL_AUTHOR = "cortex_researcher"
WEB_AUTHOR = "web_researcher"
CHART_AUTHOR = "chart_generator"
CHART_SUMMARY_AUTHOR = "chart_summarizer"
ANSWER_AUTHOR = "synthesizer"

NO_ANSWER = "No answer generated."
DEFAULT_PLAN = [
    ("1", SQL_AUTHOR, "Query database"),
    ("2", ANSWER_AUTHOR, "Summarize results"),
]
TRACE_ROWS = 10
SOURCE_LIMIT = 5
SNIPPET_CHARS = 200

# --- end of fixed values ---


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _text(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "string")


def trace_entries(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", name: str = "name", content: str = "content"
) -> DataFrame:
    """One row per valid trace entry: ``conv, turn, pos, name, entry`` with ``entry`` a variant.

    SQL and web authors write arrays, of which the objects count; the others write one object.
    """
    known = [*PLAN_AUTHORS, SQL_AUTHOR, WEB_AUTHOR, CHART_AUTHOR, ANSWER_AUTHOR]
    written = messages.where(F.col(name).isin(*known) & F.contains(F.col(content), F.lit(TRACE_MARKER)))
    many = F.col(name).isin(SQL_AUTHOR, WEB_AUTHOR)
    entries = bind(
        F.try_parse_json(json_after_marker(F.col(content), TRACE_MARKER)),
        lambda v: F.when(many, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v)),
    )
    found = written.select(conv, turn, name, F.posexplode(entries).alias("pos", "entry"))
    return found.where(_is_object(F.col("entry")))


def trace_flatten(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    name: str = "name",
    content: str = "content",
    sql_type: str = "survey_database",
) -> DataFrame:
    """Typed data-source rows, numbered per conversation over valid entries only."""
    author, e = F.col(name), F.col("entry")
    is_plan, is_sql, is_web = author.isin(*PLAN_AUTHORS), author == SQL_AUTHOR, author == WEB_AUTHOR
    is_chart, is_answer = author == CHART_AUTHOR, author == ANSWER_AUTHOR

    def or_default(key: str, default: str) -> Column:
        return F.coalesce(_text(e, key), F.lit(default))

    action = (
        F.when(is_plan, F.concat(F.lit("Generated execution plan with "), or_default("steps", "0"), F.lit(" steps")))
        .when(
            is_sql,
            F.coalesce(
                _text(e, "action"),
                F.concat(F.lit("Executed SQL query returning "), or_default("row_count", "0"), F.lit(" rows")),
            ),
        )
        .when(is_web, F.coalesce(_text(e, "action"), F.concat(F.lit("Searched: "), or_default("search_query", ""))))
        .when(is_chart, or_default("action", "Generated chart specifications"))
        .otherwise(or_default("action", "Synthesized final answer"))
    )
    kind = (
        F.when(is_plan, "planning").when(is_sql, sql_type).when(is_web, "web_search")
        .when(is_chart, "chart_generation").otherwise("synthesis")
    )
    numbered = running_number(trace_entries(messages, conv, turn, name, content), [conv], turn, ["pos"], "step")
    row_count = F.try_variant_get(e, "$.row_count", "bigint")
    return numbered.select(
        conv,
        "step",
        F.when(is_plan, "planner").otherwise(author).alias("agent"),
        kind.alias("type"),
        action.alias("action"),
        F.when(is_plan, F.to_json(F.try_variant_get(e, "$.plan", "variant"))).alias("plan"),
        F.when(is_plan, or_default("reasoning_model", "unknown")).alias("reasoning_model"),
        F.when(is_sql, _text(e, "sql")).alias("sql"),
        F.when(is_sql, row_count).alias("row_count"),
        F.when(is_web, _text(e, "search_query")).alias("search_query"),
        F.when(is_chart, F.coalesce(F.try_variant_get(e, "$.chart_count", "bigint"), F.lit(0))).alias("chart_count"),
        F.when(is_answer, F.coalesce(F.try_variant_get(e, "$.answer_length", "bigint"), F.lit(0))).alias(
            "answer_length"
        ),
        F.when(is_answer, F.coalesce(F.try_variant_get(e, "$.included_charts", "boolean"), F.lit(False))).alias(
            "included_charts"
        ),
        F.when(is_chart | is_answer, or_default("model", "unknown")).alias("model"),
        F.when(is_sql | is_web, F.to_json(e)).alias("details"),
    )


def chart_specs(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    name: str = "name",
    content: str = "content",
) -> DataFrame:
    """Every parsable chart spec with its id, or ``chart_<n>`` counted over the conversation."""
    found = (
        messages.where((F.col(name) == CHART_SUMMARY_AUTHOR) & F.contains(F.col(content), F.lit(CHART_MARKER)))
        .select(conv, turn, F.posexplode(json_objects_after(F.col(content), CHART_MARKER)).alias("pos", "spec"))
        .where(F.col("spec").isNotNull())
    )
    given = F.get_json_object("spec", "$.id")
    return running_number(found, [conv], turn, ["pos"], "n").select(
        conv,
        "n",
        F.coalesce(given, F.concat(F.lit("chart_"), F.col("n").cast("string"))).alias("chart_id"),
        F.get_json_object("spec", "$.type").alias("type"),
        F.get_json_object("spec", "$.title").alias("title"),
        "spec",
    )


def chart_counts(messages: DataFrame, content: str = "content") -> DataFrame:
    """Markers per message and the chart types named in it, in order."""
    markers = F.size(F.split(content, CHART_MARKER)) - 1
    types = F.regexp_extract_all(content, F.lit(r'"type":\s*"(\w+)"'), F.lit(1))
    return messages.withColumns({"chart_count": markers, "chart_types": F.array_join(types, ", ")})


def plan_steps(messages: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """One row per plan step; a fixed two-step plan where the message holds no readable one."""
    spoken = F.regexp_replace(content, r"(?s)<think>.*?</think>", "")
    plan_type = "map<string, struct<agent: string, action: string>>"
    default = F.create_map(
        *[
            part
            for step, agent, action in DEFAULT_PLAN
            for part in (F.lit(step), F.struct(F.lit(agent).alias("agent"), F.lit(action).alias("action")))
        ]
    ).cast(plan_type)
    plan = F.coalesce(F.from_json(first_object(spoken), plan_type), default)
    return messages.select(*keys, F.explode(plan).alias("step", "__s")).select(
        *keys, "step", F.col("__s.agent").alias("agent"), F.col("__s.action").alias("action")
    )


def search_sources(results: DataFrame, keys: Sequence[str], observation: str) -> DataFrame:
    """The first five hits of each search, snippets cut, missing fields empty."""
    shape = "struct<results: array<struct<url: string, title: string, content: string>>>"
    hits = F.from_json(observation, shape)["results"]
    exploded = results.select(*keys, F.posexplode(F.slice(hits, 1, SOURCE_LIMIT)).alias("pos", "hit"))
    blank = F.lit("")
    return exploded.select(
        *keys,
        "pos",
        F.coalesce("hit.url", blank).alias("url"),
        F.coalesce("hit.title", blank).alias("title"),
        F.coalesce(F.left("hit.content", F.lit(SNIPPET_CHARS)), blank).alias("snippet"),
    )


def response_assembly(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", name: str = "name", content: str = "content",
    sql_type: str = "survey_database",
) -> DataFrame:
    """The response of each conversation: final answer, ordered data sources and charts, and their counts.

    ``sources`` holds the rows of :func:`trace_flatten` by step, ``charts`` those of :func:`chart_specs` by number.
    """
    is_answer = F.col(name) == ANSWER_AUTHOR
    # Other messages are cut down to their conversation before rows are sorted for max_by.
    answers = messages.select(
        conv, F.when(is_answer, F.col(content)).alias("__text"), F.when(is_answer, F.col(turn)).alias("__turn")
    )
    last = F.nullif(F.max_by("__text", "__turn"), F.lit(""))
    base = answers.groupBy(conv).agg(F.coalesce(last, F.lit(NO_ANSWER)).alias("answer"))

    def gathered(rows: DataFrame, as_name: str) -> DataFrame:
        fields = F.struct(*[c for c in rows.columns if c != conv])
        return rows.groupBy(conv).agg(F.sort_array(F.collect_list(fields)).alias(as_name))

    sources = gathered(trace_flatten(messages, conv, turn, name, content, sql_type), "sources")
    charts = gathered(chart_specs(messages, conv, turn, name, content), "charts")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    joined = base.join(charts, conv, "left").join(sources, conv, "left")
    return joined.withColumns({"chart_count": count("charts"), "source_count": count("sources")})


def pair_calls(
    messages: DataFrame,
    group: Sequence[str],
    turn: str,
    is_call: Column,
    is_response: Column,
    payload: Sequence[str],
) -> DataFrame:
    """Each call with the first later response of its group (e.g. conversation and call id)."""
    paired = first_following(messages, group, turn, is_response, payload, "response", is_call)
    return paired.where(F.col("response").isNotNull())


def sql_traces(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    call_id: str = "call_id",
    args: str = "args",
    content: str = "content",
) -> DataFrame:
    """One row per SQL call whose first later response with its call id was a success.

    A call is a message with ``args`` (an object with ``sql`` and, as text, ``params``), a response one without.
    Row count, truncation and statistics are the response's own; unreadable parameters are an empty list,
    an unreadable response gives no row. At most ten rows are kept, as objects by column name.
    """
    is_call = F.col(args).isNotNull()
    paired = pair_calls(messages, [conv, call_id], turn, is_call, ~is_call, [content])
    reply, asked = F.try_parse_json(F.col("response")[content]), F.try_parse_json(F.col(args))
    read = paired.select(conv, turn, reply.alias("reply"), asked.alias("asked")).where(
        F.try_variant_get("reply", "$.success", "boolean"))
    listed = lambda key: F.try_variant_get("reply", f"$.{key}", "array<array<variant>>")
    rows = F.coalesce(F.when(F.size(listed("data")) > 0, listed("data")), listed("sample_data"),
                      F.array().cast("array<array<variant>>"))
    names = F.coalesce(F.try_variant_get("reply", "$.columns", "array<string>"), F.array().cast("array<string>"))
    params = F.try_parse_json(F.try_variant_get("asked", "$.params", "string"))

    def named(row: Column) -> Column:
        both = F.least(F.size(names), F.size(row))
        return F.map_from_arrays(F.slice(names, F.lit(1), both), F.slice(row, F.lit(1), both))

    sample = F.when(F.size(names) > 0, F.transform(F.slice(rows, 1, TRACE_ROWS), named))
    return read.select(
        conv,
        turn,
        F.coalesce(F.try_variant_get("asked", "$.sql", "string"), F.lit("")).alias("sql"),
        F.coalesce(F.to_json(params), F.lit("[]")).alias("params"),
        F.coalesce(F.try_variant_get("reply", "$.row_count", "bigint"), F.size(rows).cast("bigint")).alias("row_count"),
        F.coalesce(F.to_json(sample), F.lit("[]")).alias("sample_data"),
        F.to_json(F.try_variant_get("reply", "$.stats", "variant")).alias("stats"),
        F.coalesce(F.try_variant_get("reply", "$.truncated", "boolean"), F.lit(False)).alias("truncated"),
    )


def sql_trace(sql: str, params: Sequence | None, preview: Sequence[dict], row_count: int, stats: dict | None,
              truncated: bool = False) -> dict:
    """Record of one executed statement; at most ten sample rows, ``truncated`` only if true."""
    trace = {
        "sql": sql,
        "params": list(params or []),
        "row_count": row_count,
        "sample_data": list(preview[:TRACE_ROWS]),
        "stats": stats or None,
    }
    return trace | {"truncated": True} if truncated else trace
