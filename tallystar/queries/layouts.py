"""Header and audit queries: every part stands for one file with its own header."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystar.functions.numeric import sanitize_numeric
from tallystar.functions.text import detect_year, normalize_header, safe_name, suppress_text
from tallystar.operators import headers, profile, warehouse
from tallystar.queries.tables import Query, table, tables
from tallystar.schema import ALIAS_TO_CANONICAL, CANONICAL_COLUMNS

# One raw header per part; the same text is valid in both dialects.
_RAW_HEADER = """CASE p_partkey % 8
  WHEN 0 THEN ' Area Title* ' WHEN 1 THEN 'occ code' WHEN 2 THEN upper(p_name) WHEN 3 THEN p_name || '  (' || p_type || ')'
  WHEN 4 THEN '__' || p_brand || '__' WHEN 5 THEN 'JOBS_1000' || chr(9) || 'orig' WHEN 6 THEN '' ELSE 'Tot Emp' || chr(8224) END"""
_NORMALIZED = f"""lower(trim(regexp_replace(replace(regexp_replace(regexp_replace(trim({_RAW_HEADER}),
  '[¹†*]', '', 'g'), '\\s+', '_', 'g'), '__', '_'), '[^0-9A-Za-z_]', '', 'g'), '_'))"""

# Header of the file a part stands for: three fixed columns in changing spelling, one free one.
_HEADER_ITEMS = [
    "CASE p_partkey % 3 WHEN 0 THEN 'area' WHEN 1 THEN 'AREA' ELSE 'Area' END",
    "CASE p_partkey % 4 WHEN 0 THEN 'Area Title*' ELSE 'area_title' END",
    "CASE WHEN p_partkey % 5 = 0 THEN 'occ code' ELSE 'OCC_CODE' END",
    "p_name",
    "CASE WHEN p_partkey % 6 = 0 THEN 'area' ELSE 'size ' || CAST(p_size AS STRING) END",
    "CASE WHEN p_partkey % 500 = 7 THEN 'once ' || CAST(p_partkey AS STRING) ELSE 'tot_emp' END",
]


def _part_headers(spark, sf_dir):
    header = F.array(*[F.expr(item) for item in _HEADER_ITEMS]).alias("header")
    return table(spark, sf_dir, "part").select("p_partkey", header)


def normalize_headers(spark, sf_dir):
    raw = F.expr(_RAW_HEADER)
    return table(spark, sf_dir, "part").select("p_partkey", normalize_header(raw).alias("normalized"))


def rename_plan(spark, sf_dir):
    return headers.rename_plan(_part_headers(spark, sf_dir)).withColumn("pos", F.col("pos").cast("int"))


def schema_diff(spark, sf_dir):
    found = headers.schema_difference(_part_headers(spark, sf_dir))
    return found.select(
        "p_partkey",
        F.size("added_columns").alias("added"),
        F.array_join("extra_columns", "|").alias("extra"),
        F.array_join("dropped_columns", "|").alias("dropped"),
    )


def header_variants(spark, sf_dir):
    return headers.header_variants(_part_headers(spark, sf_dir))


def common_columns(spark, sf_dir):
    return headers.common_columns(headers.header_variants(_part_headers(spark, sf_dir)))


def rare_columns(spark, sf_dir):
    return headers.rare_columns(headers.header_variants(_part_headers(spark, sf_dir)))


# --- values ---

_RAW_NUMBER = """CASE l_orderkey % 9 WHEN 0 THEN '#' WHEN 1 THEN ' ** ' WHEN 2 THEN '' WHEN 3 THEN '~'
  WHEN 4 THEN '  ' || CAST(l_extendedprice AS STRING) || ' ' ELSE CAST(l_extendedprice AS STRING) END"""
_RAW_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN '#' WHEN 1 THEN '**' WHEN 2 THEN ' * ' WHEN 3 THEN '' ELSE o_orderpriority END"""


def suppress_text_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", suppress_text(F.expr(_RAW_TEXT)).alias("value"))


def sanitize_numeric_query(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_RAW_NUMBER).alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", sanitize_numeric(F.col("raw"), T.DoubleType()).alias("value"))


_YEAR_NAME = "CASE WHEN o_orderkey % 3 = 0 THEN 'data.csv' ELSE 'all_data_M_' || CAST(year(o_orderdate) + 20 AS STRING) || '.csv' END"
_YEAR_PARENT = "CASE WHEN o_orderkey % 2 = 0 THEN 'root/survey' ELSE 'root/oes' || CAST(2000 + o_custkey % 30 AS STRING) || '/2099' END"


def detect_year_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", detect_year(F.expr(_YEAR_NAME), F.expr(_YEAR_PARENT)).alias("year")
    )


_SHEET = "CASE WHEN p_partkey % 10 = 0 THEN '  ' ELSE '  ' || p_type || '/' || chr(92) || p_name || '* é-' || p_brand || ' ' END"


def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", safe_name(F.expr(_SHEET)).alias("name"))


# --- audits: line items as loaded rows, one source file per part type and year ---

_VINTAGE_SQL = """SELECT lower(p_type) || '.csv' AS SOURCE_FILE,
  'survey_' || CAST(year(o_orderdate) + 20 AS STRING) AS SOURCE_FOLDER,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(year(o_orderdate) + 20 AS INTEGER) END AS SURVEY_YEAR
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


def _loaded_rows(spark, sf_dir):
    lineitem, orders, part = tables(spark, sf_dir, "lineitem", "orders", "part")
    year = (F.year("o_orderdate") + 20).cast("int")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lower("p_type"), F.lit(".csv")).alias("SOURCE_FILE"),
            F.concat(F.lit("survey_"), year.cast("string")).alias("SOURCE_FOLDER"),
            F.when(F.col("l_linenumber") != 1, year).alias("SURVEY_YEAR"),
        )
    )


def _audit(spark, sf_dir):
    rows = _loaded_rows(spark, sf_dir).withColumn("path", F.concat_ws("/", "SOURCE_FOLDER", "SOURCE_FILE"))
    return warehouse.vintage_audit(rows, "path")


def vintage_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


def vintage_upsert(spark, sf_dir):
    return warehouse.vintage_upsert(_audit(spark, sf_dir))


def load_summary(spark, sf_dir):
    return warehouse.load_summary(_loaded_rows(spark, sf_dir))


def pending_inputs(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    orders = orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    stem = lambda key: F.concat(F.lit("customer_"), F.col(key).cast("string")).alias("stem")
    return warehouse.pending_inputs(customer.select(stem("c_custkey")), orders.select(stem("o_custkey")), "stem")


def load_reconcile(spark, sf_dir):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    expected = orders.select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 7 + 1).alias("rows"))
    loaded = lineitem.groupBy(F.col("l_orderkey").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    return warehouse.reconcile(expected, loaded)


def outcome_tally(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"),
        (F.col("o_orderstatus") == "F").alias("ok"),
        F.when(F.col("o_orderstatus") == "P", "Year done: Already downloaded").otherwise("Year run").alias("message"),
    )
    tally = warehouse.outcome_tally(runs, "year", "ok", "message")
    return tally.withColumn("items", F.array_join(F.transform("items", lambda y: y.cast("string")), ","))


def result_profile(spark, sf_dir):
    found = profile.result_profile(table(spark, sf_dir, "lineitem"))
    rounded = {c: F.round(F.col(c) + 1e-7, 2) for c in ("min", "max", "mean", "median")}
    return found.withColumns(rounded)


def column_stats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE ' ' || CAST(o_totalprice AS STRING) END").alias("wage"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) ELSE '1d' END").alias("mostly_text"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '1_000' ELSE CAST(o_custkey AS STRING) END").alias("grouped"),
    )
    return profile.column_stats(orders).withColumn("mean", F.round(F.col("mean") + 1e-7, 2))


_ALIASES = ", ".join(f"('{a}', '{c}')" for a, c in ALIAS_TO_CANONICAL.items())
_CANONICAL = ", ".join(f"'{c}'" for c in CANONICAL_COLUMNS)
_NORMAL_RAW = """lower(trim(regexp_replace(replace(regexp_replace(regexp_replace(trim(raw), '[¹†*]', '', 'g'),
  '\\s+', '_', 'g'), '__', '_'), '[^0-9A-Za-z_]', '', 'g'), '_'))"""
_EXPLODED = f"""
WITH columns AS (
  SELECT p_partkey, unnest(range({len(_HEADER_ITEMS)})) AS pos, unnest([{', '.join(_HEADER_ITEMS)}]) AS raw FROM part
), named AS (SELECT *, {_NORMAL_RAW} AS normalized FROM columns),
aliases(alias, target) AS (VALUES {_ALIASES}),
planned AS (
  SELECT p_partkey, CAST(pos AS INTEGER) AS pos, raw, coalesce(target, upper(nullif(normalized, '')), upper(raw)) AS canonical
  FROM named LEFT JOIN aliases ON alias = normalized
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY p_partkey, canonical ORDER BY pos) = 1 AS kept FROM planned
), variants AS (
  SELECT normalized, raw, count(*) AS files FROM named WHERE normalized <> '' GROUP BY normalized, raw
)
"""


def _stats_sql(column: str, number: str) -> str:
    return f"""SELECT '{column}' AS "column", min({number}) AS min, max({number}) AS max,
      round(avg({number}) + 1e-7, 2) AS mean, count({number}) AS count, count(*) AS total FROM raw"""


_LOOSE = "CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+(_[0-9]+)*(\\.[0-9]+)?') THEN CAST(replace(trim({c}), '_', '') AS DOUBLE) END"


def _profile_sql(column: str) -> str:
    nudge = lambda f: f"round(CAST({f}({column}) AS DOUBLE) + 1e-7, 2)"
    return f"""SELECT '{column}' AS "column", count(*) AS row_count, {nudge('min')} AS min, {nudge('max')} AS max,
      {nudge('avg')} AS mean, {nudge('median')} AS median FROM lineitem"""


QUERIES = {
    "normalize_headers": Query(normalize_headers, f"SELECT p_partkey, {_NORMALIZED} AS normalized FROM part"),
    "rename_plan": Query(rename_plan, f"{_EXPLODED} SELECT p_partkey, pos, raw, canonical, kept FROM kept"),
    "schema_diff": Query(
        schema_diff,
        f"""{_EXPLODED} SELECT p_partkey,
        CAST({len(CANONICAL_COLUMNS)} - count(*) FILTER (kept AND canonical IN ({_CANONICAL})) AS INTEGER) AS added,
        coalesce(string_agg(canonical, '|' ORDER BY pos) FILTER (kept AND canonical NOT IN ({_CANONICAL})), '') AS extra,
        coalesce(string_agg(raw, '|' ORDER BY pos) FILTER (NOT kept), '') AS dropped
        FROM kept GROUP BY p_partkey""",
    ),
    "header_variants": Query(header_variants, f"{_EXPLODED} SELECT normalized, raw, files FROM variants"),
    "common_columns": Query(
        common_columns,
        f"""{_EXPLODED} SELECT normalized, CAST(sum(files) AS BIGINT) AS total,
        arg_max(raw, (files, raw)) AS example FROM variants
        GROUP BY normalized ORDER BY total DESC, normalized LIMIT 10""",
    ),
    "rare_columns": Query(
        rare_columns,
        f"""{_EXPLODED} SELECT normalized, min(raw) AS example FROM variants
        GROUP BY normalized HAVING sum(files) = 1 ORDER BY normalized LIMIT 10""",
    ),
    "suppress_text": Query(
        suppress_text_query,
        f"""SELECT o_orderkey, CASE WHEN {_RAW_TEXT} NOT IN ('', '#', '**', '*', '~') THEN {_RAW_TEXT} END AS value
        FROM orders""",
    ),
    "sanitize_numeric": Query(
        sanitize_numeric_query,
        f"""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN trim(raw) NOT IN ('', '#', '**', '*', '~') THEN trim(raw) END
        AS DOUBLE) AS value FROM (SELECT l_orderkey, l_linenumber, {_RAW_NUMBER} AS raw FROM lineitem)""",
    ),
    "detect_year": Query(
        detect_year_query,
        f"""SELECT o_orderkey, CAST(coalesce(nullif(regexp_extract({_YEAR_NAME}, '20[0-9][0-9]'), ''),
        nullif(regexp_extract({_YEAR_PARENT}, '20[0-9][0-9]'), '')) AS INTEGER) AS year FROM orders""",
    ),
    "safe_names": Query(
        safe_names,
        f"""SELECT p_partkey, coalesce(nullif(replace(regexp_replace(trim({_SHEET}), '[^\\p{{L}}\\p{{N}} _-]', '_', 'g'),
        ' ', '_'), ''), 'sheet') AS name FROM part""",
    ),
    "vintage_audit": Query(
        vintage_audit,
        f"""SELECT SOURCE_FOLDER || '/' || SOURCE_FILE AS path, SOURCE_FILE, SOURCE_FOLDER,
        min(SURVEY_YEAR) AS SURVEY_YEAR, count(*) AS ROW_COUNT FROM ({_VINTAGE_SQL}) GROUP BY SOURCE_FOLDER, SOURCE_FILE""",
    ),
    "vintage_upsert": Query(
        vintage_upsert,
        f"""WITH audit AS (SELECT SOURCE_FILE, SOURCE_FOLDER, min(SURVEY_YEAR) AS SURVEY_YEAR, count(*) AS ROW_COUNT
        FROM ({_VINTAGE_SQL}) GROUP BY SOURCE_FOLDER, SOURCE_FILE)
        SELECT * FROM audit QUALIFY row_number() OVER
          (PARTITION BY SOURCE_FILE ORDER BY SURVEY_YEAR DESC NULLS LAST, SOURCE_FOLDER DESC) = 1""",
    ),
    "load_summary": Query(
        load_summary,
        f"""SELECT count(*) AS total_rows, count(DISTINCT SOURCE_FILE) AS files, min(SURVEY_YEAR) AS min_year,
        max(SURVEY_YEAR) AS max_year FROM ({_VINTAGE_SQL})""",
    ),
    "pending_inputs": Query(
        pending_inputs,
        """SELECT 'customer_' || CAST(c_custkey AS VARCHAR) AS stem FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
    ),
    "load_reconcile": Query(
        load_reconcile,
        """SELECT coalesce(o_orderkey, l_orderkey) AS path, o_orderkey % 7 + 1 AS expected_rows, n AS loaded_rows,
        CASE WHEN n IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unexpected'
             WHEN n = o_orderkey % 7 + 1 THEN 'ok' ELSE 'mismatch' END AS status
        FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
          ON o_orderkey = l_orderkey""",
    ),
    "outcome_tally": Query(
        outcome_tally,
        """SELECT CASE o_orderstatus WHEN 'P' THEN 'skipped' WHEN 'F' THEN 'success' ELSE 'failed' END AS status,
        count(*) AS runs, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS items
        FROM orders GROUP BY o_orderstatus""",
    ),
    "result_profile": Query(
        result_profile,
        " UNION ALL ".join(
            _profile_sql(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        ),
    ),
    "column_stats": Query(
        column_stats,
        f"""WITH raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
          CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE ' ' || CAST(o_totalprice AS VARCHAR) END AS wage,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '1d' END AS mostly_text,
          CASE WHEN o_orderkey % 2 = 0 THEN '1_000' ELSE CAST(o_custkey AS VARCHAR) END AS grouped FROM orders)
        SELECT "column", min, max, mean, count FROM ({' UNION ALL '.join(
            _stats_sql(c, _LOOSE.format(c=c)) for c in ('o_orderkey', 'o_orderstatus', 'wage', 'mostly_text', 'grouped'))})
        WHERE count > 0 AND count * 2 >= total""",
    ),
}
