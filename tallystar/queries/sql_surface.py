"""Queries through the guarded SQL surface, its audit, and the table catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystar.operators import catalog
from tallystar.plans.guarded_sql import ROW_CAP, GuardedSql, audit_sql
from tallystar.queries.tables import TABLES, Query, table, tables
from tallystar.schema import FACT_SCHEMA, VINTAGE_SCHEMA


def guard(spark, sf_dir, row_cap: int | None = None) -> GuardedSql:
    """Whole results by default, as the registered queries must return them."""
    return GuardedSql(spark, {n: (lambda s, n=n: table(s, sf_dir, n)) for n in TABLES}, row_cap)


def _run(sql: str, params=None):
    def build(spark, sf_dir):
        result = guard(spark, sf_dir).run(sql, params)
        if not result.success:
            raise RuntimeError(result.error)
        return result.frame

    return build


# Texts accepted by the surface, one per form; the oracle runs the same text.
_FORMS = {
    "guarded_sql": """SELECT p_type, sum(l_quantity) AS quantity, count(*) AS lines
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.02 GROUP BY p_type""",
    "cte_avg": "WITH avg_wage AS (SELECT round(avg(l_extendedprice) + 1e-7, 2) AS avg_val FROM lineitem) SELECT * FROM avg_wage",
    "sql_having": """SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 12""",
    "sql_window": """SELECT n_name, c_custkey, c_acctbal FROM (
        SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rn
        FROM customer JOIN nation ON c_nationkey = n_nationkey) ranked WHERE rn <= 3""",
    "sql_set_ops": """SELECT l_partkey AS k FROM lineitem WHERE l_quantity >= 50
        EXCEPT SELECT p_partkey FROM part WHERE p_size > 10""",
    "sql_scalar_subquery": """SELECT c_mktsegment, count(*) AS rich FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) GROUP BY c_mktsegment""",
}
_PARAM_SQL = "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > ? AND s_name LIKE ? ORDER BY s_suppkey LIMIT ?"


def sql_parameters(spark, sf_dir):
    return _run(_PARAM_SQL, '[0.0, "%00%", 7]')(spark, sf_dir)


def result_envelope(spark, sf_dir):
    """The envelope of a statement over whole tables, as one row."""
    sql = "SELECT p_brand, count(*) AS parts, sum(p_size) AS size FROM part GROUP BY p_brand ORDER BY p_brand"
    out = guard(spark, sf_dir).run(sql).envelope()
    row = (out["success"], out["truncated"], out["row_count"], ",".join(out["columns"]), out["data"][0][0])
    return spark.createDataFrame(
        [row], "success boolean, truncated boolean, row_count long, column_names string, first_value string"
    )


def result_envelope_large(spark, sf_dir):
    """The envelope of a statement with more rows than are listed: count and statistics of its numeric columns."""
    out = guard(spark, sf_dir).run("SELECT l_orderkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem").envelope()
    rows = [(c, out["truncated"], out["capped"], out["row_count"], len(out["sample_data"]), *(v[k] for k in ("min", "max", "mean", "median")))
            for c, v in out["stats"].items()]
    stats = spark.createDataFrame(
        rows, '"column" string, truncated boolean, capped boolean, row_count long, listed long, min double, max double, mean double, median double'.replace('"', "`"))
    return stats.withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 4))


# A column called limit is no limit.
_CAPPED_SQL = "SELECT l_orderkey, l_linenumber, l_quantity AS limit FROM lineitem ORDER BY l_orderkey, l_linenumber"


def capped_sql(spark, sf_dir):
    """A text without a limit under the default cap: the rows that are left, and what the envelope says of them."""
    result = guard(spark, sf_dir, ROW_CAP).run(_CAPPED_SQL)
    out = result.envelope()
    return result.frame.withColumns({"capped": F.lit(out["capped"]), "row_count": F.lit(out["row_count"]).cast("long")})


_TEXT = """CASE p_partkey % 7 WHEN 0 THEN 'SELECT * FROM t WHERE name = ''' || p_name || '''' WHEN 1 THEN 'drop table ' || p_type
  WHEN 2 THEN 'SELECT created_at FROM t' WHEN 3 THEN '   ' WHEN 4 THEN 'SELECT ' || CAST(p_size AS STRING)
  WHEN 5 THEN 'UPDATE t SET a = 1; DELETE FROM t' ELSE 'SELECT "' || p_brand || '"' END"""


def sql_audit(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", audit_sql(F.expr(_TEXT)).alias("audit")).select("p_partkey", "audit.*")


def sample_rows(spark, sf_dir):
    known = {"part": table(spark, sf_dir, "part")}
    return catalog.sample_rows(known, "part", "p_partkey")


def data_dictionary(spark, sf_dir):
    """Columns of the driver's tables with the size of each table."""
    known = dict(zip(TABLES, tables(spark, sf_dir, *TABLES)))
    sizes = catalog.table_sizes(known)
    return catalog.data_dictionary(spark, known).join(sizes, "table").select("table", "column", "type", "rows")


def warehouse_dictionary(spark):
    """Columns of the two loaded tables with their descriptions."""
    empty = {
        "fact": spark.createDataFrame([], FACT_SCHEMA),
        "data_vintages": spark.createDataFrame([], VINTAGE_SCHEMA),
    }
    return catalog.data_dictionary(spark, empty)


_WORDS = "DROP|DELETE|UPDATE|INSERT|ALTER|TRUNCATE|CREATE"

QUERIES = {
    **{name: Query(_run(sql), sql) for name, sql in _FORMS.items()},
    "sql_parameters": Query(
        sql_parameters,
        "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0.0 AND s_name LIKE '%00%' ORDER BY s_suppkey LIMIT 7",
    ),
    "result_envelope": Query(
        result_envelope,
        """SELECT true AS success, false AS truncated, count(DISTINCT p_brand) AS row_count,
        'p_brand,parts,size' AS column_names, min(p_brand) AS first_value FROM part""",
    ),
    "result_envelope_large": Query(
        result_envelope_large,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", true AS truncated, false AS capped, count(*) AS row_count, CAST(10 AS BIGINT) AS listed,
            min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean,
            round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS median FROM lineitem"""
            for c in ("l_orderkey", "l_quantity", "l_extendedprice")
        ),
    ),
    "capped_sql": Query(
        capped_sql,
        f"""WITH size AS (SELECT count(*) AS n FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_quantity AS "limit", n > {ROW_CAP} AS capped, least(n, {ROW_CAP})::BIGINT AS row_count
        FROM lineitem, size ORDER BY l_orderkey, l_linenumber LIMIT {ROW_CAP}""",
    ),
    "sql_audit": Query(
        sql_audit,
        f"""WITH texts AS (SELECT p_partkey, {_TEXT} AS sql FROM part),
        found AS (SELECT *, list_filter(string_split('{_WORDS}', '|'), lambda w: contains(upper(sql), w))[1] AS word FROM texts)
        SELECT p_partkey,
          CASE WHEN trim(sql) = '' OR word IS NOT NULL THEN 'error' WHEN regexp_matches(sql, '[''"]') THEN 'warning' ELSE 'valid' END AS status,
          CASE WHEN trim(sql) = '' THEN 'empty' WHEN word IS NOT NULL THEN word WHEN regexp_matches(sql, '[''"]') THEN 'string literals' END AS reason
        FROM found""",
    ),
    "sample_rows": Query(sample_rows, "SELECT * FROM part ORDER BY p_partkey LIMIT 5"),
    "data_dictionary": Query(
        data_dictionary,
        " UNION ALL ".join(
            f"""SELECT '{n}' AS "table", column_name AS "column",
            CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
              ELSE lower(column_type) END AS type, (SELECT count(*) FROM {n}) AS rows
            FROM (DESCRIBE {n})"""
            for n in TABLES
        ),
    ),
}
