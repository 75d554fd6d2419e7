import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallystar.plans.guarded_sql import GuardedSql, audit_sql, rejection
from tallystar.queries.sql_surface import warehouse_dictionary

FACT = [(1, "Data Scientist", 120000.0), (2, "Statistician", 95000.0), (3, "Economist", 105000.0)]


@pytest.fixture(scope="module")
def sql(spark):
    spark.createDataFrame([(9,)], "secret int").createOrReplaceTempView("parent_only")
    spark.createDataFrame([(9,)], "secret int").createOrReplaceGlobalTempView("shared_view")
    return GuardedSql(
        spark,
        {
            "jobs": lambda s: s.createDataFrame(FACT, "id int, occupation string, salary double"),
            "numbers": lambda s: s.range(25_000).selectExpr("id", "id % 7 AS digit", "CAST(id AS STRING) AS text"),
        },
    )


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE jobs", "DELETE FROM jobs WHERE 1=1", "UPDATE jobs SET salary = 0", "INSERT INTO jobs VALUES (1, 2, 3)",
        "ALTER TABLE jobs ADD COLUMN t STRING", "CREATE TABLE m (id INT)", "TRUNCATE TABLE jobs", "  drop table jobs",
        "-- comment\nDROP TABLE jobs", "VALUES (1)", "SHOW TABLES", "/* SELECT */ SET x = 1",
    ],
)
def test_blocks_other_statements(sql, text):
    out = sql.run(text).envelope()
    assert out["success"] is False and "SELECT" in out["error"]


@pytest.mark.parametrize("text", ["SELECT 1; DROP TABLE jobs", "SELECT * FROM jobs; DELETE FROM jobs", "SELECT 1; SELECT 2"])
def test_blocks_many_statements(sql, text):
    assert "Multiple" in sql.run(text).error


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM jobs LIMIT 1", "  SELECT * FROM jobs LIMIT 1", "\nSELECT * FROM jobs LIMIT 1",
        "-- a; b\nSELECT * FROM jobs LIMIT 1", "select * FROM jobs LIMIT 1;", "SELECT ';' AS x -- done; here",
        "WITH a AS (SELECT avg(salary) AS v FROM jobs) SELECT * FROM a LIMIT 1",
    ],
)
def test_allows_selects(sql, text):
    out = sql.run(text).envelope()
    assert out["success"] is True, out
    assert out["row_count"] == 1


@pytest.mark.parametrize(
    "text",
    [
        "WITH a AS (SELECT 1) INSERT INTO jobs SELECT * FROM a", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM parent_only",
        "SELECT * FROM global_temp.shared_view", "SELECT reflect('java.lang.System', 'getenv', 'PATH')",
        "SELECT `java_method`('java.lang.System', 'getenv', 'PATH')", "SELECT occupation, count(*) FROM jobs", "", "  ", "SELECT FROM",
    ],
)
def test_returns_errors(sql, text):
    out = sql.run(text).envelope()
    assert out["success"] is False and out["error"]


def test_cannot_leave_the_cap(sql):
    assert sql.run("SELECT * FROM numbers").frame.count() == 10_000
    assert sql.run("SELECT * FROM (SELECT * FROM numbers LIMIT 20000)").frame.count() == 10_000
    assert sql.run("SELECT * FROM numbers LIMIT 20000").frame.count() == 20_000
    cut, own = sql.run("SELECT * FROM numbers").envelope(), sql.run("SELECT * FROM numbers LIMIT 12000 -- LIMIT").envelope()
    assert (cut["row_count"], cut["capped"]) == (10_000, True) and (own["row_count"], own["capped"]) == (12_000, False)
    assert sql.run("SELECT id FROM numbers) UNION ALL (SELECT id FROM numbers").frame.count() == 10_000


@pytest.mark.parametrize(
    "text",
    [
        "SELECT `limit` FROM (SELECT id AS `limit` FROM numbers)", "SELECT id AS limit FROM numbers", "SELECT * FROM numbers AS limit",
        "WITH limit AS (SELECT * FROM numbers) SELECT * FROM limit", "SELECT id FROM numbers LIMIT ALL",
        "WITH a AS (SELECT * FROM numbers LIMIT 24000) SELECT * FROM a", "SELECT * FROM (SELECT * FROM numbers LIMIT 24000) b",
        "SELECT id FROM numbers UNION ALL (SELECT id FROM numbers LIMIT 3)", "SELECT id FROM numbers WHERE id <> (SELECT max(id) FROM numbers LIMIT 1)",
        "SELECT id FROM numbers -- LIMIT 3", "SELECT id, 'LIMIT 3' AS t FROM numbers",
    ],
)
def test_only_the_outermost_limit_lifts_the_cap(sql, text):
    assert sql.run(text).frame.count() == 10_000


@pytest.mark.parametrize(
    "text",
    ["SELECT * FROM numbers LIMIT 15000", "SELECT * FROM numbers ORDER BY id LIMIT 15000 OFFSET 2",
     "WITH a AS (SELECT * FROM numbers) SELECT * FROM a LIMIT 15000", "SELECT id FROM numbers UNION SELECT -1 LIMIT 15000"],
)
def test_an_own_limit_of_any_form_holds(sql, text):
    assert sql.run(text).frame.count() == 15_000
    assert sql.run("SELECT * FROM numbers LIMIT ?", "[15000]").frame.count() == 15_000


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM range(5)", "SELECT id FROM jobs WHERE id IN (SELECT id FROM range(3))", "SELECT (SELECT max(id) FROM range(3)) FROM jobs",
        "WITH a AS (SELECT * FROM range(3)) SELECT * FROM a", "SELECT * FROM elsewhere.main.t", "SELECT * FROM kept_table", "SELECT * FROM default.kept_table",
        "SELECT * FROM jobs JOIN global_temp.shared_view", "SELECT * FROM jobs WHERE EXISTS (SELECT 1 FROM global_temp.shared_view)",
    ],
)
def test_rows_come_from_registered_views_only(sql, spark, text):
    if not spark.catalog.tableExists("kept_table"):
        spark.range(3).write.mode("overwrite").saveAsTable("kept_table")
    try:
        assert sql.run(text).error
    finally:
        spark.sql("DROP TABLE IF EXISTS kept_table")


def test_rows_of_the_text_itself_are_allowed(sql):
    for text in ("SELECT 1", "SELECT * FROM VALUES (1), (2)", "SELECT explode(array(1, 2))", "SELECT * FROM explode(array(1, 2))",
                 "SELECT j.id FROM jobs j, LATERAL (SELECT j.id + 1 AS x)"):
        assert sql.run(text).envelope()["success"] is True, text


def test_a_statement_runs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    guard = GuardedSql(spark, {"numbers": lambda s: s.range(4000).mapInArrow(counted, "id long")}, row_cap=3000)
    for text, rows, capped in (("SELECT id FROM numbers ORDER BY id DESC", 3000, True), ("SELECT id FROM numbers WHERE id < 5 ORDER BY id DESC", 5, False)):
        read.value = 0
        result = guard.run(text)
        out = result.envelope()
        result.trace()
        assert read.value == 4000 and (out["row_count"], out["capped"]) == (rows, capped)
        assert (out.get("data") or out["sample_data"])[0] == [3999 if capped else 4]
        assert "stats" not in out or out["stats"]["id"] == {"min": 1000.0, "max": 3999.0, "mean": 2499.5, "median": 2499.5}


def test_results_of_types_that_files_do_not_hold(sql):
    out = sql.run("SELECT NULL AS nothing, id, id FROM jobs ORDER BY id").envelope()
    assert out["columns"] == ["nothing", "id", "id"] and out["data"][0] == [None, 1, 1]


def test_parameters_and_small_envelope(sql):
    out = sql.run("SELECT occupation FROM jobs WHERE salary > ? AND occupation LIKE ? ORDER BY id LIMIT ?", '[90000, "%i%", 5]').envelope()
    assert out["data"] == [["Data Scientist"], ["Statistician"], ["Economist"]]
    assert out["columns"] == ["occupation"] and out["truncated"] is False
    assert "JSON" in sql.run("SELECT 1", "{bad").error
    json.loads(sql.run("SELECT * FROM jobs").to_json())


def test_large_envelope_and_trace(sql):
    result = sql.run("SELECT * FROM numbers WHERE id < 2001 ORDER BY id")
    out = result.envelope()
    assert out["truncated"] is True and out["row_count"] == 2001 and len(out["sample_data"]) == 10
    assert out["stats"]["id"] == {"min": 0.0, "max": 2000.0, "mean": 1000.0, "median": 1000.0} and "text" not in out["stats"]
    trace = result.trace()
    assert trace["truncated"] is True and trace["row_count"] == 2001 and len(trace["sample_data"]) == 10
    small = sql.run("SELECT occupation, salary FROM jobs").trace()
    assert small["row_count"] == 3 and set(small["stats"]) == {"salary"} and "truncated" not in small


def test_error_at_run_time_is_returned(sql):
    assert sql.run("SELECT CAST(occupation AS INT) FROM jobs").envelope()["success"] is False


def test_rejection_texts():
    assert rejection("select 1") is None and rejection(None) == "Empty SQL query"


def test_audit(spark):
    texts = ["SELECT 1", "select 'x'", "DROP TABLE t", "SELECT created_at FROM t", " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sql string").orderBy("i")
    assert [tuple(r[0]) for r in df.select(audit_sql(F.col("sql"))).collect()] == [
        ("valid", None), ("warning", "string literals"), ("error", "DROP"), ("error", "CREATE"), ("error", "empty"),
    ]
    assert df.select(audit_sql(F.col("sql"), word_match=True)).collect()[3][0].status == "valid"


def test_warehouse_dictionary(spark):
    rows = {(r.table, r.column): r for r in warehouse_dictionary(spark).collect()}
    assert len(rows) == 42 and rows[("fact", "AREA_TITLE")].description == "name of the place a row speaks about"


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    got = contract.entry(spark)
    assert got.count() > 0 and "wage_std_dev" in got.columns
