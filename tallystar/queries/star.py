"""Star queries: orders and line items as survey facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.functions.numeric import nudged_round
from tallystar.operators import charts, star
from tallystar.queries.tables import Query, table, tables
from tallystar.schema import OWNERSHIP_TYPES

FACT_COLUMNS = [
    "l_orderkey", "l_linenumber", "survey_year", "total_employment", "mean_annual_wage",
    "area_title", "area_type", "occ_code", "occ_title", "o_group", "naics_title", "own_description",
]


def area_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("area_code"),
        F.col("n_name").alias("area_title"),
        F.col("n_regionkey").alias("area_type"),
        F.col("c_mktsegment").alias("naics_code"),
    )


def occupation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("occ_code"), F.col("p_name").alias("occ_title"), F.col("p_type").alias("o_group")
    )


def place_rows(spark: SparkSession, sf_dir: str, latest: bool) -> DataFrame:
    """Facts with every dimension but the occupation.

    Area, industry and ownership belong to the order, so they are joined to orders first;
    the far larger line items are then shuffled once, by order key.
    """
    lineitem, orders, customer = tables(spark, sf_dir, "lineitem", "orders", "customer")
    if latest:
        orders = star.latest_dated_year(orders, "o_orderdate")
    industries = customer.select(F.col("c_mktsegment").alias("naics_code")).distinct()
    placed = star.star_join(
        orders.select(
            "o_orderkey",
            F.year("o_orderdate").alias("survey_year"),
            F.col("o_custkey").alias("area_code"),
            F.left("o_orderpriority", F.lit(1)).cast("int").alias("own_code"),
        ),
        [
            (area_rows(spark, sf_dir), "area_code", "area_code"),
            (industries.withColumn("naics_title", F.lower("naics_code")), "naics_code", "naics_code"),
            (star.ownership_types(spark), "own_code", "own_code"),
        ],
    )
    measures = lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("occ_code"),
        F.col("l_quantity").alias("total_employment"),
        F.col("l_extendedprice").alias("mean_annual_wage"),
    )
    return measures.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def star_rows(spark: SparkSession, sf_dir: str, latest: bool = True) -> DataFrame:
    occupations = (occupation_rows(spark, sf_dir), "occ_code", "occ_code")
    return star.star_join(place_rows(spark, sf_dir, latest), [occupations]).select(*FACT_COLUMNS)


def latest_star(spark, sf_dir):
    return star_rows(spark, sf_dir)


def state_slice(spark, sf_dir):
    return star.state_slice(star_rows(spark, sf_dir))


def metro_slice(spark, sf_dir):
    return star.metro_slice(star_rows(spark, sf_dir))


def occupation_summary(spark, sf_dir):
    summary = star.occupation_summary(
        place_rows(spark, sf_dir, latest=True),
        "occ_code",
        "survey_year",
        "total_employment",
        "mean_annual_wage",
        occupation_rows(spark, sf_dir),
    )
    return summary.withColumns(
        {
            "avg_annual_wage": nudged_round(F.col("avg_annual_wage")),
            "wage_std_dev": F.round("wage_std_dev", 4),
        }
    )


def top_wages(spark, sf_dir):
    return star.top_rows(
        star_rows(spark, sf_dir, latest=False),
        "mean_annual_wage",
        ["l_orderkey", "l_linenumber"],
        10,
        star.contains_text("area_title", "nation_1") & star.contains_text("occ_title", "WIDGET"),
    ).select("area_title", "occ_title", "mean_annual_wage")


def jobs_by_title(spark, sf_dir):
    lineitem, part = tables(spark, sf_dir, "lineitem", "part")
    return star.sum_by_title(lineitem, "l_partkey", "l_quantity", part, "p_partkey", "p_name")


def like_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(star.contains_text("p_name", "WIDGET")).select("p_partkey", "p_name")


def filter_in(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F")
    ).select("o_orderkey", "o_orderpriority", "o_orderstatus")


def distinct_titles(spark, sf_dir):
    return star.distinct_titles(table(spark, sf_dir, "part"), "p_name")


def chart_series(spark, sf_dir):
    rows = star_rows(spark, sf_dir, latest=False).where("total_employment >= 50 AND area_type = 2")
    return charts.chart_series(rows, "occ_title", "own_description", F.sum("total_employment")).select(
        F.col("occ_title").alias("label"), "series", "value"
    )


def chart_document(spark, sf_dir):
    """The points of a chart, read back from its JSON."""
    chart = charts.chart_document(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", F.count("*"), "bar",
                                  "Orders by priority", x_title="Priority", y_title="Orders")
    shape = ("struct<type: string, title: string, data: struct<labels: array<string>, datasets: array<struct<name: string, values: array<bigint>>>>,"
             " options: struct<x_title: string, y_title: string>>")
    read = chart.select(F.from_json("chart", shape).alias("c"))
    lines = read.select("c", F.posexplode("c.data.datasets").alias("series_no", "d"))
    points = lines.select("c", "series_no", F.col("d.name").alias("series"), F.posexplode(F.arrays_zip(
        F.col("c.data.labels").alias("label"), F.col("d.values").alias("value"))).alias("label_no", "p"))
    return points.select("series_no", "series", "label_no", F.col("p.label").alias("label"), F.col("p.value").alias("value"),
                         F.col("c.type").alias("type"), F.col("c.title").alias("title"), F.col("c.options.x_title").alias("x_title"),
                         F.col("c.options.y_title").alias("y_title"))


_OWN = ", ".join(f"({code}, '{text}')" for code, text in OWNERSHIP_TYPES)

_STAR = f"""
WITH star AS (
  SELECT l_orderkey, l_linenumber, CAST(year(o_orderdate) AS INTEGER) AS survey_year,
         l_quantity AS total_employment, l_extendedprice AS mean_annual_wage,
         n_name AS area_title, n_regionkey AS area_type, l_partkey AS occ_code,
         p_name AS occ_title, p_type AS o_group, lower(c_mktsegment) AS naics_title, own_description
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN (VALUES {_OWN}) AS own(own_code, own_description)
    ON own_code = CAST(left(o_orderpriority, 1) AS INTEGER)
), latest AS (
  SELECT * FROM star WHERE survey_year = (SELECT max(year(o_orderdate)) FROM orders)
)
"""

_COLUMNS = ", ".join(FACT_COLUMNS)

QUERIES = {
    "latest_star": Query(latest_star, f"{_STAR} SELECT {_COLUMNS} FROM latest"),
    "state_slice": Query(state_slice, f"{_STAR} SELECT {_COLUMNS} FROM latest WHERE area_type = 2"),
    "metro_slice": Query(metro_slice, f"{_STAR} SELECT {_COLUMNS} FROM latest WHERE area_type = 4"),
    "occupation_summary": Query(
        occupation_summary,
        f"""{_STAR}
        SELECT occ_code, occ_title, o_group, survey_year, count(*) AS area_count,
               sum(total_employment) AS total_national_employment,
               round(avg(mean_annual_wage) + 1e-7, 2) AS avg_annual_wage,
               min(mean_annual_wage) AS min_annual_wage, max(mean_annual_wage) AS max_annual_wage,
               round(stddev(mean_annual_wage), 4) AS wage_std_dev
        FROM latest
        WHERE total_employment IS NOT NULL AND mean_annual_wage IS NOT NULL AND area_type IN (2, 4)
        GROUP BY occ_code, occ_title, o_group, survey_year""",
    ),
    "top_wages": Query(
        top_wages,
        f"""{_STAR}
        SELECT area_title, occ_title, mean_annual_wage FROM star
        WHERE area_title ILIKE '%nation_1%' AND occ_title ILIKE '%WIDGET%' AND mean_annual_wage IS NOT NULL
        ORDER BY mean_annual_wage DESC, l_orderkey, l_linenumber LIMIT 10""",
    ),
    "jobs_by_title": Query(
        jobs_by_title,
        """SELECT p_name, sum(l_quantity) AS total_jobs FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_name ORDER BY total_jobs DESC, p_name""",
    ),
    "like_search": Query(like_search, "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%'"),
    "filter_in": Query(
        filter_in,
        """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'""",
    ),
    "distinct_titles": Query(distinct_titles, "SELECT DISTINCT p_name FROM part"),
    "chart_series": Query(
        chart_series,
        f"""{_STAR}
        , picked AS (SELECT * FROM star WHERE total_employment >= 50 AND area_type = 2)
        SELECT label, series, sum(total_employment) AS value
        FROM (SELECT DISTINCT occ_title AS label FROM picked)
        CROSS JOIN (SELECT DISTINCT own_description AS series FROM picked)
        LEFT JOIN picked ON occ_title = label AND own_description = series
        GROUP BY label, series""",
    ),
    "chart_document": Query(
        chart_document,
        """WITH labels AS (SELECT DISTINCT o_orderpriority AS label FROM orders), series AS (SELECT DISTINCT o_orderstatus AS series FROM orders),
        points AS (SELECT o_orderpriority AS label, o_orderstatus AS series, count(*) AS value FROM orders GROUP BY ALL)
        SELECT CAST(dense_rank() OVER (ORDER BY series) - 1 AS INTEGER) AS series_no, series,
          CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_no, label, CAST(value AS BIGINT) AS value,
          'bar' AS type, 'Orders by priority' AS title, 'Priority' AS x_title, 'Orders' AS y_title
        FROM labels CROSS JOIN series LEFT JOIN points USING (label, series)""",
    ),
}
