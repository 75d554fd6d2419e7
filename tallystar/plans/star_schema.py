"""Star tables and analytic views over the wide fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystar.operators import star

# --- fixed values: names and types of the star's fact table ---

KEYS = {"area_code": "AREA", "occ_code": "OCC_CODE", "naics_code": "NAICS", "own_code": "OWN_CODE"}

MEASURES = [
    ("total_employment", "TOT_EMP", "int"),
    ("employment_prse", "EMP_PRSE", "decimal(5,2)"),
    ("jobs_per_1000", "JOBS_1000", "decimal(10,4)"),
    ("location_quotient", "LOC_QUOTIENT", "decimal(10,4)"),
    ("pct_total", "PCT_TOTAL", "decimal(5,2)"),
    ("pct_reporting", "PCT_RPT", "decimal(5,2)"),
    ("mean_hourly_wage", "H_MEAN", "decimal(10,2)"),
    ("hourly_10th_pct", "H_PCT10", "decimal(10,2)"),
    ("hourly_25th_pct", "H_PCT25", "decimal(10,2)"),
    ("hourly_median", "H_MEDIAN", "decimal(10,2)"),
    ("hourly_75th_pct", "H_PCT75", "decimal(10,2)"),
    ("hourly_90th_pct", "H_PCT90", "decimal(10,2)"),
    ("mean_annual_wage", "A_MEAN", "int"),
    ("annual_10th_pct", "A_PCT10", "int"),
    ("annual_25th_pct", "A_PCT25", "int"),
    ("annual_median", "A_MEDIAN", "int"),
    ("annual_75th_pct", "A_PCT75", "int"),
    ("annual_90th_pct", "A_PCT90", "int"),
    ("wage_prse", "MEAN_PRSE", "decimal(5,2)"),
]

# --- end of fixed values ---


def _dimension(fact: DataFrame, key: str, name: str, attributes: dict[str, str]) -> DataFrame:
    """One row per key with the attributes of its latest year.

    Distinct combinations are taken first, so a frequent key is reduced before it is ranked.
    """
    seen = fact.where(F.col(key).isNotNull()).groupBy(key, *attributes).agg(F.max("SURVEY_YEAR").alias("__year"))
    latest = F.max(F.struct("__year", *attributes)).alias("__latest")
    picked = [F.col(f"__latest.{column}").alias(alias) for column, alias in attributes.items()]
    return seen.groupBy(key).agg(latest).select(F.col(key).alias(name), *picked)


def star_tables(fact: DataFrame) -> dict[str, DataFrame]:
    """The star's fact and dimensions, taken from the wide table."""
    flag = lambda c: (F.upper(F.coalesce(F.col(c), F.lit(""))) == "TRUE")
    keys = [F.col(source).alias(name) for name, source in KEYS.items() if name != "own_code"]
    measures = [F.col(source).cast(kind).alias(name) for name, source, kind in MEASURES]
    return {
        "employment_wage_data": fact.select(
            *keys,
            F.col("OWN_CODE").try_cast("int").alias("own_code"),
            F.col("SURVEY_YEAR").alias("survey_year"),
            F.col("SURVEY_MONTH").alias("survey_month"),
            *measures,
            flag("ANNUAL").alias("annual_only"),
            flag("HOURLY").alias("hourly_only"),
        ),
        "geographic_areas": _dimension(
            fact, "AREA", "area_code",
            {"AREA_TITLE": "area_title", "AREA_TYPE": "area_type", "PRIM_STATE": "primary_state"},
        ),
        "occupations": _dimension(fact, "OCC_CODE", "occ_code", {"OCC_TITLE": "occ_title", "O_GROUP": "o_group"}),
        "industries": _dimension(fact, "NAICS", "naics_code", {"NAICS_TITLE": "naics_title", "I_GROUP": "i_group"}),
        "ownership_types": star.ownership_types(fact.sparkSession),
    }


def latest_employment_data(tables: dict[str, DataFrame]) -> DataFrame:
    """Facts of the latest year with the attributes of all four dimensions."""
    fact = star.latest_vintage(tables["employment_wage_data"], "survey_year")
    dimensions = {"geographic_areas": "area_code", "occupations": "occ_code", "industries": "naics_code", "ownership_types": "own_code"}
    return star.star_join(fact, [(tables[name], key, key) for name, key in dimensions.items()])


def analytic_views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The latest data, its state and metropolitan slices, and the occupation summary."""
    latest = latest_employment_data(tables)
    return {
        "latest_employment_data": latest,
        "state_employment_data": star.state_slice(latest),
        "metro_employment_data": star.metro_slice(latest),
        "occupation_summary": star.occupation_summary(
            latest.drop("occ_title", "o_group"), "occ_code", "survey_year", "total_employment", "mean_annual_wage",
            tables["occupations"],
        ),
    }
