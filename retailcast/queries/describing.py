"""Queries: descriptive rollups of the summer months."""

from __future__ import annotations

from retailcast.operators import rollups
from retailcast.queries.registry import panel, query, rounded
from retailcast.schema import MARKDOWNS, SALES_KEY


def summer(spark, folder, *columns):
    """Summer rows of the panel, with the named columns of features and stores."""
    needed = columns or ("is_holiday",)
    return rollups.summer(panel(spark, folder, *needed))


def _summer_with_markdowns(spark, folder):
    return rollups.with_markdown_total(summer(spark, folder, *MARKDOWNS))


@query(
    "d1_summer",
    "SELECT store_id, department, date, weekly_sales, round(total_markdown, 4) AS total_markdown FROM summer",
)
def d1summer(spark, folder):
    df = _summer_with_markdowns(spark, folder).select(*SALES_KEY, "weekly_sales", "total_markdown")
    return rounded(df, "total_markdown")


@query(
    "d2_summer_profile",
    """SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
              (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM (SELECT DISTINCT year AS y FROM summer)) AS years,
              (SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) FROM (SELECT DISTINCT month AS m FROM summer)) AS months,
              count(DISTINCT store_id) AS n_stores, count(DISTINCT department) AS n_departments FROM summer""",
)
def d2_summer_profile(spark, folder):
    return rollups.subset_profile(summer(spark, folder))


@query("d3_sales_by_year", "SELECT year, CAST(sum(weekly_sales) AS BIGINT) AS total_summer_sales FROM summer GROUP BY year")
def d3_sales_by_year(spark, folder):
    return rollups.sales_by_year(summer(spark, folder))


@query(
    "d4_sales_by_month",
    """SELECT month, CAST(sum(weekly_sales) AS BIGINT) AS total_sales,
              CASE month WHEN 6 THEN 'June' WHEN 7 THEN 'July' ELSE 'August' END AS month_name
       FROM summer GROUP BY month""",
)
def d4_sales_by_month(spark, folder):
    return rollups.sales_by_month(summer(spark, folder))


@query("d5_sales_by_week", "SELECT date, CAST(sum(weekly_sales) AS BIGINT) AS total_weekly_sales FROM summer GROUP BY date")
def d5_sales_by_week(spark, folder):
    return rollups.sales_by_week(summer(spark, folder))


@query(
    "d6_sales_by_holiday",
    """SELECT is_holiday, round(avg(weekly_sales), 4) AS avg_weekly_sales,
              CASE is_holiday WHEN 1 THEN 'Holiday' ELSE 'Non-Holiday' END AS holiday_type
       FROM summer GROUP BY is_holiday""",
)
def d6_sales_by_holiday(spark, folder):
    return rounded(rollups.sales_by_holiday(summer(spark, folder)), "avg_weekly_sales")


@query(
    "d7_sales_by_markdown",
    """SELECT CAST(total_markdown > 0 AS INTEGER) AS has_markdown, round(avg(weekly_sales), 4) AS avg_weekly_sales,
              CASE WHEN total_markdown > 0 THEN 'With Markdown' ELSE 'No Markdown' END AS markdown_type
       FROM summer GROUP BY ALL""",
)
def d7_sales_by_markdown(spark, folder):
    return rounded(rollups.sales_by_markdown(_summer_with_markdowns(spark, folder)), "avg_weekly_sales")


def _totals(key: str) -> str:
    return f"SELECT {key}, CAST(sum(weekly_sales) AS BIGINT) AS total_sales FROM summer GROUP BY {key}"


@query("d8_sales_by_store_type", _totals("store_type"))
def d8_sales_by_store_type(spark, folder):
    return rollups.ranked_totals(summer(spark, folder, "store_type"), "store_type")


@query("d9_sales_by_region", _totals("region"))
def d9_sales_by_region(spark, folder):
    return rollups.ranked_totals(summer(spark, folder, "region"), "region")


@query("d10_sales_by_department", _totals("department"))
def d10_sales_by_department(spark, folder):
    return rollups.ranked_totals(summer(spark, folder), "department")


@query("d11_top_departments", _totals("department") + " ORDER BY total_sales DESC, department LIMIT 5")
def d11_top_departments(spark, folder):
    return rollups.ranked_totals(summer(spark, folder), "department", 5)


@query("d11_top_stores", _totals("store_id") + " ORDER BY total_sales DESC, store_id LIMIT 10")
def d11_top_stores(spark, folder):
    return rollups.ranked_totals(summer(spark, folder), "store_id", 10)


@query(
    "d12_sales_by_temperature",
    "SELECT temperature, round(avg(weekly_sales), 4) AS avg_weekly_sales FROM summer GROUP BY temperature",
)
def d12_sales_by_temperature(spark, folder):
    return rounded(rollups.sales_by_temperature(summer(spark, folder, "temperature")), "avg_weekly_sales")


@query("d13_temperature_points", "SELECT temperature, weekly_sales FROM summer")
def d13_temperature_points(spark, folder):
    return rollups.temperature_points(summer(spark, folder, "temperature"))
