"""Queries: business figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions.columns import MONTH_NAMES
from retailcast.operators import backtest, checks, clean, kpi, rollups
from retailcast.queries import backtests
from retailcast.queries.describing import summer
from retailcast.queries.registry import query, rounded, stored_sales
from retailcast.sources import orders_panel

_GROWTH = """yearly AS (SELECT year, CAST(sum(weekly_sales) AS DOUBLE) AS total, count(DISTINCT date) AS weeks
      FROM summer GROUP BY year),
    growth AS (SELECT a.year AS first_year, b.year AS last_year, (b.total - a.total) / a.total * 100 AS summer_sales_growth_pct,
      a.weeks AS first_year_weeks, b.weeks AS last_year_weeks,
      (b.total / b.weeks - a.total / a.weeks) / (a.total / a.weeks) * 100 AS growth_per_week_pct
      FROM yearly a, yearly b WHERE a.year = (SELECT min(year) FROM yearly) AND b.year = (SELECT max(year) FROM yearly))"""

_MONTH = """best_month AS (SELECT CASE month WHEN 6 THEN 'June' WHEN 7 THEN 'July' ELSE 'August' END AS best_summer_month,
      CAST(sum(weekly_sales) AS DOUBLE) AS best_summer_month_sales,
      CAST(sum(weekly_sales) AS DOUBLE) / count(DISTINCT date) AS best_summer_month_avg_week
      FROM summer GROUP BY month ORDER BY sum(weekly_sales) DESC, month LIMIT 1)"""


def _top(key: str) -> str:
    return f"""top_{key} AS (SELECT {key} AS top_{key}, CAST(sum(weekly_sales) AS DOUBLE) AS top_{key}_sales
      FROM summer GROUP BY {key} ORDER BY sum(weekly_sales) DESC, {key} LIMIT 1)"""


_STATS = ", ".join(f"round({c}, 4) AS {c}" for c in backtests._STATS)
_REDUCTION = """reduction AS (SELECT b.mean_company_wape AS rolling_baseline_mean_wape,
      (b.mean_company_wape - f.mean_company_wape) / b.mean_company_wape * 100 AS wape_reduction_over_baseline_pct
      FROM (SELECT * FROM summary WHERE rank = 1) f
      LEFT JOIN (SELECT * FROM summary WHERE lower(model) LIKE '%rolling 4-week%' ORDER BY rank LIMIT 1) b ON true)"""


def summary(sales: DataFrame) -> DataFrame:
    return backtest.backtest_summary(backtests.results(sales))


@query(
    "p1_growth",
    f"""WITH {_GROWTH} SELECT first_year, last_year, round(summer_sales_growth_pct, 4) AS summer_sales_growth_pct,
        first_year_weeks, last_year_weeks, round(growth_per_week_pct, 4) AS growth_per_week_pct FROM growth""",
)
def p1_growth(spark, folder):
    return rounded(kpi.growth(summer(spark, folder)), "summer_sales_growth_pct", "growth_per_week_pct")


@query(
    "p2_best_month",
    f"""WITH {_MONTH} SELECT best_summer_month, best_summer_month_sales,
        round(best_summer_month_avg_week, 4) AS best_summer_month_avg_week FROM best_month""",
)
def p2_best_month(spark, folder):
    return rounded(kpi.best_month(summer(spark, folder), MONTH_NAMES), "best_summer_month_avg_week")


@query(
    "p3_holiday_lift",
    """SELECT round((h - o) / o * 100, 4) AS holiday_lift_pct FROM (
         SELECT avg(weekly_sales) FILTER (WHERE is_holiday = 1) AS h,
                avg(weekly_sales) FILTER (WHERE is_holiday = 0) AS o FROM summer)""",
)
def p3_holiday_lift(spark, folder):
    return rounded(kpi.holiday_lift(rollups.sales_by_holiday(summer(spark, folder))), "holiday_lift_pct")


@query("p4_top_store_type", f"WITH {_top('store_type')} SELECT * FROM top_store_type")
def p4_top_store_type(spark, folder):
    return kpi.top_group(rollups.total_by(summer(spark, folder, "store_type"), "store_type"), "store_type")


@query("p5_top_region", f"WITH {_top('region')} SELECT * FROM top_region")
def p5_top_region(spark, folder):
    return kpi.top_group(rollups.total_by(summer(spark, folder, "region"), "region"), "region")


@query(
    "p6_selected_model",
    f"SELECT model AS selected_model, {_STATS}, fold_wins, folds AS total_folds FROM summary WHERE rank = 1",
)
def p6_selected_model(spark, folder):
    return rounded(kpi.selected_model(summary(stored_sales(spark, folder))), *backtests._STATS)


@query(
    "p7_wape_reduction",
    f"""WITH {_REDUCTION} SELECT round(rolling_baseline_mean_wape, 4) AS rolling_baseline_mean_wape,
        round(wape_reduction_over_baseline_pct, 4) AS wape_reduction_over_baseline_pct FROM reduction""",
)
def p7_wape_reduction(spark, folder):
    return rounded(
        kpi.wape_reduction(summary(stored_sales(spark, folder))), "rolling_baseline_mean_wape", "wape_reduction_over_baseline_pct"
    )


@query(
    "p8_winning_folds",
    """SELECT s.model AS selected_model,
              (SELECT string_agg(CAST(fold AS VARCHAR), ',' ORDER BY fold) FROM winners w WHERE w.winning_model = s.model) AS folds_won
       FROM summary s WHERE rank = 1""",
)
def p8_winning_folds(spark, folder):
    table = backtests.results(stored_sales(spark, folder))
    won = kpi.winning_folds(backtest.backtest_summary(table), backtest.fold_winners(table))
    return won.withColumn("folds_won", F.array_join("folds_won", ","))


# Fixed values, written out here so that the SQL does not take them from the code it checks.
_METRICS = [
    ("first_year", 0),
    ("last_year", 0),
    ("summer_sales_growth_pct", 2),
    ("best_summer_month", None),
    ("best_summer_month_sales", 2),
    ("top_store_type", None),
    ("top_store_type_sales", 2),
    ("top_region", None),
    ("top_region_sales", 2),
    ("selected_model", None),
    ("mean_company_mape", 4),
    ("mean_company_wape", 4),
    ("median_company_wape", 4),
    ("std_company_wape", 4),
    ("min_company_wape", 4),
    ("max_company_wape", 4),
    ("mean_company_bias", 4),
    ("mean_absolute_company_bias", 4),
    ("fold_wins", 0),
    ("total_folds", 0),
    ("rolling_baseline_mean_wape", 4),
    ("wape_reduction_over_baseline_pct", 2),
]


def _kpi_sql() -> str:
    sources = {
        "growth": ["first_year", "last_year", "summer_sales_growth_pct"],
        "best_month": ["best_summer_month", "best_summer_month_sales"],
        "top_store_type": ["top_store_type", "top_store_type_sales"],
        "top_region": ["top_region", "top_region_sales"],
        "reduction": ["rolling_baseline_mean_wape", "wape_reduction_over_baseline_pct"],
    }
    where = {m: t for t, metrics in sources.items() for m in metrics}
    renamed = {"selected_model": "model", "total_folds": "folds"}
    rows = []
    for i, (metric, decimals) in enumerate(_METRICS, start=1):
        table = where.get(metric, "(SELECT * FROM summary WHERE rank = 1)")
        value = renamed.get(metric, metric)
        if decimals is not None:
            value = f"CAST(CAST(round(CAST({value} AS DOUBLE), {decimals}) AS DECIMAL(38, {decimals})) AS VARCHAR)"
        rows.append(f"SELECT CAST({i} AS BIGINT) AS position, '{metric}' AS metric, {value} AS value FROM {table}")
    tables = ", ".join([_GROWTH, _MONTH, _top("store_type"), _top("region"), _REDUCTION])
    return f"WITH {tables} " + " UNION ALL ".join(rows)


@query("p9_kpi_table", _kpi_sql())
def p9_kpi_table(spark, folder):
    sales = stored_sales(spark, folder)
    table = summary(sales)
    months = rollups.summer(checks.join_on_store(sales, clean.clean_stores(orders_panel.stores(spark, folder))))
    figures = [
        kpi.growth(months),
        kpi.best_month(months, MONTH_NAMES),
        kpi.top_group(rollups.total_by(months, "store_type"), "store_type"),
        kpi.top_group(rollups.total_by(months, "region"), "region"),
        kpi.selected_model(table),
        kpi.wape_reduction(table),
    ]
    return kpi.kpi_table(figures)
