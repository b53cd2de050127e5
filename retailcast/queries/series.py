"""Queries: series features, naive forecasts, splits and scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.operators import checks, features, rollups, state
from retailcast.queries.registry import (
    TEST_END,
    TEST_START,
    TEST_YEAR,
    featured_sales,
    panel,
    query,
    rounded,
    sales_panel,
)
from retailcast.schema import SALES_KEY
from retailcast.session import materialize, scratch_path
from retailcast.sources import orders_panel

_KEYS = "store_id, department, date"


@query("t1_company_series", "SELECT * FROM company")
def t1_company_series(spark, folder):
    return features.company_series(sales_panel(spark, folder))


def _naive(spark, folder, *columns):
    df = features.company_forecasts(sales_panel(spark, folder))
    return df.select("date", "total_weekly_sales", *columns)


@query("t2_last_week", "SELECT date, total_weekly_sales, pred_last_week FROM company_naive")
def t2_last_week(spark, folder):
    return _naive(spark, folder, "pred_last_week")


@query(
    "t3_rolling_mean_4",
    "SELECT date, total_weekly_sales, round(pred_rolling_4w, 4) AS pred_rolling_4w FROM company_naive",
)
def t3_rolling_mean_4(spark, folder):
    return rounded(_naive(spark, folder, "pred_rolling_4w"), "pred_rolling_4w")


@query("t4_same_week_last_year", "SELECT date, total_weekly_sales, pred_prev_year_same_week FROM company_naive")
def t4_same_week_last_year(spark, folder):
    return _naive(spark, folder, "pred_prev_year_same_week")


@query("t5_series_lags", f"SELECT {_KEYS}, lag_1, lag_4, lag_8 FROM featured")
def t5_series_lags(spark, folder):
    return features.lag_features(sales_panel(spark, folder)).select(*SALES_KEY, "lag_1", "lag_4", "lag_8")


@query(
    "t6_series_rolling_means",
    f"SELECT {_KEYS}, round(rolling_mean_4, 4) AS rolling_mean_4, round(rolling_mean_8, 4) AS rolling_mean_8 FROM featured",
)
def t6_series_rolling_means(spark, folder):
    df = features.rolling_means(sales_panel(spark, folder))
    return rounded(df.select(*SALES_KEY, "rolling_mean_4", "rolling_mean_8"), "rolling_mean_4", "rolling_mean_8")


@query("t7_series_rolling_std", f"SELECT {_KEYS}, round(rolling_std_4, 2) AS rolling_std_4 FROM featured")
def t7_series_rolling_std(spark, folder):
    df = features.rolling_deviations(sales_panel(spark, folder))
    return rounded(df.select(*SALES_KEY, "rolling_std_4"), "rolling_std_4", digits=2)


@query(
    "t8_drop_incomplete",
    """SELECT (SELECT count(*) FROM featured) AS rows_before, (SELECT count(*) FROM complete) AS rows_after,
              (SELECT count(*) FROM featured) - (SELECT count(*) FROM complete) AS rows_removed""",
)
def t8_drop_incomplete(spark, folder):
    return features.incomplete_counts(featured_sales(spark, folder))


@query(
    "t9_time_split",
    """SELECT 'train' AS part, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM complete
         WHERE date < DATE '2001-06-01'
       UNION ALL SELECT 'test', count(*), min(date), max(date) FROM complete
         WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-08-31'""",
)
def t9_time_split(spark, folder):
    complete = features.drop_incomplete(featured_sales(spark, folder))
    parts = zip(("train", "test"), features.time_split(complete, TEST_START, TEST_END))
    return reduce(
        DataFrame.unionByName,
        [
            part.agg(
                F.lit(name).alias("part"),
                F.count(F.lit(1)).alias("n_rows"),
                F.min("date").alias("first_date"),
                F.max("date").alias("last_date"),
            )
            for name, part in parts
        ],
    )


@query("t10_test_summer", "SELECT * FROM company WHERE year = 2001 AND month IN (6, 7, 8)")
def t10_test_summer(spark, folder):
    series = features.company_series(sales_panel(spark, folder))
    return features.seasonal_test_rows(series, TEST_YEAR)


# Fixed values, written out here so that the SQL does not take them from the code it checks.
_NUMERIC = [
    "year", "month", "week_of_year", "store_size", "temperature", "fuel_price", "cpi", "unemployment",
    "markdown_1", "markdown_2", "markdown_3", "markdown_4", "markdown_5", "total_markdown", "is_holiday",
    "lag_1", "lag_4", "lag_8", "rolling_mean_4", "rolling_mean_8", "rolling_std_4",
]
_CATEGORICAL = ["store_id", "department", "store_type", "region", "holiday_name", "season"]
_HIDDEN = ["temperature", "fuel_price", "cpi", "unemployment"]


def _feature_counts_sql() -> str:
    """Rows with a value per feature, over the raw join of the three tables."""
    joined = """SELECT s.*, f.* EXCLUDE (store_id, date, is_holiday), t.* EXCLUDE (store_id),
            coalesce(f.markdown_1, 0) + coalesce(f.markdown_2, 0) + coalesce(f.markdown_3, 0)
              + coalesce(f.markdown_4, 0) + coalesce(f.markdown_5, 0) AS total_markdown
        FROM featured s
        LEFT JOIN features f ON f.store_id = s.store_id AND f.date = s.date
        LEFT JOIN stores t ON t.store_id = s.store_id"""
    every = [(f, "numeric") for f in _NUMERIC] + [(f, "categorical") for f in _CATEGORICAL]
    counts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{kind}' AS kind, count({f}) AS n_rows FROM r" for f, kind in every
    )
    return f"r AS ({joined}), counts AS ({counts})"


def _raw_features(spark, folder) -> DataFrame:
    joined = checks.joined_raw(
        featured_sales(spark, folder),
        orders_panel.features(spark, folder).drop("is_holiday"),
        orders_panel.stores(spark, folder),
    )
    return rollups.with_markdown_total(joined)


@query(
    "t11_scenario_features",
    f"""WITH {_feature_counts_sql()} SELECT 'full_information' AS scenario, feature, kind, n_rows FROM counts
        UNION ALL SELECT 'operational_conservative', feature, kind, n_rows FROM counts
        WHERE feature NOT IN ({", ".join(f"'{c}'" for c in _HIDDEN)})""",
)
def t11_scenario_features(spark, folder):
    df = _raw_features(spark, folder)
    used = [*features.NUMERIC_FEATURES, *features.CATEGORICAL_FEATURES]
    filled = df.agg(*[F.count(c).alias(c) for c in used]).unpivot([], used, "feature", "n_rows")
    return features.scenario_table(spark, df.columns).join(filled, "feature")


@query(
    "t12_feature_count",
    f"""WITH {_feature_counts_sql()} SELECT CAST(count(*) AS BIGINT) AS n_features, count(*) = 23 AS as_expected,
        CAST(sum(n_rows) AS BIGINT) AS n_values FROM counts WHERE feature NOT IN ({", ".join(f"'{c}'" for c in _HIDDEN)})""",
)
def t12_feature_count(spark, folder):
    rows = _raw_features(spark, folder)
    names = [c for part in features.scenario_features(features.OPERATIONAL, rows.columns) for c in part]
    features.require_feature_count(names)
    try:
        features.require_feature_count(names[1:])
        guarded = False
    except ValueError:
        guarded = True
    values = rows.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n")
    return values.agg(F.count(F.lit(1)).alias("n_features"), ((F.count(F.lit(1)) == 23) & F.lit(guarded)).alias("as_expected"), F.sum("n").alias("n_values"))


@query(
    "t13_feature_availability",
    f"""WITH {_feature_counts_sql()} SELECT CASE
          WHEN feature IN ({", ".join(f"'{c}'" for c in _HIDDEN)}) THEN 'possibly_unavailable'
          WHEN feature LIKE '%markdown%' THEN 'planned_promotion'
          WHEN feature LIKE 'lag%' OR feature LIKE 'rolling%' THEN 'sales_history'
          ELSE 'known_in_advance' END AS availability,
          count(*) AS n_features, CAST(sum(n_rows) AS BIGINT) AS n_values FROM counts GROUP BY 1""",
)
def t13_feature_availability(spark, folder):
    df = _raw_features(spark, folder)
    used = [*features.NUMERIC_FEATURES, *features.CATEGORICAL_FEATURES]
    filled = df.agg(*[F.count(c).alias(c) for c in used]).unpivot([], used, "feature", "n_rows")
    return (
        features.availability_table(spark)
        .join(filled, "feature")
        .groupBy("availability")
        .agg(F.count(F.lit(1)).alias("n_features"), F.sum("n_rows").alias("n_values"))
    )


_NEXT_WEEK = """WITH past AS (SELECT *, row_number() OVER (PARTITION BY store_id, department ORDER BY date DESC) AS age FROM sales),
    coming AS (SELECT max(date) + 7 AS date FROM sales)
  SELECT p.store_id, p.department, any_value(c.date) AS date, CAST(any_value(year(c.date)) AS INTEGER) AS year,
    CAST(any_value(month(c.date)) AS INTEGER) AS month,
    CAST(any_value(weekofyear(c.date)) AS INTEGER) AS week_of_year, any_value(t.region) AS region,
    any_value(t.store_type) AS store_type, any_value(t.store_size) AS store_size,
    CASE WHEN any_value(month(c.date)) IN (12, 1, 2) THEN 'Winter' WHEN any_value(month(c.date)) IN (3, 4, 5) THEN 'Spring'
         WHEN any_value(month(c.date)) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
    max(CASE WHEN age = 1 THEN weekly_sales END) AS lag_1, max(CASE WHEN age = 4 THEN weekly_sales END) AS lag_4,
    max(CASE WHEN age = 8 THEN weekly_sales END) AS lag_8,
    round(avg(CASE WHEN age <= 4 THEN weekly_sales END), 4) AS rolling_mean_4,
    round(avg(CASE WHEN age <= 8 THEN weekly_sales END), 4) AS rolling_mean_8,
    round(stddev_samp(CASE WHEN age <= 4 THEN weekly_sales END), 2) AS rolling_std_4
  FROM past p CROSS JOIN coming c LEFT JOIN clean_stores t ON t.store_id = p.store_id
  GROUP BY p.store_id, p.department"""


def _next_week_columns(rows: DataFrame) -> DataFrame:
    rows = rows.select(*SALES_KEY, "year", "month", "week_of_year", "region", "store_type", "store_size", "season", *features.ENGINEERED)
    return rounded(rounded(rows, "rolling_mean_4", "rolling_mean_8"), "rolling_std_4", digits=2)


@query("t14_next_week", _NEXT_WEEK)
def t14_next_week(spark, folder):
    # Of the other tables, only the stores give columns to the coming week.
    return _next_week_columns(features.next_week_rows(panel(spark, folder, "store_type", "store_size", "region")))


@query("t14_weekly_state", _NEXT_WEEK)
def t14_weekly_state(spark, folder):
    # The history up to three weeks ago, then those weeks in turn; one of them is corrected afterwards.
    known = materialize(panel(spark, folder, "store_type", "store_size", "region"), "panel")
    last = known.agg(F.max("date")).first()[0]
    kept = scratch_path(spark, "weekly-state")
    week = lambda back: known.where(F.col("date") == F.date_sub(F.lit(last), 7 * back))
    state.take_week(spark, kept, known.where(F.col("date") < F.date_sub(F.lit(last), 14)))
    for given in (week(2), week(1).withColumn("weekly_sales", F.col("weekly_sales") + 1), week(0), week(1)):
        held = state.take_week(spark, kept, given)
    return _next_week_columns(features.next_week_rows(held))
