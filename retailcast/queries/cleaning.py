"""Queries: cleaning, imputation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailcast import schema
from retailcast.functions import columns as fx
from retailcast.operators import checks, clean, rollups
from retailcast.queries.registry import panel, query, rounded
from retailcast.session import materialize
from retailcast.sources import orders_panel

_KEYS = "store_id, department, date"


@query("c1_drop_missing_target", f"SELECT {_KEYS}, weekly_sales FROM bad_sales WHERE weekly_sales IS NOT NULL")
def c1_drop_missing_target(spark, folder):
    sales = orders_panel.faulty_sales(spark, folder)
    return clean.drop_missing_target(sales).select(*schema.SALES_KEY, "weekly_sales")


@query(
    "c2_negative_flag",
    f"SELECT {_KEYS}, weekly_sales, weekly_sales < 0 AS is_negative_sales FROM bad_sales WHERE weekly_sales IS NOT NULL",
)
def c2_negative_flag(spark, folder):
    sales = clean.drop_missing_target(orders_panel.faulty_sales(spark, folder))
    return clean.flag_negative_sales(sales).select(*schema.SALES_KEY, "weekly_sales", "is_negative_sales")


@query("c3_calendar", f"SELECT {_KEYS}, year, month, week_of_year FROM clean_sales")
def c3_calendar(spark, folder):
    return fx.with_calendar(orders_panel.sales(spark, folder)).select(
        *schema.SALES_KEY, "year", "month", "week_of_year"
    )


@query("c4_fill_markdowns", f"SELECT store_id, date, {', '.join(schema.MARKDOWNS)} FROM store_filled")
def c4_fill_markdowns(spark, folder):
    filled = clean.fill_markdowns(orders_panel.features(spark, folder))
    return filled.select(*schema.FEATURES_KEY, *schema.MARKDOWNS)


@query(
    "c5_impute_by_store",
    f"SELECT store_id, date, {', '.join(f'round({c}, 4) AS {c}' for c in schema.ECONOMY)} FROM clean_features",
)
def c5_impute_by_store(spark, folder):
    filled = clean.impute_by_store(materialize(orders_panel.features(spark, folder), "features"))
    return rounded(filled.select(*schema.FEATURES_KEY, *schema.ECONOMY), *schema.ECONOMY)


@query("c6_fill_texts", "SELECT store_id, date, holiday_name, season FROM clean_features")
def c6_fill_texts(spark, folder):
    filled = clean.fill_texts(orders_panel.features(spark, folder))
    return filled.select(*schema.FEATURES_KEY, "holiday_name", "season")


@query(
    "c7_fill_store_size",
    "SELECT store_id, store_type, round(store_size, 4) AS store_size, region FROM clean_stores",
)
def c7_fill_store_size(spark, folder):
    return rounded(clean.clean_stores(orders_panel.stores(spark, folder)), "store_size")


@query(
    "c8_join_features",
    f"""SELECT s.store_id, s.department, s.date, s.weekly_sales, s.is_holiday AS is_holiday_sales,
               f.is_holiday AS is_holiday_features, f.* EXCLUDE (store_id, date, is_holiday)
        FROM bad_sales s LEFT JOIN bad_features f ON f.store_id = s.store_id AND f.date = s.date""",
)
def c8_join_features(spark, folder):
    joined = checks.join_on_store_week(
        orders_panel.faulty_sales(spark, folder), orders_panel.faulty_features(spark, folder)
    )
    return joined


@query(
    "c9_join_stores",
    f"""SELECT s.store_id, department, date, weekly_sales, store_type, store_size, region
        FROM sales s LEFT JOIN bad_stores t ON t.store_id = s.store_id""",
)
def c9_join_stores(spark, folder):
    joined = checks.join_on_store(
        orders_panel.sales(spark, folder), orders_panel.faulty_stores(spark, folder)
    )
    return joined.drop("is_holiday")


@query(
    "c10_unify_holiday",
    # Where both tables have the column, the sales' flag counts; the features' flags differ on planted rows.
    "SELECT s.store_id, s.department, s.date, s.is_holiday FROM bad_sales s",
)
def c10_unify_holiday(spark, folder):
    joined = checks.join_on_store_week(
        orders_panel.faulty_sales(spark, folder), orders_panel.faulty_features(spark, folder)
    )
    return clean.unify_holiday(joined).select(*schema.SALES_KEY, "is_holiday")


@query("c11_summer_panel", "SELECT * EXCLUDE (total_markdown) FROM panel")
def c11_summer_panel(spark, folder):
    return panel(spark, folder)


@query(
    "c12_total_markdown",
    """SELECT store_id, date, round(coalesce(markdown_1, 0) + coalesce(markdown_2, 0) + coalesce(markdown_3, 0)
         + coalesce(markdown_4, 0) + coalesce(markdown_5, 0), 4) AS total_markdown FROM features""",
)
def c12_total_markdown(spark, folder):
    # Nulls count as zero, so the raw features will do.
    df = orders_panel.features(spark, folder)
    return rounded(
        df.select(*schema.FEATURES_KEY, fx.total_markdown(schema.MARKDOWNS).alias("total_markdown")),
        "total_markdown",
    )


@query(
    "c13_has_markdown",
    """SELECT store_id, date, CAST(coalesce(markdown_1, 0) + coalesce(markdown_2, 0) + coalesce(markdown_3, 0)
         + coalesce(markdown_4, 0) + coalesce(markdown_5, 0) > 0 AS INTEGER) AS has_markdown FROM features""",
)
def c13_has_markdown(spark, folder):
    df = rollups.with_markdown_total(orders_panel.features(spark, folder))
    return df.select(*schema.FEATURES_KEY, "has_markdown")


@query(
    "c14_season",
    """SELECT store_id, date, CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Spring'
         WHEN month(date) <= 8 THEN 'Summer' ELSE 'Fall' END AS season FROM features""",
)
def c14_season(spark, folder):
    # As for a source that brings no season of its own.
    bare = orders_panel.features(spark, folder).drop("season")
    return bare.select(*schema.FEATURES_KEY, fx.season_of(F.month("date")).alias("season"))


@query(
    "c15_labels",
    """SELECT store_id, date, CASE month(date) WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' END AS month_name,
         CASE is_holiday WHEN 1 THEN 'Holiday' WHEN 0 THEN 'Non-Holiday' END AS holiday_type,
         CASE WHEN coalesce(markdown_1, markdown_2, markdown_3, markdown_4, markdown_5) IS NULL
              OR coalesce(markdown_1, 0) + coalesce(markdown_2, 0) + coalesce(markdown_3, 0)
                 + coalesce(markdown_4, 0) + coalesce(markdown_5, 0) = 0
              THEN 'No Markdown' ELSE 'With Markdown' END AS markdown_type FROM features""",
)
def c15_labels(spark, folder):
    df = rollups.with_markdown_total(orders_panel.features(spark, folder))
    return df.select(
        *schema.FEATURES_KEY,
        fx.label(F.month("date"), fx.MONTH_NAMES).alias("month_name"),
        fx.label(F.col("is_holiday"), fx.HOLIDAY_TYPES).alias("holiday_type"),
        fx.label(F.col("has_markdown"), fx.MARKDOWN_TYPES).alias("markdown_type"),
    )
