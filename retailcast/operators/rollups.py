"""Descriptive rollups of the summer months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions.columns import (
    HOLIDAY_TYPES,
    MARKDOWN_TYPES,
    MONTH_NAMES,
    SUMMER_MONTHS,
    columns_starting,
    has_markdown,
    label,
    total_markdown,
)


def with_markdown_total(df: DataFrame) -> DataFrame:
    parts = columns_starting(df, "markdown")
    return df.withColumn("total_markdown", total_markdown(parts)).withColumn(
        "has_markdown", has_markdown(F.col("total_markdown"))
    )


def summer(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("month").isin(*SUMMER_MONTHS))


def subset_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.array_join(F.sort_array(F.collect_set("year")), ",").alias("years"),
        F.array_join(F.sort_array(F.collect_set("month")), ",").alias("months"),
        F.count_distinct("store_id").alias("n_stores"),
        F.count_distinct("department").alias("n_departments"),
    )


def total_by(df: DataFrame, key: str, name: str = "total_sales") -> DataFrame:
    """Total sales per value of ``key``; rows without a value are left out."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.coalesce(F.sum("weekly_sales"), F.lit(0)).alias(name))
    )


def mean_by(df: DataFrame, key: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("weekly_sales").alias("avg_weekly_sales"))
    )


def sales_by_year(df: DataFrame) -> DataFrame:
    return total_by(df, "year", "total_summer_sales").orderBy("year")


def sales_by_month(df: DataFrame) -> DataFrame:
    return (
        total_by(df, "month").withColumn("month_name", label(F.col("month"), MONTH_NAMES)).orderBy("month")
    )


def sales_by_week(df: DataFrame) -> DataFrame:
    return total_by(df, "date", "total_weekly_sales").orderBy("date")


def sales_by_holiday(df: DataFrame) -> DataFrame:
    return mean_by(df, "is_holiday").withColumn(
        "holiday_type", label(F.col("is_holiday"), HOLIDAY_TYPES)
    )


def sales_by_markdown(df: DataFrame) -> DataFrame:
    return mean_by(df, "has_markdown").withColumn(
        "markdown_type", label(F.col("has_markdown"), MARKDOWN_TYPES)
    )


def ranked_totals(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Totals per key, highest first; equal totals in key order."""
    ordered = total_by(df, key).orderBy(F.desc("total_sales"), key)
    return ordered if top is None else ordered.limit(top)


def sales_by_temperature(df: DataFrame) -> DataFrame:
    return mean_by(df, "temperature").orderBy("temperature")


def temperature_points(df: DataFrame) -> DataFrame:
    return df.select("temperature", "weekly_sales")
