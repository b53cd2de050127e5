"""Forecast evaluation at series level, company level and by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions.accuracy import METRIC_NAMES, metric_columns
from retailcast.schema import SALES_KEY

COMPANY_LEVEL = "company_week"
SERIES_LEVEL = "store_department_week"


def metrics(
    df: DataFrame, actual: str, predicted: str, by: list[str] | None = None, count_name: str = "n"
) -> DataFrame:
    """All five accuracy measures per group, rows without a forecast left out."""
    return (
        df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
        .groupBy(*(by or []))
        .agg(*metric_columns(F.col(actual), F.col(predicted)), F.count(F.lit(1)).alias(count_name))
    )


def long_forecasts(df: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per forecast column: (keep..., model, predicted)."""
    options = [
        F.struct(F.lit(model).alias("model"), F.col(column).cast("double").alias("predicted"))
        for column, model in names.items()
    ]
    return df.select(*keep, F.explode(F.array(*options)).alias("s")).select(
        *keep, "s.model", "s.predicted"
    )


def evaluate(df: DataFrame, actual: str, level: str, by: list[str] | None = None) -> DataFrame:
    """Measures per model of a long forecast table, with the evaluation level."""
    count_name = "n_test_weeks" if level == COMPANY_LEVEL else "n_test_rows"
    keys = by or ["model"]
    return metrics(df, actual, "predicted", keys, count_name).select(
        *keys, *METRIC_NAMES, count_name, F.lit(level).alias("evaluation_level")
    )


def company_evaluation(forecasts: DataFrame, names: dict[str, str], actual: str = "total_weekly_sales") -> DataFrame:
    """Company-week measures of each forecast column."""
    return evaluate(long_forecasts(forecasts, names, [actual]), actual, COMPANY_LEVEL)


def series_evaluation(long: DataFrame, actual: str = "weekly_sales") -> DataFrame:
    """Store-department-week measures of each model."""
    return evaluate(long, actual, SERIES_LEVEL)


def to_company_weeks(long: DataFrame, actual: str = "weekly_sales", by: list[str] | None = None) -> DataFrame:
    """Sum the forecasts of all series to weeks; rows without a forecast count on neither side."""
    return (
        long.where(F.col("predicted").isNotNull())
        .groupBy(*(by or ["model"]), "date")
        .agg(
            F.sum(actual).cast("double").alias("actual_total_sales"),
            F.sum("predicted").alias("predicted_total_sales"),
        )
    )


def summed_evaluation(long: DataFrame, actual: str = "weekly_sales", by: list[str] | None = None) -> DataFrame:
    """Company-week measures of series forecasts summed to weeks."""
    weeks = to_company_weeks(long, actual, by).withColumnRenamed("predicted_total_sales", "predicted")
    return evaluate(weeks, "actual_total_sales", COMPANY_LEVEL, by)


def by_mape(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(F.asc_nulls_last("mape"), "model")


def prediction_table(long: DataFrame, models: dict[str, str], actual: str = "weekly_sales") -> DataFrame:
    """Wide form: key, actual, and one column per model (``models`` maps column to model)."""
    picks = [F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(c) for c, m in models.items()]
    return long.groupBy(*SALES_KEY, actual).agg(*picks)
