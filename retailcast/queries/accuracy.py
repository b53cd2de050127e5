"""Queries: accuracy measures, fed by the naive forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailcast.functions import accuracy as acc
from retailcast.operators import features, metrics
from retailcast.queries.registry import TEST_YEAR, query, rounded, sales_panel
from retailcast.queries.tables_sql import measures
from retailcast.schema import SALES_KEY, SERIES_KEY

_E = "(predicted - actual)"


def company_tests(spark, folder):
    return features.seasonal_test_rows(features.company_forecasts(sales_panel(spark, folder)), TEST_YEAR)


def series_forecasts(sales, names=features.NAIVE_FORECASTS):
    """Naive forecasts of every series and week, in long form."""
    wide = features.naive_forecasts(sales, "weekly_sales", SERIES_KEY)
    return metrics.long_forecasts(wide, names, [*SALES_KEY, "weekly_sales", "year", "month"])


def series_tests(spark, folder):
    return features.seasonal_test_rows(series_forecasts(sales_panel(spark, folder)), TEST_YEAR)


def round_measures(df):
    df = rounded(df, *[c for c in ("mae", "rmse") if c in df.columns], digits=2)
    return rounded(df, *[c for c in ("mape", "wape", "forecast_bias") if c in df.columns])


def _company_measure(spark, folder, name, measure, digits):
    long = metrics.long_forecasts(
        company_tests(spark, folder), features.NAIVE_FORECASTS, ["total_weekly_sales"]
    ).where(F.col("predicted").isNotNull())
    value = measure(F.col("total_weekly_sales"), F.col("predicted"))
    return rounded(long.groupBy("model").agg(value.alias(name)), name, digits=digits)


def _company_sql(name: str, expression: str, digits: int) -> str:
    return f"""SELECT model, round({expression}, {digits}) AS {name} FROM company_long
        WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY model"""


@query("m1_mae", _company_sql("mae", f"avg(abs({_E}))", 2))
def m1_mae(spark, folder):
    return _company_measure(spark, folder, "mae", acc.mae, 2)


@query("m2_rmse", _company_sql("rmse", f"sqrt(avg({_E} * {_E}))", 2))
def m2_rmse(spark, folder):
    return _company_measure(spark, folder, "rmse", acc.rmse, 2)


@query("m3_mape", _company_sql("mape", f"avg(abs({_E} / nullif(actual, 0))) * 100", 4))
def m3_mape(spark, folder):
    return _company_measure(spark, folder, "mape", acc.mape, 4)


@query("m4_wape", _company_sql("wape", f"sum(abs({_E})) / nullif(sum(abs(actual)), 0) * 100", 4))
def m4_wape(spark, folder):
    return _company_measure(spark, folder, "wape", acc.wape, 4)


@query("m5_forecast_bias", _company_sql("forecast_bias", f"sum({_E}) / nullif(sum(abs(actual)), 0) * 100", 4))
def m5_forecast_bias(spark, folder):
    return _company_measure(spark, folder, "forecast_bias", acc.forecast_bias, 4)


@query(
    "m6_company_evaluation",
    f"""SELECT model, {measures("actual", "predicted")}, count(*) AS n_test_weeks, 'company_week' AS evaluation_level
        FROM company_long WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY model""",
)
def m6_company_evaluation(spark, folder):
    return round_measures(metrics.company_evaluation(company_tests(spark, folder), features.NAIVE_FORECASTS))


@query(
    "m7_series_evaluation",
    f"""SELECT model, {measures("weekly_sales", "predicted")}, count(*) AS n_test_rows,
               'store_department_week' AS evaluation_level
        FROM series_long WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY model""",
)
def m7_series_evaluation(spark, folder):
    return round_measures(metrics.series_evaluation(series_tests(spark, folder)))


@query(
    "m8_summed_evaluation",
    f"""SELECT model, {measures("actual", "predicted")}, count(*) AS n_test_weeks, 'company_week' AS evaluation_level
        FROM (SELECT model, date, CAST(sum(weekly_sales) AS DOUBLE) AS actual, sum(predicted) AS predicted
              FROM series_long WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY ALL)
        GROUP BY model""",
)
def m8_summed_evaluation(spark, folder):
    return round_measures(metrics.summed_evaluation(series_tests(spark, folder)))


def _by_sql(key: str) -> str:
    return f"""SELECT {key}, model, {measures("weekly_sales", "predicted")}, count(*) AS n
        FROM series_long WHERE predicted IS NOT NULL GROUP BY ALL"""


@query("m9_error_by_store", _by_sql("store_id"))
def m9_error_by_store(spark, folder):
    long = series_forecasts(sales_panel(spark, folder))
    return round_measures(metrics.metrics(long, "weekly_sales", "predicted", ["store_id", "model"]))


@query("m9_error_by_department", _by_sql("department"))
def m9_error_by_department(spark, folder):
    long = series_forecasts(sales_panel(spark, folder))
    return round_measures(metrics.metrics(long, "weekly_sales", "predicted", ["department", "model"]))
