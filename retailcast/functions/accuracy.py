"""Forecast accuracy as plain aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC_NAMES = ["mae", "rmse", "mape", "wape", "forecast_bias"]


def error(actual: Column, predicted: Column) -> Column:
    return predicted.cast("double") - actual.cast("double")


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(error(actual, predicted)))


def rmse(actual: Column, predicted: Column) -> Column:
    e = error(actual, predicted)
    return F.sqrt(F.avg(e * e))


def mape(actual: Column, predicted: Column) -> Column:
    """Rows whose actual is zero have no percentage error and are skipped; NULL if none is left."""
    ratio = F.abs(F.try_divide(error(actual, predicted), actual.cast("double")))
    return F.avg(F.when(actual != 0, ratio)) * 100


def wape(actual: Column, predicted: Column) -> Column:
    return F.try_divide(F.sum(F.abs(error(actual, predicted))), F.sum(F.abs(actual.cast("double")))) * 100


def forecast_bias(actual: Column, predicted: Column) -> Column:
    """Positive when the forecast is above the actual overall."""
    return F.try_divide(F.sum(error(actual, predicted)), F.sum(F.abs(actual.cast("double")))) * 100


def metric_columns(actual: Column, predicted: Column, prefix: str = "") -> list[Column]:
    functions = [mae, rmse, mape, wape, forecast_bias]
    return [f(actual, predicted).alias(prefix + n) for f, n in zip(functions, METRIC_NAMES)]
