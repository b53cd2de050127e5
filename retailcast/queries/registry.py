"""The registry of queries, and helpers they share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast import schema
from retailcast.operators import clean
from retailcast.operators import features as ft
from retailcast.queries.tables_sql import with_tables
from retailcast.session import materialize, materialize_alone
from retailcast.sources import orders_panel

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TEST_YEAR = 2001
TEST_START, TEST_END = dt.date(2001, 6, 1), dt.date(2001, 8, 31)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the shared tables of ``tables_sql``."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = with_tables(sql)
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Ratios and deviations are compared to a fixed number of decimals."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def raw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        orders_panel.sales(spark, folder),
        orders_panel.features(spark, folder),
        orders_panel.stores(spark, folder),
    )


def faulty(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        orders_panel.faulty_sales(spark, folder),
        orders_panel.faulty_features(spark, folder),
        orders_panel.faulty_stores(spark, folder),
    )


def panel(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The panel, with the named columns of features and stores if any are named."""
    features, used = orders_panel.features(spark, folder), list(columns) or None
    if used is None or set(used) & (set(schema.FEATURES.names) - set(schema.SALES.names)):
        # Imputing reads the features several times, and here they come from a join.
        if used is not None:
            features = features.select(*schema.FEATURES_KEY, *[c for c in features.columns if c in used and c not in schema.FEATURES_KEY])
        features = materialize_alone(features, "features")
    return clean.panel(
        orders_panel.sales(spark, folder), features, orders_panel.stores(spark, folder),
        columns=used, parts=orders_panel.partitions(spark, folder),
    )


def stored(tables: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two derived tables written, for queries that read them several times."""
    sales, features, stores = tables
    return materialize(sales, "sales"), materialize(features, "features"), stores


def sales_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel's sales side, for operators that need no features or stores."""
    return clean.clean_sales(orders_panel.sales(spark, folder))


def stored_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The panel's sales side, written once for a query that reads it several times."""
    return materialize(sales_panel(spark, folder), "sales-panel")


def featured_sales(spark: SparkSession, folder: str) -> DataFrame:
    return ft.series_features(sales_panel(spark, folder))
