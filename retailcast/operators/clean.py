"""Cleaning, imputation and the safe join of the three tables into one panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.functions.columns import columns_starting, is_summer, with_calendar
from retailcast.functions.quantiles import exact_median, exact_quantiles
from retailcast.operators import checks
from retailcast.schema import ECONOMY, FEATURES_KEY, RAW_KEYS, STORES_KEY
from retailcast.session import materialize_alone

# What a missing text becomes.
TEXT_DEFAULTS = {
    "holiday_name": "Non-Holiday",
    "season": "Unknown",
    "store_type": "Unknown",
    "region": "Unknown",
}
# What clean_sales adds; all of it follows from the date and the sales of a row.
DERIVED = ["is_negative_sales", "year", "month", "week_of_year"]


def drop_missing_target(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("weekly_sales").isNotNull())


def flag_negative_sales(sales: DataFrame) -> DataFrame:
    """Mark returns; they stay in the data."""
    return sales.withColumn("is_negative_sales", F.coalesce(F.col("weekly_sales") < 0, F.lit(False)))


def fill_markdowns(features: DataFrame) -> DataFrame:
    return features.fillna(0, subset=columns_starting(features, "markdown"))


def fill_store_median(features: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the median of their store (bounded: one row per week)."""
    store = Window.partitionBy("store_id")
    return features.withColumns({c: F.coalesce(F.col(c), F.median(c).over(store)) for c in columns})


def impute_by_store(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Store median first, then the median of the column as filled so far."""
    columns = [c for c in (columns or ECONOMY) if c in features.columns]
    if not columns:
        return features
    # The medians of the whole column take two more passes over what the windows give.
    filled = materialize_alone(fill_store_median(features, columns), "filled-by-store")
    medians = (
        exact_quantiles(filled, columns, [0.5])
        .agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])
        .select(F.struct(*columns).alias("m"))
        .scalar()
    )
    return (
        filled.withColumn("medians", medians)
        .withColumns({c: F.coalesce(F.col(c), F.col("medians")[c]) for c in columns})
        .drop("medians")
    )


def fill_texts(df: DataFrame) -> DataFrame:
    return df.fillna({c: v for c, v in TEXT_DEFAULTS.items() if c in df.columns})


def fill_store_size(stores: DataFrame) -> DataFrame:
    if "store_size" not in stores.columns:
        return stores
    return stores.withColumn(
        "store_size", F.coalesce(F.col("store_size"), exact_median(stores, "store_size"))
    )


def clean_sales(sales: DataFrame) -> DataFrame:
    return with_calendar(flag_negative_sales(drop_missing_target(sales)))


def derive_after(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step``, which shuffles ``df``, without the columns that ``clean_sales`` derives from others of their row: they
    are made again behind it, in the same places."""
    narrow, order = step(df.drop(*DERIVED)), step(df).columns
    if not {*DERIVED, "date", "weekly_sales"} <= set(order) or set(DERIVED) & set(narrow.columns):
        return step(df)  # names of both sides that clash mean other columns
    return with_calendar(flag_negative_sales(narrow)).select(order)


def clean_features(features: DataFrame) -> DataFrame:
    return fill_texts(impute_by_store(fill_markdowns(features)))


def clean_stores(stores: DataFrame) -> DataFrame:
    return fill_texts(fill_store_size(stores))


def unify_holiday(df: DataFrame) -> DataFrame:
    """One holiday flag: the one from sales, or else the one from features."""
    pair = [c for c in ("is_holiday_sales", "is_holiday_features") if c in df.columns]
    return df.withColumn("is_holiday", F.col(pair[0])).drop(*pair) if pair else df


def panel(
    sales: DataFrame, features: DataFrame, stores: DataFrame, columns: list[str] | None = None, parts: int | None = None
) -> DataFrame:
    """Clean the raw tables and join them: one lazy plan without guards, one row per sales row.

    With ``columns`` the panel holds the sales columns and those of the other tables that are
    named; a table that gives none of them is neither cleaned nor joined. A many-to-one left join
    adds columns and never rows, but the optimizer cannot know that the right keys are unique.
    ``parts`` is the number of parts that sales and features are joined in.
    """
    out = clean_sales(sales)
    if columns is not None:
        held = set(out.columns)
        features = features.select(*_picked(features, FEATURES_KEY, columns, held))
        stores = stores.select(*_picked(stores, STORES_KEY, columns, held))
    if len(features.columns) > len(FEATURES_KEY):
        known = clean_features(features)
        out = unify_holiday(derive_after(out, lambda rows: checks.join_on_store_week(rows, known, parts)))
    if len(stores.columns) > len(STORES_KEY):
        out = checks.join_on_store(out, clean_stores(stores))
    return out.withColumn("is_summer", is_summer(F.col("month")))


def _picked(df: DataFrame, key: list[str], columns: list[str], held: set[str]) -> list[str]:
    return [*key, *[c for c in df.columns if c in columns and c not in key and c not in held]]


def require_joinable(sales: DataFrame, features: DataFrame, stores: DataFrame) -> None:
    """Stop unless keys are unique and present, every sales row has its partners, and flags agree.

    With unique right keys a left join keeps the row count, so it needs no count of its own.
    """
    for name, df in (("sales", sales), ("features", features), ("stores", stores)):
        checks.require_no_null_key(df, RAW_KEYS[name], name)
        checks.require_unique_key(df, RAW_KEYS[name], name)
    checks.require_matched(sales, features, FEATURES_KEY, "features")
    checks.require_matched(sales, stores, STORES_KEY, "stores")
    n = checks.holiday_mismatch(sales, features).count()
    if n:
        raise ValueError(f"{n} store-dates have different holiday flags in sales and features")


def checked_panel(sales: DataFrame, features: DataFrame, stores: DataFrame) -> DataFrame:
    """The panel, after all guards have passed."""
    require_joinable(sales, features, stores)
    return panel(sales, features, stores)


