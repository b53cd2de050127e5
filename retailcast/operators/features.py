"""Series features, forecasts by history, time splits and feature scenarios."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from retailcast.functions.columns import is_summer, season_of, with_calendar
from retailcast.schema import FEATURES_KEY, MARKDOWNS, SERIES_KEY

# The feature lists of the two scenarios and when each feature is known.
LAGS = [1, 4, 8]
MEANS = [4, 8]
DEVIATIONS = [4]
ENGINEERED = ["lag_1", "lag_4", "lag_8", "rolling_mean_4", "rolling_mean_8", "rolling_std_4"]
NUMERIC_FEATURES = [
    "year",
    "month",
    "week_of_year",
    "store_size",
    "temperature",
    "fuel_price",
    "cpi",
    "unemployment",
    *MARKDOWNS,
    "total_markdown",
    "is_holiday",
    *ENGINEERED,
]
CATEGORICAL_FEATURES = ["store_id", "department", "store_type", "region", "holiday_name", "season"]
AVAILABILITY = {
    "known_in_advance": [
        "year",
        "month",
        "week_of_year",
        "store_id",
        "department",
        "store_type",
        "store_size",
        "region",
        "season",
        "is_holiday",
        "holiday_name",
    ],
    "sales_history": ENGINEERED,
    "planned_promotion": [*MARKDOWNS, "total_markdown"],
    "possibly_unavailable": ["temperature", "fuel_price", "cpi", "unemployment"],
}
FULL = "full_information"
OPERATIONAL = "operational_conservative"
OPERATIONAL_COUNT = 23

NAIVE_FORECASTS = {
    "pred_last_week": "Last Week Baseline",
    "pred_rolling_4w": "Rolling 4-Week Average Baseline",
    "pred_prev_year_same_week": "Previous Year Same Week Baseline",
}


# --- company series -----------------------------------------------------------------------------


def company_series(panel: DataFrame) -> DataFrame:
    """Total sales per week with its calendar fields."""
    weekly = (
        panel.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.coalesce(F.sum("weekly_sales"), F.lit(0)).alias("total_weekly_sales"))
    )
    return with_calendar(weekly).withColumn("is_summer", is_summer(F.col("month")))


def past_mean(column: str, weeks: int, order: WindowSpec) -> Column:
    """Mean of the preceding ``weeks`` rows, NULL unless all of them have a value."""
    frame = order.rowsBetween(-weeks, -1)
    return F.when(F.count(column).over(frame) == weeks, F.avg(column).over(frame))


def past_deviation(column: str, weeks: int, order: WindowSpec) -> Column:
    frame = order.rowsBetween(-weeks, -1)
    return F.when(F.count(column).over(frame) == weeks, F.stddev_samp(column).over(frame))


def naive_forecasts(series: DataFrame, value: str, key: list[str] | None = None) -> DataFrame:
    """Last week, mean of four weeks, and the week 52 rows earlier.

    Without a key there is one series, so ``series`` must already be summed to weeks: the window
    then sees as many rows as there are weeks.
    """
    order = Window.partitionBy(*(key or [])).orderBy("date")
    return series.withColumns(
        {
            "pred_last_week": F.lag(value, 1).over(order),
            "pred_rolling_4w": past_mean(value, 4, order),
            "pred_prev_year_same_week": F.lag(value, 52).over(order),
        }
    )


def company_forecasts(panel: DataFrame) -> DataFrame:
    return naive_forecasts(company_series(panel), "total_weekly_sales")


def seasonal_test_rows(df: DataFrame, year: int, months: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    return df.where((F.col("year") == year) & F.col("month").isin(*months))


# --- features per series ------------------------------------------------------------------------


def lag_features(panel: DataFrame) -> DataFrame:
    order = Window.partitionBy(*SERIES_KEY).orderBy("date")
    return panel.withColumns({f"lag_{n}": F.lag("weekly_sales", n).over(order) for n in LAGS})


def rolling_means(panel: DataFrame) -> DataFrame:
    order = Window.partitionBy(*SERIES_KEY).orderBy("date")
    return panel.withColumns({f"rolling_mean_{n}": past_mean("weekly_sales", n, order) for n in MEANS})


def rolling_deviations(panel: DataFrame) -> DataFrame:
    order = Window.partitionBy(*SERIES_KEY).orderBy("date")
    return panel.withColumns(
        {f"rolling_std_{n}": past_deviation("weekly_sales", n, order) for n in DEVIATIONS}
    )


def series_features(panel: DataFrame) -> DataFrame:
    """All lag and rolling features: one shuffle and one sort by series for the six of them."""
    return rolling_deviations(rolling_means(lag_features(panel)))


def drop_incomplete(features: DataFrame) -> DataFrame:
    return features.dropna(subset=ENGINEERED)


def incomplete_counts(features: DataFrame) -> DataFrame:
    """Rows before and after ``drop_incomplete``, from one pass."""
    complete = F.lit(True)
    for name in ENGINEERED:
        complete = complete & F.col(name).isNotNull()
    return features.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(complete).alias("rows_after")
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def time_split(df: DataFrame, start: dt.date, end: dt.date) -> tuple[DataFrame, DataFrame]:
    """Rows before ``start``, and rows from ``start`` to ``end``."""
    date = F.col("date")
    return df.where(date < F.lit(start)), df.where(date.between(F.lit(start), F.lit(end)))


def require_nonempty(train: DataFrame, test: DataFrame) -> None:
    for name, part in (("training", train), ("test", test)):
        if part.isEmpty():
            raise ValueError(f"the {name} part of the time split is empty")


# --- scenarios ----------------------------------------------------------------------------------


def scenario_features(name: str, columns: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical features of a scenario, limited to existing ``columns`` if given."""
    if name not in (FULL, OPERATIONAL):
        raise ValueError(f"unknown scenario {name}")
    hidden = AVAILABILITY["possibly_unavailable"] if name == OPERATIONAL else []
    keep = lambda f: f not in hidden and (columns is None or f in columns)
    return [f for f in NUMERIC_FEATURES if keep(f)], [f for f in CATEGORICAL_FEATURES if keep(f)]


def require_feature_count(features: list[str], expected: int = OPERATIONAL_COUNT) -> None:
    if len(features) != expected:
        raise ValueError(f"the models take {expected} features, but the list names {len(features)}")


def scenario_table(spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
    rows = []
    for scenario in (FULL, OPERATIONAL):
        numeric, categorical = scenario_features(scenario, columns)
        rows += [(scenario, f, "numeric") for f in numeric]
        rows += [(scenario, f, "categorical") for f in categorical]
    return spark.createDataFrame(rows, "scenario string, feature string, kind string")


def availability_table(spark: SparkSession) -> DataFrame:
    rows = [(f, group) for group, features in AVAILABILITY.items() for f in features]
    return spark.createDataFrame(rows, "feature string, availability string")


# --- the coming week ----------------------------------------------------------------------------


def next_week_rows(panel: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Rows to score for the week after the last one, as they stand when that week is still ahead.

    They hold the calendar, the store's attributes and the history features of the sales so far;
    sales are NULL. ``planned`` may give holidays and promotions per store and date. The economy
    columns are unknown ahead of the week and are left out.
    """
    carried = [c for c in ("store_type", "store_size", "region") if c in panel.columns]
    base = panel.select(*SERIES_KEY, "date", "weekly_sales", *carried)
    last = base.agg(F.max("date")).scalar()
    # The features look back at most this many rows; the ranking filter is applied on both sides
    # of the shuffle, so only those rows of each series move.
    reach = max(LAGS + MEANS)
    latest = Window.partitionBy(*SERIES_KEY).orderBy(F.desc("date"))
    recent = base.withColumn("age", F.row_number().over(latest)).where(F.col("age") <= reach)
    # The coming week is one more row next to the latest row of each series.
    steps = F.when(F.col("age") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    grown = recent.withColumn("step", F.explode(steps)).withColumn("last_date", last)
    coming = F.col("step") == 1
    rows = grown.select(
        *SERIES_KEY,
        F.when(coming, F.date_add("last_date", 7)).otherwise(F.col("date")).alias("date"),
        F.when(~coming, F.col("weekly_sales")).alias("weekly_sales"),
        *carried,
        coming.alias("is_coming"),
    )
    out = with_calendar(series_features(rows).where("is_coming").drop("is_coming"))
    out = out.withColumn("season", season_of(F.col("month")))
    return out if planned is None else out.join(planned, FEATURES_KEY, "left")
