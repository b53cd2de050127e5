"""Business figures from the rollups and the backtest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.functions.columns import label

# Fixed value: part of the name that marks the baseline among the models.
BASELINE_NAME_PART = "Rolling 4-Week"


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def growth(summer: DataFrame) -> DataFrame:
    """Growth from the first to the last year, in total and per week.

    The years may hold different numbers of weeks, hence the per-week figure beside the total.
    """
    yearly = (
        summer.where(F.col("year").isNotNull())
        .groupBy("year", "date")
        .agg(F.coalesce(F.sum("weekly_sales"), F.lit(0)).alias("s"))
        .groupBy("year")
        .agg(F.sum("s").cast("double").alias("total"), F.count(F.lit(1)).alias("weeks"))
    )
    ends = yearly.agg(
        F.min_by(F.struct("year", "total", "weeks"), "year").alias("a"),
        F.max_by(F.struct("year", "total", "weeks"), "year").alias("b"),
    )
    per_week = lambda s: F.col(f"{s}.total") / F.col(f"{s}.weeks")
    return ends.select(
        F.col("a.year").alias("first_year"),
        F.col("b.year").alias("last_year"),
        _pct(F.col("b.total") - F.col("a.total"), F.col("a.total")).alias("summer_sales_growth_pct"),
        F.col("a.weeks").alias("first_year_weeks"),
        F.col("b.weeks").alias("last_year_weeks"),
        _pct(per_week("b") - per_week("a"), per_week("a")).alias("growth_per_week_pct"),
    )


def best_month(summer: DataFrame, names: dict[int, str]) -> DataFrame:
    """The month with the highest total, with its mean per week."""
    monthly = (
        summer.where(F.col("month").isNotNull())
        .groupBy("month", "date")
        .agg(F.coalesce(F.sum("weekly_sales"), F.lit(0)).alias("s"))
        .groupBy("month")
        .agg(F.sum("s").cast("double").alias("total"), F.avg("s").alias("avg_week"))
    )
    best = monthly.agg(
        F.max_by(F.struct("month", "total", "avg_week"), F.struct("total", -F.col("month"))).alias("m")
    )
    return best.select(
        label(F.col("m.month"), names).alias("best_summer_month"),
        F.col("m.total").alias("best_summer_month_sales"),
        F.col("m.avg_week").alias("best_summer_month_avg_week"),
    )


def holiday_lift(by_holiday: DataFrame) -> DataFrame:
    """Mean sales of holiday weeks against others; NULL if one of the two is absent."""
    mean = lambda kind: F.max(F.when(F.col("holiday_type") == kind, F.col("avg_weekly_sales")))
    return by_holiday.agg(mean("Holiday").alias("h"), mean("Non-Holiday").alias("o")).select(
        _pct(F.col("h") - F.col("o"), F.col("o")).alias("holiday_lift_pct")
    )


def top_group(totals: DataFrame, key: str) -> DataFrame:
    """The group with the highest total; of equals, the first in key order."""
    ordered = totals.orderBy(F.desc("total_sales"), key).limit(1)
    return ordered.select(
        F.col(key).alias(f"top_{key}"), F.col("total_sales").cast("double").alias(f"top_{key}_sales")
    )


def selected_model(summary: DataFrame) -> DataFrame:
    """The first model of the backtest with its statistics."""
    first = summary.orderBy("rank", "mean_company_wape").limit(1)
    return first.select(
        F.col("model").alias("selected_model"),
        "mean_company_mape",
        "mean_company_wape",
        "median_company_wape",
        "std_company_wape",
        "min_company_wape",
        "max_company_wape",
        "mean_company_bias",
        "mean_absolute_company_bias",
        "fold_wins",
        F.col("folds").alias("total_folds"),
    )


def wape_reduction(summary: DataFrame) -> DataFrame:
    """How far the selected model's mean WAPE lies below the baseline's; NULL without a baseline."""
    is_baseline = F.col("model").ilike(f"%{BASELINE_NAME_PART}%")
    wape = F.col("mean_company_wape")
    return summary.agg(
        F.min_by(F.when(is_baseline, wape), F.when(is_baseline, F.col("rank"))).alias(
            "rolling_baseline_mean_wape"
        ),
        F.min_by(wape, "rank").alias("best"),
    ).select(
        "rolling_baseline_mean_wape",
        _pct(F.col("rolling_baseline_mean_wape") - F.col("best"), F.col("rolling_baseline_mean_wape")).alias(
            "wape_reduction_over_baseline_pct"
        ),
    )


def winning_folds(summary: DataFrame, winners: DataFrame) -> DataFrame:
    """The folds that the selected model won, as a sorted list."""
    chosen = selected_model(summary).select("selected_model")
    won = winners.groupBy(F.col("winning_model").alias("selected_model")).agg(
        F.sort_array(F.collect_list("fold")).alias("folds_won")
    )
    return chosen.join(won, "selected_model", "left").select(
        "selected_model", F.coalesce(F.col("folds_won"), F.array().cast("array<int>")).alias("folds_won")
    )


# The metrics of the table in their order, with the decimals of the numeric ones.
KPI_DECIMALS = {
    "first_year": 0,
    "last_year": 0,
    "summer_sales_growth_pct": 2,
    "best_summer_month": None,
    "best_summer_month_sales": 2,
    "top_store_type": None,
    "top_store_type_sales": 2,
    "top_region": None,
    "top_region_sales": 2,
    "selected_model": None,
    "mean_company_mape": 4,
    "mean_company_wape": 4,
    "median_company_wape": 4,
    "std_company_wape": 4,
    "min_company_wape": 4,
    "max_company_wape": 4,
    "mean_company_bias": 4,
    "mean_absolute_company_bias": 4,
    "fold_wins": 0,
    "total_folds": 0,
    "rolling_baseline_mean_wape": 4,
    "wape_reduction_over_baseline_pct": 2,
}


def _as_text(value: Column, decimals: int | None) -> Column:
    if decimals is None:
        return value.cast("string")
    return F.round(value.cast("double"), decimals).cast(f"decimal(38,{decimals})").cast("string")


def kpi_table(figures: list[DataFrame]) -> DataFrame:
    """The tall table (position, metric, value) from one-row frames; values are texts."""
    # Each frame is one row: turned tall on its own, so that nothing needs to be joined.
    position = {m: i for i, m in enumerate(KPI_DECIMALS, start=1)}
    parts = []
    for frame in figures:
        rows = [
            F.struct(
                F.lit(position[c]).cast("long").alias("position"),
                F.lit(c).alias("metric"),
                _as_text(F.col(c), KPI_DECIMALS[c]).alias("value"),
            )
            for c in frame.columns
            if c in KPI_DECIMALS
        ]
        parts.append(frame.select(F.explode(F.array(*rows)).alias("s")).select("s.*"))
    return reduce(DataFrame.unionByName, parts).orderBy("position")
