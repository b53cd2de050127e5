"""Feature-availability sensitivity and rolling-origin backtesting."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.functions.accuracy import METRIC_NAMES, error, metric_columns
from retailcast.operators import features as ft
from retailcast.operators.metrics import COMPANY_LEVEL
from retailcast.session import materialize

# The default plan of folds and the labels of its results.
INITIAL_TRAIN_WEEKS = 64
TEST_WEEKS = 14
BASELINE = "Rolling 4-Week Baseline"
HORIZON = "one_week_ahead"


# --- fold plan ----------------------------------------------------------------------------------


def week_counts(rows: DataFrame) -> DataFrame:
    """Rows per week, written once: a few hundred rows that stand in for ``rows`` when folds are
    planned and sized."""
    return materialize(rows.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n")), "week-counts")


def fold_plan(
    weeks: DataFrame,
    initial_train_weeks: int = INITIAL_TRAIN_WEEKS,
    test_weeks: int = TEST_WEEKS,
    strict: bool = True,
) -> DataFrame:
    """Expanding-window folds over the dates of ``weeks`` (see ``week_counts``).

    ``strict`` wants the weeks after the first training period to fill whole folds; otherwise that
    period takes in the weeks left over, so that every later week is tested. Either way, a plan
    without a fold is an error.
    """
    weeks = weeks.select("date").distinct()
    # One number per call comes to the driver.
    remaining = weeks.count() - initial_train_weeks
    if remaining <= 0:
        raise ValueError(f"no week is left to test: the first training period takes {initial_train_weeks} weeks")
    if strict and remaining % test_weeks:
        raise ValueError(f"folds of {test_weeks} weeks do not fill the {remaining} weeks after the first training period")
    if remaining < test_weeks:
        raise ValueError(f"a fold takes {test_weeks} weeks, and only {remaining} come after the first training period")
    initial_train_weeks += remaining % test_weeks
    # The window runs over distinct weeks, a few hundred rows at any scale.
    numbered = weeks.withColumn("n", F.row_number().over(Window.orderBy("date")))
    fold = F.floor((F.col("n") - initial_train_weeks - 1) / F.lit(test_weeks)) + 1
    marked = numbered.withColumns(
        {
            "fold": F.when(F.col("n") > initial_train_weeks, fold.cast("int")),
            "train_start": F.min("date").over(Window.orderBy("date")),
            "train_end": F.lag("date").over(Window.orderBy("date")),
        }
    )
    return (
        marked.where(F.col("fold").isNotNull())
        .groupBy("fold")
        .agg(
            F.min("train_start").alias("train_start"),
            F.min("train_end").alias("train_end"),
            F.min("date").alias("test_start"),
            F.max("date").alias("test_end"),
            (F.min("n") - 1).cast("long").alias("n_train_weeks"),
            F.count(F.lit(1)).alias("n_test_weeks"),
        )
        .orderBy("fold")
    )


@dataclass(frozen=True)
class Fold:
    number: int
    test_start: dt.date
    test_end: dt.date


def folds(plan: DataFrame) -> list[Fold]:
    """The plan as driver objects, one small row per fold, for fitting models per fold."""
    rows = plan.select("fold", "test_start", "test_end").orderBy("fold").collect()
    return [Fold(r["fold"], r["test_start"], r["test_end"]) for r in rows]


def fold_split(rows: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    return ft.time_split(rows, fold.test_start, fold.test_end)


def with_fold(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the fold whose test period holds the row's date; other rows are left out.

    Test periods do not overlap, so this is an equality join on the days of the plan's test periods,
    a few thousand rows for decades of weeks, hence the broadcast.
    """
    tests = plan.select(
        "fold", F.explode(F.sequence("test_start", "test_end", F.expr("interval 1 day"))).alias("date")
    )
    return df.join(F.broadcast(tests), "date")


def split_sizes(weeks: DataFrame, plan: DataFrame, test_weeks: int = TEST_WEEKS) -> DataFrame:
    """Training and test rows and weeks of each fold, from the rows per week.

    Every fold trains on all weeks before its test period, so a running sum over the weeks gives
    its training part.
    """
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    running = weeks.withColumns(
        {
            "rows_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "weeks_before": F.count("n").over(before),
        }
    )
    return (
        with_fold(running, plan)
        .groupBy("fold")
        .agg(
            F.min("rows_before").alias("n_train_rows"),
            F.min("weeks_before").alias("n_train_weeks"),
            F.sum("n").alias("n_test_rows"),
            F.count(F.lit(1)).alias("n_test_weeks"),
        )
        .withColumn("complete", F.col("n_test_weeks") == test_weeks)
        .orderBy("fold")
    )


def require_complete_folds(weeks: DataFrame, plan: DataFrame, test_weeks: int = TEST_WEEKS) -> None:
    bad = [r["fold"] for r in split_sizes(weeks, plan, test_weeks).where("not complete").collect()]
    if bad:
        raise ValueError(f"folds {bad} do not have {test_weeks} test weeks")


# --- scoring ------------------------------------------------------------------------------------


def baseline_predictions(panel: DataFrame, plan: DataFrame) -> DataFrame:
    """The four-week mean of company sales in every test week, taken from the whole history."""
    series = ft.company_forecasts(panel)
    return (
        with_fold(series, plan)
        .where(F.col("pred_rolling_4w").isNotNull())
        .select(
            "fold",
            F.lit(BASELINE).alias("model"),
            "date",
            F.col("total_weekly_sales").cast("double").alias("actual_total_sales"),
            F.col("pred_rolling_4w").alias("predicted_total_sales"),
        )
    )


def weekly_sums(scored: DataFrame, actual: str = "weekly_sales") -> DataFrame:
    """Scored rows (fold, model, date, actual, predicted) summed to weeks, in one pass.

    The sums of a week are enough for every measure of both levels.
    """
    a = F.col(actual).cast("double")
    e = error(a, F.col("predicted"))
    ratio = F.when(a != 0, F.abs(F.try_divide(e, a)))
    return (
        scored.where(F.col("predicted").isNotNull())
        .groupBy("fold", "model", "date")
        .agg(
            F.sum(actual).cast("double").alias("actual_total_sales"),
            F.sum("predicted").alias("predicted_total_sales"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count(ratio).alias("n_ratio"),
            F.sum(ratio).alias("sum_ratio"),
            F.sum(F.abs(e)).alias("sum_abs_error"),
            F.sum(F.abs(a)).alias("sum_abs_actual"),
            F.sum(e).alias("sum_error"),
        )
    )


def weekly_predictions(scored: DataFrame, baseline: DataFrame, actual: str = "weekly_sales") -> DataFrame:
    """All models and the baseline, week by week."""
    models = weekly_sums(scored, actual).select(baseline.columns)
    return models.unionByName(baseline).orderBy("fold", "model", "date")


def fold_measures(weekly: DataFrame) -> DataFrame:
    """Company and series measures per fold and model; a model without series rows (the baseline)
    gets company measures only."""
    return weekly.groupBy("fold", "model").agg(
        *metric_columns(F.col("actual_total_sales"), F.col("predicted_total_sales"), "company_"),
        F.count(F.lit(1)).alias("n_test_weeks"),
        F.sum("n_rows").alias("n_test_rows"),
        (F.try_divide(F.sum("sum_ratio"), F.sum("n_ratio")) * 100).alias("granular_mape"),
        (F.try_divide(F.sum("sum_abs_error"), F.sum("sum_abs_actual")) * 100).alias("granular_wape"),
        (F.try_divide(F.sum("sum_error"), F.sum("sum_abs_actual")) * 100).alias(
            "granular_forecast_bias"
        ),
    )


def fold_results(
    weeks: DataFrame,
    scored: DataFrame,
    baseline: DataFrame,
    plan: DataFrame,
    feature_count: int,
    actual: str = "weekly_sales",
    scenario: str = ft.OPERATIONAL,
    test_weeks: int = TEST_WEEKS,
) -> DataFrame:
    """One row per fold and model: bounds, sizes, series measures and company measures.

    ``weeks`` counts the rows that training and testing draw from; ``scored`` holds the test
    rows of all folds and models with their forecasts.
    """
    weekly = weekly_sums(scored, actual).unionByName(baseline, allowMissingColumns=True)
    sizes = split_sizes(weeks, plan, test_weeks).select("fold", "n_train_rows")
    bounds = plan.select("fold", "train_start", "train_end", "test_start", "test_end", "n_train_weeks")
    is_baseline = F.col("model") == BASELINE
    # Both right sides have one row per fold.
    return (
        fold_measures(weekly)
        .join(F.broadcast(bounds), "fold")
        .join(F.broadcast(sizes), "fold")
        .select(
            "fold",
            "model",
            "train_start",
            "train_end",
            "test_start",
            "test_end",
            "n_train_weeks",
            "n_test_weeks",
            "n_train_rows",
            "n_test_rows",
            F.when(is_baseline, 0).otherwise(feature_count).cast("long").alias("feature_count"),
            "granular_mape",
            "granular_wape",
            "granular_forecast_bias",
            *[f"company_{n}" for n in METRIC_NAMES],
            F.lit(COMPANY_LEVEL).alias("evaluation_level"),
            F.lit(HORIZON).alias("forecast_horizon"),
            F.when(is_baseline, "baseline").otherwise(scenario).alias("scenario"),
        )
        .orderBy("fold", F.asc_nulls_last("company_wape"), "model")
    )


# --- selection ----------------------------------------------------------------------------------


def fold_winners(results: DataFrame) -> DataFrame:
    """The model with the lowest company WAPE per fold; of equals, the first by name."""
    best = F.min_by(
        F.struct("model", "company_wape"), F.struct("company_wape", "model")
    )
    return (
        results.where(F.col("company_wape").isNotNull())
        .groupBy("fold")
        .agg(best.alias("best"))
        .select(
            "fold",
            F.col("best.model").alias("winning_model"),
            F.col("best.company_wape").alias("winning_company_wape"),
        )
        .orderBy("fold")
    )


def cross_fold_summary(results: DataFrame) -> DataFrame:
    wape, bias = "company_wape", "company_forecast_bias"
    return results.groupBy("model").agg(
        F.count_distinct("fold").alias("folds"),
        F.avg("company_mape").alias("mean_company_mape"),
        F.avg(wape).alias("mean_company_wape"),
        F.median(wape).alias("median_company_wape"),
        F.stddev_samp(wape).alias("std_company_wape"),
        F.min(wape).alias("min_company_wape"),
        F.max(wape).alias("max_company_wape"),
        F.avg(bias).alias("mean_company_bias"),
        F.avg(F.abs(bias)).alias("mean_absolute_company_bias"),
    )


def with_fold_wins(summary: DataFrame, winners: DataFrame) -> DataFrame:
    """Add how many folds each model won, zero for none."""
    wins = winners.groupBy(F.col("winning_model").alias("model")).agg(F.count(F.lit(1)).alias("fold_wins"))
    return summary.join(wins, "model", "left").fillna(0, subset=["fold_wins"])


def ranked(summary: DataFrame) -> DataFrame:
    """Rank by mean, then by spread of the company WAPE; of equals, by name."""
    # One row per model.
    order = Window.orderBy(
        F.asc_nulls_last("mean_company_wape"), F.asc_nulls_last("std_company_wape"), "model"
    )
    return summary.select(F.row_number().over(order).cast("long").alias("rank"), *summary.columns)


def backtest_summary(results: DataFrame) -> DataFrame:
    return ranked(with_fold_wins(cross_fold_summary(results), fold_winners(results)))


# --- sensitivity --------------------------------------------------------------------------------


def sensitivity(comparison: DataFrame, full: str = ft.FULL, operational: str = ft.OPERATIONAL) -> DataFrame:
    """What each model loses without the features that may be unknown at forecast time.

    ``comparison`` has one company-level row per scenario and model with its measures and
    ``feature_count``; models found in one scenario only are left out.
    """
    picked = ["mape", "wape", "forecast_bias", "feature_count"]
    side = lambda scenario: F.max(F.when(F.col("scenario") == scenario, F.struct(*picked)))
    both = (
        comparison.groupBy("model")
        .agg(side(full).alias("a"), side(operational).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    change = F.col("b.wape") - F.col("a.wape")
    return both.select(
        "model",
        F.col("a.mape").alias("full_mape"),
        F.col("b.mape").alias("operational_mape"),
        (F.col("b.mape") - F.col("a.mape")).alias("mape_change"),
        F.col("a.wape").alias("full_wape"),
        F.col("b.wape").alias("operational_wape"),
        change.alias("wape_change"),
        (F.try_divide(change, F.col("a.wape")) * 100).alias("wape_relative_change_pct"),
        F.col("a.forecast_bias").alias("full_forecast_bias"),
        F.col("b.forecast_bias").alias("operational_forecast_bias"),
        F.col("a.feature_count").alias("full_feature_count"),
        F.col("b.feature_count").alias("operational_feature_count"),
        F.lit(COMPANY_LEVEL).alias("evaluation_level"),
    ).orderBy(F.asc_nulls_last("full_wape"), "model")
