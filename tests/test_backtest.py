"""Fold plans, splits and rankings."""

import datetime as dt

import pytest

from retailcast.operators import backtest, kpi

START = dt.date(2022, 2, 26)


def weeks(spark, n, rows=3):
    days = [START + dt.timedelta(weeks=i) for i in range(n)]
    return backtest.week_counts(spark.createDataFrame([(d,) for d in days for _ in range(rows)], ["date"]))


def test_plan_of_148_weeks(spark):
    plan = backtest.fold_plan(weeks(spark, 148)).collect()
    got = [(r["fold"], r["test_start"].isoformat(), r["test_end"].isoformat(), r["n_train_weeks"]) for r in plan]
    # The published plan of folds.
    assert got == [
        (1, "2023-05-20", "2023-08-19", 64),
        (2, "2023-08-26", "2023-11-25", 78),
        (3, "2023-12-02", "2024-03-02", 92),
        (4, "2024-03-09", "2024-06-08", 106),
        (5, "2024-06-15", "2024-09-14", 120),
        (6, "2024-09-21", "2024-12-21", 134),
    ]
    assert all(r["train_start"] == START and r["n_test_weeks"] == 14 for r in plan)
    assert all(r["train_end"] == r["test_start"] - dt.timedelta(weeks=1) for r in plan)


def test_plan_must_divide(spark):
    with pytest.raises(ValueError, match="do not fill"):
        backtest.fold_plan(weeks(spark, 149))
    with pytest.raises(ValueError, match="no week"):
        backtest.fold_plan(weeks(spark, 64))
    with pytest.raises(ValueError, match="a fold takes"):
        backtest.fold_plan(weeks(spark, 70), strict=False)
    plan = backtest.fold_plan(weeks(spark, 149), strict=False).collect()
    assert len(plan) == 6 and plan[0]["n_train_weeks"] == 65
    assert plan[-1]["test_end"] == START + dt.timedelta(weeks=148)


def test_split_sizes(spark):
    counts = weeks(spark, 92)
    plan = backtest.fold_plan(counts)
    got = [tuple(r) for r in backtest.split_sizes(counts, plan).collect()]
    assert got == [(1, 192, 64, 42, 14, True), (2, 234, 78, 42, 14, True)]
    backtest.require_complete_folds(counts, plan)
    with pytest.raises(ValueError, match="test weeks"):
        backtest.require_complete_folds(counts.where(counts["date"] != START + dt.timedelta(weeks=70)), plan)


def test_fold_split_expands(spark):
    counts = weeks(spark, 92)
    first, second = backtest.folds(backtest.fold_plan(counts))
    for fold, train_weeks in ((first, 64), (second, 78)):
        train, test = backtest.fold_split(counts, fold)
        assert (train.count(), test.count()) == (train_weeks, 14)


def test_series_and_company_measures_differ(spark):
    day = START
    rows = [(1, "m", day, 10.0, 20.0), (1, "m", day, 30.0, 20.0), (1, "m", day, 0.0, 0.0), (1, "m", day, 5.0, None)]
    scored = spark.createDataFrame(rows, "fold int, model string, date date, weekly_sales double, predicted double")
    row = backtest.fold_measures(backtest.weekly_sums(scored)).first()
    assert row["company_wape"] == 0 and row["granular_wape"] == pytest.approx(50)
    assert row["granular_mape"] == pytest.approx((1 + 1 / 3) / 2 * 100)
    assert (row["n_test_rows"], row["n_test_weeks"]) == (3, 1)


def test_holiday_lift_needs_both_kinds(spark):
    df = spark.createDataFrame([("Holiday", 3.0), ("Non-Holiday", 2.0)], "holiday_type string, avg_weekly_sales double")
    assert kpi.holiday_lift(df).first()[0] == pytest.approx(50)
    assert kpi.holiday_lift(df.limit(1)).first()[0] is None


def test_kpi_table_orders_and_formats(spark):
    one = spark.createDataFrame([(2022, 2024, 7.6449)], "first_year int, last_year int, summer_sales_growth_pct double")
    two = spark.createDataFrame([("Forest", 5)], "selected_model string, fold_wins int")
    got = [(r["metric"], r["value"]) for r in kpi.kpi_table([two, one]).collect()]
    assert got == [
        ("first_year", "2022"),
        ("last_year", "2024"),
        ("summer_sales_growth_pct", "7.64"),
        ("selected_model", "Forest"),
        ("fold_wins", "5"),
    ]
