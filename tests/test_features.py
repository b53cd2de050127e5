"""Series features: guards, boundaries, leakage and row order."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailcast.operators import features

START = dt.date(2022, 1, 1)
SCHEMA = "store_id long, department int, date date, weekly_sales double"


def series(values, store=1, department=1):
    return [(store, department, START + dt.timedelta(weeks=i), v) for i, v in enumerate(values)]


def featured(spark, rows):
    df = features.series_features(spark.createDataFrame(rows, SCHEMA))
    return {(r["store_id"], r["department"], r["date"]): r.asDict() for r in df.collect()}


def test_rolling_mean_needs_four_rows(spark):
    got = featured(spark, series([1.0, 2.0, 3.0, 4.0, 5.0, 6.0]))
    means = [got[1, 1, START + dt.timedelta(weeks=i)]["rolling_mean_4"] for i in range(6)]
    assert means == [None, None, None, None, 2.5, 3.5]


def test_null_inside_the_window(spark):
    got = featured(spark, series([1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]))
    means = [got[1, 1, START + dt.timedelta(weeks=i)]["rolling_mean_4"] for i in range(9)]
    assert means == [None] * 7 + [5.5, 6.5]


def test_series_do_not_mix(spark):
    got = featured(spark, series([1.0, 2.0]) + series([5.0, 6.0], department=2))
    assert got[1, 1, START]["lag_1"] is None and got[1, 2, START]["lag_1"] is None
    assert got[1, 2, START + dt.timedelta(weeks=1)]["lag_1"] == 5.0


def test_lags_count_rows(spark):
    rows = [r for r in series([1.0, 2.0, 3.0, 4.0]) if r[3] != 3.0]
    got = featured(spark, rows)
    assert got[1, 1, START + dt.timedelta(weeks=3)]["lag_1"] == 2.0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-100, 100), min_size=12, max_size=20), st.integers(8, 11), st.integers(0, 999))
def test_no_leakage_and_no_row_order(spark, values, at, seed):
    rows = series(values)
    before = featured(spark, rows)
    changed = list(rows)
    changed[at] = (*changed[at][:3], changed[at][3] + 1000.0)
    random.Random(seed).shuffle(changed)
    after = featured(spark, changed)
    day = START + dt.timedelta(weeks=at)
    for key, row in before.items():
        same = {c: after[key][c] for c in features.ENGINEERED}
        if key[2] <= day:
            assert same == {c: row[c] for c in features.ENGINEERED}


def test_next_week_equals_later_features(spark):
    values = [float((i * 7) % 11) for i in range(20)]
    full = featured(spark, series(values) + series(values[::-1], store=2))
    past = series(values)[:-1] + series(values[::-1], store=2)[:-1]
    df = spark.createDataFrame(past, SCHEMA)
    for row in features.next_week_rows(df).collect():
        assert row["date"] == START + dt.timedelta(weeks=19) and row["weekly_sales"] is None
        later = full[row["store_id"], row["department"], row["date"]]
        for name in features.ENGINEERED:
            assert row[name] == pytest.approx(later[name])


def test_next_week_takes_planned_columns(spark):
    df = spark.createDataFrame(series([1.0] * 9), SCHEMA)
    planned = spark.createDataFrame(
        [(1, START + dt.timedelta(weeks=9), 1, "Fair")], "store_id long, date date, is_holiday int, holiday_name string"
    )
    row = features.next_week_rows(df, planned).first()
    assert row["is_holiday"] == 1 and row["holiday_name"] == "Fair" and row["season"] == "Spring"


def test_next_week_moves_only_recent_rows(spark):
    df = spark.createDataFrame(series([1.0] * 9), SCHEMA)
    plan = features.next_week_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_iso_week(spark):
    df = spark.createDataFrame(series([1.0]), SCHEMA)
    row = features.company_series(df).first()
    assert (row["year"], row["week_of_year"], row["is_summer"]) == (2022, 52, 0)


def test_incomplete_rows(spark):
    df = features.series_features(spark.createDataFrame(series([1.0] * 10), SCHEMA))
    row = features.incomplete_counts(df).first()
    assert (row["rows_before"], row["rows_after"], row["rows_removed"]) == (10, 2, 8)
    assert features.drop_incomplete(df).count() == 2


def test_series_features_use_one_shuffle(spark):
    df = spark.createDataFrame(series([1.0] * 10), SCHEMA)
    plan = features.series_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_time_split_and_guard(spark):
    df = spark.createDataFrame(series([1.0] * 4), SCHEMA)
    train, test = features.time_split(df, START + dt.timedelta(weeks=2), START + dt.timedelta(weeks=2))
    assert (train.count(), test.count()) == (2, 1)
    with pytest.raises(ValueError, match="test part"):
        features.require_nonempty(train, test.where(F.lit(False)))


def test_scenarios():
    full, operational = features.scenario_features(features.FULL), features.scenario_features(features.OPERATIONAL)
    assert (len(full[0]), len(full[1])) == (21, 6)
    features.require_feature_count(operational[0] + operational[1])
    with pytest.raises(ValueError, match="take 23"):
        features.require_feature_count(full[0] + full[1])
    every = [f for group in features.AVAILABILITY.values() for f in group]
    assert sorted(every) == sorted(full[0] + full[1])
