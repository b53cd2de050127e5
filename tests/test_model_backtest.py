"""The backtest with models takes the folds of the other backtests, whole."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from retailcast.operators import backtest, features, models
from retailcast.queries import modelling
from retailcast.queries.backtests import complete_weeks, plan
from retailcast.queries.registry import sales_panel

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_models_run_over_every_fold_of_the_plan(spark, monkeypatch):
    # The fits are left out here: what is scored are the actual values.
    def actuals(rows, folds, *_, **__):
        scored = backtest.with_fold(rows, spark.createDataFrame([(f.number, f.test_start, f.test_end) for f in folds], "fold int, test_start date, test_end date"))
        return scored.select("fold", "date", "weekly_sales", F.lit("actual").alias("model"), F.col("weekly_sales").cast("double").alias("predicted"))

    monkeypatch.setattr(modelling.models, "backtest_scores", actuals)
    rows = modelling.k7_model_backtest(spark, FOLDER).where("model = 'actual'").collect()
    bounds = lambda r: (r["fold"], r["train_start"], r["train_end"], r["test_start"], r["test_end"], r["n_train_weeks"], r["n_test_weeks"])
    want = plan(complete_weeks(sales_panel(spark, FOLDER))).collect()
    assert len(want) == 20
    assert sorted(map(bounds, rows)) == sorted(map(bounds, want))


def test_models_have_their_published_sizes(spark, monkeypatch):
    """The backtest fits what the library's defaults say, not the smaller trees of the other queries."""
    first = dt.date(1995, 1, 7)
    names = [*features.NUMERIC_FEATURES, *features.CATEGORICAL_FEATURES]
    weeks = [(first + dt.timedelta(weeks=n), 1, *[None] * len(names)) for n in range(69 + 14)]
    rows = spark.createDataFrame(weeks, "date date, weekly_sales long, " + ", ".join(f"{n} string" for n in names))
    seen = []

    def scores(rows, folds, numeric, categorical, sizes, at_once):
        seen.append(sizes)
        return rows.selectExpr("1 AS fold", "date", "weekly_sales", "'any' AS model", "1D AS predicted").where(F.col("date") >= F.lit(folds[0].test_start))

    monkeypatch.setattr(modelling, "model_rows", lambda *_: rows)
    monkeypatch.setattr(modelling, "sales_panel", lambda *_: rows.select("date", "weekly_sales", F.year("date").alias("year")))
    monkeypatch.setattr(modelling.models, "backtest_scores", scores)
    assert modelling.k7_model_backtest(spark, "no folder").where("model = 'any'").count() == 1
    assert seen == [models.Sizes(models=(models.FOREST, models.BOOSTED))]
    assert (seen[0].forest_trees, seen[0].forest_depth, seen[0].boosting_rounds, seen[0].boosting_depth) == (100, 12, 300, 6)
