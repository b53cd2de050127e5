"""Queries: sensitivity and rolling-origin backtest, with naive forecasts as the models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.operators import backtest, features, metrics
from retailcast.queries.accuracy import company_tests, round_measures, series_forecasts
from retailcast.queries.registry import query, rounded, sales_panel, stored_sales
from retailcast.queries.tables_sql import measures
from retailcast.session import materialize


# The four-week mean is the baseline; summed over the series it would tie with itself.
CANDIDATES = {c: n for c, n in features.NAIVE_FORECASTS.items() if c != "pred_rolling_4w"}


def complete_weeks(sales: DataFrame) -> DataFrame:
    return backtest.week_counts(features.drop_incomplete(features.series_features(sales)))


# Of the 349 complete weeks of the test tables, 280 are left for 20 folds.
INITIAL_TRAIN_WEEKS = 69


def plan(weeks: DataFrame) -> DataFrame:
    return backtest.fold_plan(weeks, INITIAL_TRAIN_WEEKS)


def fold_scores(sales: DataFrame, folds: DataFrame) -> DataFrame:
    """Every series' naive forecasts in the test weeks of all folds."""
    return backtest.with_fold(series_forecasts(sales, CANDIDATES), folds)


def results(sales: DataFrame) -> DataFrame:
    weeks = complete_weeks(sales)
    folds = plan(weeks)
    baseline = backtest.baseline_predictions(sales, folds)
    table = backtest.fold_results(weeks, fold_scores(sales, folds), baseline, folds, feature_count=1)
    # One row per fold and model, read by winners, summary and ranking.
    return materialize(table, "fold-results")


_COMPANY = ["company_mape", "company_wape", "company_forecast_bias"]
_STATS = [
    "mean_company_mape",
    "mean_company_wape",
    "median_company_wape",
    "std_company_wape",
    "min_company_wape",
    "max_company_wape",
    "mean_company_bias",
    "mean_absolute_company_bias",
]


def _rounds(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query(
    "k1_ordered_comparison",
    f"""SELECT row_number() OVER (ORDER BY mape, model) AS place, * FROM (
          SELECT model, {measures("actual", "predicted")} FROM company_long
          WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY model)""",
)
def k1_ordered_comparison(spark, folder):
    tests = company_tests(spark, folder)
    names = dict(features.NAIVE_FORECASTS)
    last = {"pred_last_week": names.pop("pred_last_week")}
    parts = [metrics.company_evaluation(tests, n) for n in (last, names)]
    ordered = metrics.by_mape(reduce(DataFrame.unionByName, parts))
    # One row per model.
    place = F.row_number().over(Window.orderBy("mape", "model")).cast("long")
    return round_measures(
        ordered.select(place.alias("place"), "model", "mae", "rmse", "mape", "wape", "forecast_bias")
    )


@query(
    "k4_sensitivity",
    """WITH measured AS (
          SELECT model, avg(abs((predicted - actual) / nullif(actual, 0))) * 100 AS mape,
                 sum(abs(predicted - actual)) / sum(abs(actual)) * 100 AS wape,
                 sum(predicted - actual) / sum(abs(actual)) * 100 AS bias
          FROM company_long WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY model),
        pairs AS (SELECT * FROM (VALUES ('A', 'Last Week Baseline', 'Rolling 4-Week Average Baseline'),
                                        ('B', 'Rolling 4-Week Average Baseline', 'Previous Year Same Week Baseline')) t(model, f, o))
       SELECT p.model, round(a.mape, 4) AS full_mape, round(b.mape, 4) AS operational_mape,
              round(b.mape - a.mape, 4) AS mape_change, round(a.wape, 4) AS full_wape,
              round(b.wape, 4) AS operational_wape, round(b.wape - a.wape, 4) AS wape_change,
              round((b.wape - a.wape) / nullif(a.wape, 0) * 100, 4) AS wape_relative_change_pct,
              round(a.bias, 4) AS full_forecast_bias, round(b.bias, 4) AS operational_forecast_bias,
              CAST(27 AS BIGINT) AS full_feature_count, CAST(23 AS BIGINT) AS operational_feature_count,
              'company_week' AS evaluation_level
       FROM pairs p JOIN measured a ON a.model = p.f JOIN measured b ON b.model = p.o""",
)
def k4_sensitivity(spark, folder):
    # Two naive forecasts stand for a model's two scenarios.
    tests = company_tests(spark, folder)
    full = {"pred_last_week": "A", "pred_rolling_4w": "B"}
    operational = {"pred_rolling_4w": "A", "pred_prev_year_same_week": "B"}
    parts = [
        metrics.company_evaluation(tests, names)
        .withColumn("scenario", F.lit(scenario))
        .withColumn("feature_count", F.lit(count).cast("long"))
        for scenario, names, count in (
            (features.FULL, full, 27),
            (features.OPERATIONAL, operational, 23),
        )
    ]
    table = backtest.sensitivity(reduce(DataFrame.unionByName, parts))
    return rounded(table, *[c for c in table.columns if c.rsplit("_", 1)[-1] in ("mape", "wape", "change", "pct", "bias")])


@query("k5_fold_plan", "SELECT * FROM plan")
def k5_fold_plan(spark, folder):
    return plan(complete_weeks(sales_panel(spark, folder)))


@query(
    "k6_split_sizes",
    """SELECT fold, CAST(n_train_rows AS BIGINT) AS n_train_rows, n_train_weeks, n_test_rows, n_test_weeks,
              n_test_weeks = 14 AS complete FROM (
         SELECT p.fold, count(*) FILTER (WHERE c.date < p.test_start) AS n_train_rows,
                count(DISTINCT CASE WHEN c.date < p.test_start THEN c.date END) AS n_train_weeks,
                count(*) FILTER (WHERE c.date BETWEEN p.test_start AND p.test_end) AS n_test_rows,
                count(DISTINCT CASE WHEN c.date BETWEEN p.test_start AND p.test_end THEN c.date END) AS n_test_weeks
         FROM plan p CROSS JOIN complete c GROUP BY p.fold)""",
)
def k6_split_sizes(spark, folder):
    weeks = complete_weeks(sales_panel(spark, folder))
    return backtest.split_sizes(weeks, plan(weeks))


@query(
    "k7_fold_measures",
    f"""SELECT c.fold, c.model, round(company_mae, 2) AS company_mae, round(company_rmse, 2) AS company_rmse,
               {_rounds(_COMPANY)}, g.n_test_rows, c.n_test_weeks, g.granular_mape, g.granular_wape, g.granular_forecast_bias
        FROM fold_company c JOIN (
          SELECT fold, model, count(*) AS n_test_rows,
            round(avg(abs((predicted - weekly_sales) / nullif(weekly_sales, 0))) * 100, 4) AS granular_mape,
            round(sum(abs(predicted - weekly_sales)) / sum(abs(weekly_sales)) * 100, 4) AS granular_wape,
            round(sum(predicted - weekly_sales) / sum(abs(weekly_sales)) * 100, 4) AS granular_forecast_bias
          FROM candidates JOIN tested USING (date) WHERE predicted IS NOT NULL GROUP BY ALL) g
        ON g.fold = c.fold AND g.model = c.model""",
)
def k7_fold_measures(spark, folder):
    sales = stored_sales(spark, folder)
    scored = fold_scores(sales, plan(complete_weeks(sales)))
    out = backtest.fold_measures(backtest.weekly_sums(scored))
    out = rounded(out, "company_mae", "company_rmse", digits=2)
    return rounded(out, *_COMPANY, "granular_mape", "granular_wape", "granular_forecast_bias")


@query(
    "k8_baseline_folds",
    f"""SELECT fold, model, round(company_mae, 2) AS company_mae, round(company_rmse, 2) AS company_rmse,
               {_rounds(_COMPANY)}, n_test_weeks FROM fold_company WHERE model = 'Rolling 4-Week Baseline'""",
)
def k8_baseline_folds(spark, folder):
    sales = stored_sales(spark, folder)
    weekly = backtest.baseline_predictions(sales, plan(complete_weeks(sales)))
    out = metrics.metrics(weekly, "actual_total_sales", "predicted_total_sales", ["fold", "model"], "n_test_weeks")
    out = out.withColumnsRenamed({n: f"company_{n}" for n in ("mae", "rmse", "mape", "wape", "forecast_bias")})
    return rounded(rounded(out, "company_mae", "company_rmse", digits=2), *_COMPANY)


@query(
    "k9_weekly_predictions",
    """SELECT fold, model, date, actual_total_sales, round(predicted_total_sales, 2) AS predicted_total_sales
       FROM fold_weekly""",
)
def k9_weekly_predictions(spark, folder):
    sales = stored_sales(spark, folder)
    folds = plan(complete_weeks(sales))
    weekly = backtest.weekly_predictions(
        fold_scores(sales, folds), backtest.baseline_predictions(sales, folds)
    )
    return rounded(weekly, "predicted_total_sales", digits=2)


@query(
    "k10_fold_results",
    f"""SELECT c.fold, c.model, p.train_start, p.train_end, p.test_start, p.test_end, p.n_train_weeks, c.n_test_weeks,
               (SELECT count(*) FROM complete r WHERE r.date < p.test_start) AS n_train_rows, g.n_test_rows,
               CAST(CASE WHEN c.model = 'Rolling 4-Week Baseline' THEN 0 ELSE 1 END AS BIGINT) AS feature_count,
               round(g.wape, 4) AS granular_wape, round(g.mape, 4) AS granular_mape, round(g.bias, 4) AS granular_forecast_bias,
               round(company_mae, 2) AS company_mae, round(company_rmse, 2) AS company_rmse, {_rounds(_COMPANY)},
               'company_week' AS evaluation_level, 'one_week_ahead' AS forecast_horizon,
               CASE WHEN c.model = 'Rolling 4-Week Baseline' THEN 'baseline' ELSE 'operational_conservative' END AS scenario
        FROM fold_company c JOIN plan p ON p.fold = c.fold LEFT JOIN (
          SELECT fold, model, count(*) AS n_test_rows, sum(abs(predicted - weekly_sales)) / sum(abs(weekly_sales)) * 100 AS wape,
                 avg(abs((predicted - weekly_sales) / nullif(weekly_sales, 0))) * 100 AS mape,
                 sum(predicted - weekly_sales) / sum(abs(weekly_sales)) * 100 AS bias
          FROM candidates JOIN tested USING (date) WHERE predicted IS NOT NULL GROUP BY ALL) g
        ON g.fold = c.fold AND g.model = c.model""",
)
def k10_fold_results(spark, folder):
    out = rounded(results(stored_sales(spark, folder)), "company_mae", "company_rmse", digits=2)
    return rounded(out, *_COMPANY, "granular_wape", "granular_mape", "granular_forecast_bias")


@query(
    "k11_fold_winners",
    "SELECT fold, winning_model, round(winning_company_wape, 4) AS winning_company_wape FROM winners",
)
def k11_fold_winners(spark, folder):
    return rounded(backtest.fold_winners(results(stored_sales(spark, folder))), "winning_company_wape")


@query("k12_cross_fold_summary", f"SELECT model, folds, {_rounds(_STATS)} FROM summary")
def k12_cross_fold_summary(spark, folder):
    return rounded(backtest.cross_fold_summary(results(stored_sales(spark, folder))), *_STATS)


@query("k13_fold_wins", "SELECT model, folds, fold_wins FROM summary")
def k13_fold_wins(spark, folder):
    table = results(stored_sales(spark, folder))
    summary = backtest.cross_fold_summary(table)
    return backtest.with_fold_wins(summary, backtest.fold_winners(table)).select("model", "folds", "fold_wins")


@query("k14_ranking", f"SELECT rank, model, folds, {_rounds(_STATS)}, fold_wins FROM summary")
def k14_ranking(spark, folder):
    return rounded(backtest.backtest_summary(results(stored_sales(spark, folder))), *_STATS)
