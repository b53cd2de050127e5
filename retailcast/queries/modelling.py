"""Queries: models fitted as Spark jobs.

Tree models are smaller here than by default, to keep a query short, but for the backtest, which has the
default sizes; they read all rows, and every comparison holds all three models. Every query makes the fits that it compares, and no others.
Fits with closed forms have SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retailcast.operators import arima, backtest, clean, features, metrics, models, rollups
from retailcast.queries.accuracy import company_tests, round_measures
from retailcast.queries.backtests import plan as backtest_plan
from retailcast.queries.registry import (
    TEST_END,
    TEST_START,
    panel,
    query,
    rounded,
    sales_panel,
)
from retailcast.queries.tables_sql import measures
from retailcast.schema import SERIES_KEY
from retailcast.session import materialize
from retailcast.sources import orders_panel

SIZES = models.Sizes(forest_trees=10, forest_depth=6, boosting_rounds=5, boosting_depth=4, boosting_rate=0.3)


def _only(*names: str) -> models.Sizes:
    return models.Sizes(**{**SIZES.__dict__, "models": names})


def _series_panel(spark, folder, *columns: str):
    """The panel, dealt to tasks by series."""
    parts = orders_panel.partitions(spark, folder)
    return clean.derive_after(panel(spark, folder, *columns), lambda rows: rows.repartition(parts, *SERIES_KEY))


def model_rows(spark, folder, scenario=features.FULL):
    featured = features.series_features(rollups.with_markdown_total(_series_panel(spark, folder)))
    numeric, categorical = features.scenario_features(scenario, featured.columns)
    return models.model_rows(featured, numeric + categorical)


def split(spark, folder, scenario=features.FULL):
    """Training and test rows, with the features of the scenario."""
    return features.time_split(model_rows(spark, folder, scenario), TEST_START, TEST_END)


def scenario_forecasts(spark, folder, *names: str, scenarios=(features.FULL, features.OPERATIONAL)):
    """Forecasts of the named models, or of all, in the scenarios; written, as comparisons read them several times."""
    train, test = split(spark, folder)
    sizes = _only(*names) if names else SIZES
    return materialize(models.scenario_grid(train, test, sizes, scenarios), "scenario-forecasts")


def _forecast(spark, folder, *names: str):
    rows = scenario_forecasts(spark, folder, *names, scenarios=(features.OPERATIONAL,))
    return rows.drop("scenario", "feature_count")


def _lag_or_month(spark, folder, feature: str, sizes: models.Sizes):
    """Measures of a model of one feature, whose fit has a closed form."""
    rows = models.model_rows(features.series_features(sales_panel(spark, folder)), [feature])
    train, test = features.time_split(rows, TEST_START, TEST_END)
    scored = models.fit_and_score(train, test, [feature], [], sizes)
    return round_measures(metrics.series_evaluation(scored))


@query(
    "l1_fill_values",
    """WITH train AS (SELECT * FROM complete WHERE date < DATE '2001-06-01')
       SELECT 'lag_1' AS feature, CAST(round(median(lag_1), 4) AS VARCHAR) AS value FROM train
       UNION ALL SELECT 'rolling_mean_8', CAST(round(median(rolling_mean_8), 4) AS VARCHAR) FROM train
       UNION ALL SELECT 'week_of_year', CAST(round(median(week_of_year), 4) AS VARCHAR) FROM train
       UNION ALL SELECT 'month', CAST(round(median(month), 4) AS VARCHAR) FROM train
       UNION ALL SELECT 'year', CAST(round(median(year), 4) AS VARCHAR) FROM train
       UNION ALL SELECT 'lag_4', CAST(round(median(lag_4), 4) AS VARCHAR) FROM train
       UNION ALL SELECT 'lag_8', CAST(round(median(lag_8), 4) AS VARCHAR) FROM train
       UNION ALL SELECT 'rolling_mean_4', CAST(round(median(rolling_mean_4), 4) AS VARCHAR) FROM train
       UNION ALL SELECT 'rolling_std_4', CAST(round(median(rolling_std_4), 4) AS VARCHAR) FROM train
       UNION ALL (SELECT 'store_id', CAST(store_id AS VARCHAR) FROM train GROUP BY store_id ORDER BY count(*) DESC, store_id LIMIT 1)
       UNION ALL (SELECT 'department', CAST(department AS VARCHAR) FROM train GROUP BY department ORDER BY count(*) DESC, department LIMIT 1)""",
)
def l1_fill_values(spark, folder):
    complete = features.drop_incomplete(features.series_features(sales_panel(spark, folder)))
    train, _ = features.time_split(complete, TEST_START, TEST_END)
    # Medians and modes are several passes over what comes from windows; it is made once.
    numbers = [*features.ENGINEERED, "year", "month", "week_of_year"]
    train = materialize(train.select(*SERIES_KEY, *numbers), "training-rows")
    medians = models.numeric_medians(train, numbers)
    modes = models.category_modes(train, ["store_id", "department"])
    return rounded(medians, "value").withColumn("value", F.col("value").cast("string")).unionByName(modes)


@query("l2_linear_regression")
def l2_linear_regression(spark, folder):
    train, test = split(spark, folder, features.OPERATIONAL)
    numeric, categorical = features.scenario_features(features.OPERATIONAL, train.columns)
    return models.fit_and_score(train, test, numeric, categorical, _only(models.LINEAR))


@query(
    "l2_linear_regression_lag",
    f"""WITH fit AS (SELECT regr_slope(weekly_sales, lag_1) AS b, regr_intercept(weekly_sales, lag_1) AS a
          FROM complete WHERE date < DATE '2001-06-01'),
        scored AS (SELECT CAST(weekly_sales AS DOUBLE) AS actual, a + b * lag_1 AS predicted FROM complete, fit
          WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-08-31')
        SELECT 'Linear Regression' AS model, {measures("actual", "predicted")}, count(*) AS n_test_rows,
               'store_department_week' AS evaluation_level FROM scored""",
)
def l2_linear_regression_lag(spark, folder):
    return _lag_or_month(spark, folder, "lag_1", _only(models.LINEAR))


def _stump(name: str, rows: str, target: str) -> str:
    """The month that splits ``rows`` best, and the mean target on either side."""
    return f"""{name}_cut AS (
          SELECT m, sum(y) FILTER (WHERE month <= m) / sum(n) FILTER (WHERE month <= m) AS lo,
                 sum(y) FILTER (WHERE month > m) / sum(n) FILTER (WHERE month > m) AS hi,
                 sum(y) FILTER (WHERE month <= m) ^ 2 / sum(n) FILTER (WHERE month <= m)
                   + sum(y) FILTER (WHERE month > m) ^ 2 / sum(n) FILTER (WHERE month > m) AS gain
          FROM (SELECT month, sum({target}) AS y, CAST(count(*) AS DOUBLE) AS n FROM {rows} GROUP BY month), range(1, 12) t(m) GROUP BY m),
        {name} AS (SELECT * FROM {name}_cut ORDER BY gain DESC, m LIMIT 1)"""


_TRAIN = "train AS (SELECT month, CAST(weekly_sales AS DOUBLE) AS y FROM complete WHERE date < DATE '2001-06-01')"
_TEST = "FROM complete, {tables} WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-08-31'"
_SIDE = "(CASE WHEN month <= {t}.m THEN {t}.lo ELSE {t}.hi END)"


@query(
    "l3_forest_stump",
    f"""WITH {_TRAIN}, {_stump("one", "train", "y")}, scored AS (SELECT CAST(weekly_sales AS DOUBLE) AS actual,
          {_SIDE.format(t="one")} AS predicted {_TEST.format(tables="one")})
        SELECT 'Random Forest' AS model, {measures("actual", "predicted")}, count(*) AS n_test_rows,
               'store_department_week' AS evaluation_level FROM scored""",
)
def l3_forest_stump(spark, folder):
    # One tree of one split over all rows.
    sizes = models.Sizes(forest_trees=1, forest_depth=1, forest_bootstrap=False, models=(models.FOREST,))
    return _lag_or_month(spark, folder, "month", sizes)


@query(
    "l4_two_stumps",
    f"""WITH {_TRAIN}, {_stump("one", "train", "y")},
          rest AS (SELECT month, 2 * (y - {_SIDE.format(t="one")}) AS r FROM train, one), {_stump("two", "rest", "r")},
          scored AS (SELECT CAST(weekly_sales AS DOUBLE) AS actual,
            {_SIDE.format(t="one")} + 0.5 * {_SIDE.format(t="two")} AS predicted {_TEST.format(tables="one, two")})
        SELECT 'Boosted Trees' AS model, {measures("actual", "predicted")}, count(*) AS n_test_rows,
               'store_department_week' AS evaluation_level FROM scored""",
)
def l4_two_stumps(spark, folder):
    # Two rounds of one split each; the second is fitted to twice the rest.
    sizes = models.Sizes(
        boosting_rounds=2, boosting_depth=1, boosting_rate=0.5, row_sample=1.0, column_sample=1.0, models=(models.BOOSTED,)
    )
    return _lag_or_month(spark, folder, "month", sizes)


@query("l3_random_forest")
def l3_random_forest(spark, folder):
    return _forecast(spark, folder, models.FOREST)


@query("l4_boosted_trees")
def l4_boosted_trees(spark, folder):
    return _forecast(spark, folder, models.BOOSTED)


@query("l5_model_comparison")
def l5_model_comparison(spark, folder):
    return round_measures(models.model_comparison(_forecast(spark, folder)))


@query("l6_prediction_table")
def l6_prediction_table(spark, folder):
    columns = {f"pred_{m.lower().replace(' ', '_')}": m for m in SIZES.models}
    return metrics.prediction_table(_forecast(spark, folder), columns)


@query("l7_feature_importance")
def l7_feature_importance(spark, folder):
    train, _ = split(spark, folder)
    numeric, categorical = features.scenario_features(features.FULL, train.columns)
    assembled = models.fit_preprocessor(train, numeric, categorical).transform(train)
    fitted = models.train_models(assembled, _only(models.BOOSTED))
    return models.feature_importance(fitted[models.BOOSTED], assembled, 15)


# --- all three models with closed forms ------------------------------------------------------------

# A line, one split of all rows, and two boosting rounds of one split each, over the month alone.
SOLVABLE = models.Sizes(
    forest_trees=1, forest_depth=1, forest_bootstrap=False,
    boosting_rounds=2, boosting_depth=1, boosting_rate=0.5, row_sample=1.0, column_sample=1.0,
)
_SOLVED = f"""{_TRAIN}, {_stump("one", "train", "y")},
    rest AS (SELECT month, 2 * (y - {_SIDE.format(t="one")}) AS r FROM train, one), {_stump("two", "rest", "r")},
    line AS (SELECT regr_slope(y, month) AS b, regr_intercept(y, month) AS a FROM train),
    scored AS (
      SELECT store_id, department, date, weekly_sales, 'Linear Regression' AS model, a + b * month AS predicted
      {_TEST.format(tables="line")}
      UNION ALL SELECT store_id, department, date, weekly_sales, 'Random Forest', {_SIDE.format(t="one")} {_TEST.format(tables="one")}
      UNION ALL SELECT store_id, department, date, weekly_sales, 'Boosted Trees', {_SIDE.format(t="one")} + 0.5 * {_SIDE.format(t="two")}
      {_TEST.format(tables="one, two")}),
    by_week AS (SELECT model, date, CAST(sum(weekly_sales) AS DOUBLE) AS actual, sum(predicted) AS predicted FROM scored GROUP BY ALL)"""


def _solved(spark, folder):
    rows = models.model_rows(features.series_features(sales_panel(spark, folder)), ["month"])
    train, test = features.time_split(rows, TEST_START, TEST_END)
    return models.fit_and_score(train, test, ["month"], [], SOLVABLE)


@query(
    "l5_solvable_comparison",
    f"""WITH {_SOLVED} SELECT model, {measures("CAST(weekly_sales AS DOUBLE)", "predicted")}, count(*) AS n_test_rows,
          'store_department_week' AS evaluation_level FROM scored GROUP BY model""",
)
def l5_solvable_comparison(spark, folder):
    return round_measures(models.model_comparison(_solved(spark, folder)))


@query(
    "l6_solvable_table",
    f"""WITH {_SOLVED} SELECT store_id, department, date, weekly_sales,
          round(max(predicted) FILTER (WHERE model = 'Linear Regression'), 2) AS pred_linear_regression,
          round(max(predicted) FILTER (WHERE model = 'Random Forest'), 2) AS pred_random_forest,
          round(max(predicted) FILTER (WHERE model = 'Boosted Trees'), 2) AS pred_boosted_trees FROM scored GROUP BY ALL""",
)
def l6_solvable_table(spark, folder):
    columns = {f"pred_{m.lower().replace(' ', '_')}": m for m in SOLVABLE.models}
    return rounded(metrics.prediction_table(_solved(spark, folder), columns), *columns, digits=2)


def _gain(feature: str) -> str:
    """The best split of one feature: how much of the squares it explains."""
    low, high = f"FILTER (WHERE {feature} <= m)", f"FILTER (WHERE {feature} > m)"
    return f"""SELECT 'num__{feature}' AS feature, max(gain) AS gain FROM (
        SELECT sum(y) {low} ^ 2 / sum(n) {low} + sum(y) {high} ^ 2 / sum(n) {high} AS gain
        FROM (SELECT {feature}, sum(CAST(weekly_sales AS DOUBLE)) AS y, CAST(count(*) AS DOUBLE) AS n FROM complete WHERE date < DATE '2001-06-01' GROUP BY ALL) s,
             (SELECT DISTINCT {feature} AS m FROM complete) t GROUP BY m)"""


@query(
    "l7_stump_importance",
    f"""WITH gains AS ({_gain("month")} UNION ALL {_gain("year")})
        SELECT feature, CAST(gain = (SELECT max(gain) FROM gains) AS DOUBLE) AS importance FROM gains""",
)
def l7_stump_importance(spark, folder):
    # One split takes the feature that explains most, and all importance goes to it.
    train, _ = features.time_split(models.model_rows(features.series_features(sales_panel(spark, folder))), TEST_START, TEST_END)
    assembled = models.fit_preprocessor(train, ["month", "year"], []).transform(train)
    sizes = models.Sizes(**{**SOLVABLE.__dict__, "models": (models.BOOSTED,), "boosting_rounds": 1})
    return models.feature_importance(models.train_models(assembled, sizes)[models.BOOSTED], assembled, 15)


# Least squares with a level per store and per department in a full panel: deviations from both means are what
# one column per store and department leaves of a number.
_PANEL_LINE = """fx AS (SELECT store_id, date, temperature AS f FROM clean_features),
    c AS (SELECT r.store_id, r.department, r.date, CAST(weekly_sales AS DOUBLE) AS y, CAST(r.month AS DOUBLE) AS m, CAST(f AS DOUBLE) AS f
          FROM complete r JOIN fx ON fx.store_id = r.store_id AND fx.date = r.date),
    t AS (SELECT * FROM c WHERE date < DATE '2001-06-01'),
    by_s AS (SELECT store_id, avg(y) AS sy, avg(m) AS sm, avg(f) AS sf FROM t GROUP BY store_id),
    by_d AS (SELECT department, avg(y) AS dy, avg(m) AS dm, avg(f) AS df FROM t GROUP BY department),
    whole AS (SELECT avg(y) AS wy, avg(m) AS wm, avg(f) AS wf FROM t),
    dev AS (SELECT c.*, sy + dy - wy AS base, m - sm - dm + wm AS vm, f - sf - df + wf AS vf
            FROM c JOIN by_s ON by_s.store_id = c.store_id JOIN by_d ON by_d.department = c.department, whole),
    sums AS (SELECT sum(vm * vm) AS mm, sum(vf * vf) AS ff, sum(vm * vf) AS mf, sum(vm * (y - base)) AS my, sum(vf * (y - base)) AS fy
             FROM dev WHERE date < DATE '2001-06-01'),
    scored AS (
      SELECT 'full_information' AS scenario, 4 AS feature_count, date, y, base + vm * (my * ff - fy * mf) / (mm * ff - mf * mf)
             + vf * (fy * mm - my * mf) / (mm * ff - mf * mf) AS predicted
      FROM dev, sums WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-08-31'
      UNION ALL
      SELECT 'operational_conservative', 3, date, y, base + vm * my / mm FROM dev, sums
      WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-08-31'),
    by_week AS (SELECT scenario, feature_count, date, sum(y) AS actual, sum(predicted) AS predicted FROM scored GROUP BY ALL)"""


def _line_scenarios(spark, folder):
    """Least squares in both scenarios over the month and, if it counts as known, the temperature, with levels per
    store and department."""
    rows = models.model_rows(features.series_features(_series_panel(spark, folder, "temperature")), ["month", "temperature"])
    train, test = features.time_split(rows, TEST_START, TEST_END)
    return materialize(models.scenario_grid(train, test, _only(models.LINEAR)), "scenario-forecasts")


@query(
    "k3_line_scenarios",
    f"""WITH {_PANEL_LINE}
        SELECT scenario, 'Linear Regression' AS model, CAST(feature_count AS BIGINT) AS feature_count, {measures("y", "predicted")},
               count(*) AS n_test_rows, 'store_department_week' AS evaluation_level, CAST(NULL AS BIGINT) AS n_test_weeks
        FROM scored GROUP BY scenario, feature_count
        UNION ALL
        SELECT scenario, 'Linear Regression', CAST(feature_count AS BIGINT), {measures("actual", "predicted")}, NULL, 'company_week', count(*)
        FROM by_week GROUP BY scenario, feature_count""",
)
def k3_line_scenarios(spark, folder):
    granular, company = models.scenario_comparison(_line_scenarios(spark, folder))
    return round_measures(granular.unionByName(company, allowMissingColumns=True))


@query(
    "k4_line_sensitivity",
    f"""WITH {_PANEL_LINE},
        measured AS (SELECT scenario, avg(abs((predicted - actual) / nullif(actual, 0))) * 100 AS mape,
            sum(abs(predicted - actual)) / sum(abs(actual)) * 100 AS wape, sum(predicted - actual) / sum(abs(actual)) * 100 AS bias
            FROM by_week GROUP BY scenario)
        SELECT 'Linear Regression' AS model, round(a.mape, 4) AS full_mape, round(b.mape, 4) AS operational_mape, round(b.mape - a.mape, 4) AS mape_change,
               round(a.wape, 4) AS full_wape, round(b.wape, 4) AS operational_wape, round(b.wape - a.wape, 4) AS wape_change,
               round((b.wape - a.wape) / nullif(a.wape, 0) * 100, 4) AS wape_relative_change_pct, round(a.bias, 4) AS full_forecast_bias,
               round(b.bias, 4) AS operational_forecast_bias, CAST(4 AS BIGINT) AS full_feature_count, CAST(3 AS BIGINT) AS operational_feature_count,
               'company_week' AS evaluation_level
        FROM measured a, measured b WHERE a.scenario = 'full_information' AND b.scenario = 'operational_conservative'""",
)
def k4_line_sensitivity(spark, folder):
    _, company = models.scenario_comparison(_line_scenarios(spark, folder))
    table = backtest.sensitivity(company)
    return rounded(table, *[c for c in table.columns if c.rsplit("_", 1)[-1] in ("mape", "wape", "change", "pct", "bias")])


def _arima_parts(source: str, grid: list[tuple[float, int]], season: int, p: str = "") -> list[str]:
    """The grid fit and the one-week-ahead forecasts of every series of ``source`` (k, date, v), as recursive SQL;
    ``{p}final`` has k, t and predicted, ``{p}y`` the values by k and t."""
    forecast = "y.v1 + r.phi * (y.v1 - y.v2) + r.theta * r.err"
    if season:
        forecast = f"{forecast} + r.big * ((y.s0 - y.s1) - r.phi * (y.s1 - y.s2))"

    def run(table: str, points: str, last: str) -> str:
        return f"""{table} AS (
            SELECT k, CAST({season + 2} AS BIGINT) AS t, phi, theta, big, CAST(0 AS DOUBLE) AS err,
                   CAST(0 AS DOUBLE) AS sse, CAST(NULL AS DOUBLE) AS predicted FROM {points}
            UNION ALL
            SELECT r.k, y.t, r.phi, r.theta, r.big, y.v - ({forecast}), r.sse + (y.v - ({forecast})) * (y.v - ({forecast})),
                   {forecast}
            FROM {table} r JOIN {p}y y ON y.k = r.k AND y.t = r.t + 1 WHERE y.t <= {last})"""

    lags = {"v1": 1, "v2": 2, "s0": season, "s1": season + 1, "s2": season + 2}
    n_train = f"(SELECT max(t) FROM {p}y WHERE date < DATE '2001-06-01')"
    parts = [
        f"""{p}y AS (SELECT k, date, v, row_number() OVER o AS t, {", ".join(f"lag(v, {n}) OVER o AS {c}" for c, n in lags.items())}
              FROM ({source}) WHERE date <= DATE '2001-08-31' WINDOW o AS (PARTITION BY k ORDER BY date))""",
        f"{p}best0 AS (SELECT DISTINCT k, CAST(0 AS DOUBLE) AS phi, CAST(0 AS DOUBLE) AS theta, CAST(0 AS DOUBLE) AS big FROM {p}y)",
    ]
    for level, (step, side) in enumerate(grid, start=1):
        point = lambda c, i: f"least(greatest(round({c} + {i} * CAST({step} AS DOUBLE), 6), -0.99), 0.99)"  # noqa: E731, B023
        ticks = lambda a: f"range({-side}, {side + 1}) {a}({a})"  # noqa: E731, B023
        big = f", {ticks('g')}" if season else ""
        parts.append(
            f"""{p}grid{level} AS (SELECT k, {point("phi", "i")} AS phi, {point("theta", "j")} AS theta,
                {point("big", "g") if season else "big"} AS big FROM {p}best{level - 1}, {ticks("i")}, {ticks("j")}{big})"""
        )
        parts.append(run(f"{p}run{level}", f"{p}grid{level}", n_train))
        parts.append(
            f"""{p}best{level} AS (SELECT k, phi, theta, big FROM {p}run{level} WHERE t = {n_train}
                QUALIFY row_number() OVER (PARTITION BY k ORDER BY sse, phi, theta, big) = 1)"""
        )
    parts.append(run(f"{p}final", f"{p}best{len(grid)}", f"(SELECT max(t) FROM {p}y)"))
    return parts


_COMPANY = "SELECT 0 AS k, date, CAST(total_weekly_sales AS DOUBLE) AS v FROM company"
_DEPARTMENTS = "SELECT department AS k, date, CAST(sum(weekly_sales) AS DOUBLE) AS v FROM clean_sales GROUP BY ALL"


def _company_arima_sql(name: str, grid: list[tuple[float, int]], season: int) -> str:
    return f"""WITH RECURSIVE {", ".join(_arima_parts(_COMPANY, grid, season))}
        SELECT y.date, y.v AS actual, '{name}' AS model, round(predicted, 2) AS predicted
        FROM final JOIN y USING (k, t) WHERE y.date >= DATE '2001-06-01'"""


def _department_arima_sql(name: str, grid: list[tuple[float, int]], season: int) -> str:
    return f"""WITH RECURSIVE {", ".join(_arima_parts(_DEPARTMENTS, grid, season))}
        SELECT k AS department, y.date, y.v AS actual, '{name}' AS model, round(predicted, 2) AS predicted
        FROM final JOIN y USING (k, t) WHERE y.date >= DATE '2001-06-01'"""


def _department_forecast(spark, folder, seasonal: bool):
    totals = sales_panel(spark, folder).groupBy("department", "date").agg(F.sum("weekly_sales").alias("total"))
    made = arima.forecast(totals, "total", ["department"], TEST_START, TEST_END, seasonal, slices=4)
    return rounded(made, "predicted", digits=2)


@query("l8_arima_departments", _department_arima_sql(arima.ARIMA, arima.ARIMA_GRID, 0))
def l8_arima_departments(spark, folder):
    return _department_forecast(spark, folder, False)


@query("l9_sarima_departments", _department_arima_sql(arima.SARIMA, arima.SARIMA_GRID, arima.SEASON))
def l9_sarima_departments(spark, folder):
    return _department_forecast(spark, folder, True)


@query("l8_arima_series")
def l8_arima_series(spark, folder):
    return arima.forecast(sales_panel(spark, folder), "weekly_sales", SERIES_KEY, TEST_START, TEST_END)


@query("l8_arima_company", _company_arima_sql(arima.ARIMA, arima.ARIMA_GRID, 0))
def l8_arima_company(spark, folder):
    series = features.company_series(sales_panel(spark, folder))
    return rounded(arima.company_forecast(series, TEST_START, TEST_END), "predicted", digits=2)


@query("l9_sarima_series")
def l9_sarima_series(spark, folder):
    return arima.forecast(sales_panel(spark, folder), "weekly_sales", SERIES_KEY, TEST_START, TEST_END, seasonal=True)


@query("l9_sarima_company", _company_arima_sql(arima.SARIMA, arima.SARIMA_GRID, arima.SEASON))
def l9_sarima_company(spark, folder):
    series = features.company_series(sales_panel(spark, folder))
    return rounded(arima.company_forecast(series, TEST_START, TEST_END, seasonal=True), "predicted", digits=2)


def _statistical_comparison(spark, folder):
    naive = metrics.company_evaluation(company_tests(spark, folder), features.NAIVE_FORECASTS)
    series = features.company_series(sales_panel(spark, folder))
    both = [arima.company_forecast(series, TEST_START, TEST_END, s) for s in (False, True)]
    return naive.unionByName(arima.company_comparison(both[0].unionByName(both[1])))


_MEASURED = f"""{measures("actual", "predicted")}, count(*) AS n_test_weeks, 'company_week' AS evaluation_level"""
_STATISTICAL = ", ".join([
    *_arima_parts(_COMPANY, arima.ARIMA_GRID, 0, "a_"), *_arima_parts(_COMPANY, arima.SARIMA_GRID, arima.SEASON, "b_"),
    *[f"{p}test AS (SELECT {p}y.date, v AS actual, predicted FROM {p}final JOIN {p}y USING (k, t) WHERE {p}y.date >= DATE '2001-06-01')" for p in ("a_", "b_")],
    f"""compared AS (
      SELECT model, {_MEASURED} FROM company_long WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY model
      UNION ALL SELECT '{arima.ARIMA}', {_MEASURED} FROM a_test UNION ALL SELECT '{arima.SARIMA}', {_MEASURED} FROM b_test)""",
])


@query("k1_baseline_arima_comparison", f"WITH RECURSIVE {_STATISTICAL} SELECT * FROM compared")
def k1_baseline_arima_comparison(spark, folder):
    return round_measures(metrics.by_mape(_statistical_comparison(spark, folder)))


def _final_comparison(spark, folder, forecasts):
    company = metrics.summed_evaluation(forecasts, models.TARGET)
    company = company.withColumn("model", F.concat("model", F.lit(" Aggregate")))
    return round_measures(metrics.by_mape(_statistical_comparison(spark, folder).unionByName(company)))


@query("k2_final_comparison")
def k2_final_comparison(spark, folder):
    return _final_comparison(spark, folder, _forecast(spark, folder))


@query(
    "k2_solvable_comparison",
    f"""WITH RECURSIVE {_STATISTICAL}, {_SOLVED}
        SELECT * FROM compared UNION ALL SELECT model || ' Aggregate', {_MEASURED} FROM by_week GROUP BY model""",
)
def k2_solvable_comparison(spark, folder):
    return _final_comparison(spark, folder, _solved(spark, folder))


@query("k3_scenario_grid")
def k3_scenario_grid(spark, folder):
    granular, company = models.scenario_comparison(scenario_forecasts(spark, folder))
    return round_measures(granular.unionByName(company, allowMissingColumns=True))


@query("k4_sensitivity_models")
def k4_sensitivity_models(spark, folder):
    _, company = models.scenario_comparison(scenario_forecasts(spark, folder))
    return backtest.sensitivity(company)


@query(
    "k7_lag_backtest",
    f"""WITH fit AS (SELECT p.fold, p.test_start, p.test_end, regr_slope(c.weekly_sales, c.lag_1) AS b,
                            regr_intercept(c.weekly_sales, c.lag_1) AS a
          FROM plan p JOIN complete c ON c.date < p.test_start GROUP BY ALL),
        scored AS (SELECT fold, CAST(weekly_sales AS DOUBLE) AS actual, a + b * lag_1 AS predicted
          FROM fit JOIN complete ON date BETWEEN test_start AND test_end)
        SELECT fold, 'Linear Regression' AS model, {measures("actual", "predicted")}, count(*) AS n_test_rows
        FROM scored GROUP BY fold""",
)
def k7_lag_backtest(spark, folder):
    # The fit of one feature has a closed form in each of the 20 folds.
    rows = models.model_rows(features.series_features(sales_panel(spark, folder)))
    folds = backtest.folds(backtest_plan(backtest.week_counts(rows)))
    scored = models.backtest_scores(rows, folds, ["lag_1"], [], _only(models.LINEAR))
    return round_measures(metrics.metrics(scored, models.TARGET, "predicted", ["fold", "model"], "n_test_rows"))


@query(
    "k7_stump_backtest",
    f"""WITH by_month AS (SELECT p.fold, c.month, sum(CAST(weekly_sales AS DOUBLE)) AS y, CAST(count(*) AS DOUBLE) AS n
          FROM plan p JOIN complete c ON c.date < p.test_start GROUP BY ALL),
        cuts AS (SELECT fold, m, sum(y) FILTER (WHERE month <= m) / sum(n) FILTER (WHERE month <= m) AS lo,
                 sum(y) FILTER (WHERE month > m) / sum(n) FILTER (WHERE month > m) AS hi,
                 sum(y) FILTER (WHERE month <= m) ^ 2 / sum(n) FILTER (WHERE month <= m)
                   + sum(y) FILTER (WHERE month > m) ^ 2 / sum(n) FILTER (WHERE month > m) AS gain
                 FROM by_month, range(1, 12) t(m) GROUP BY fold, m),
        one AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, m) = 1),
        scored AS (SELECT p.fold, CAST(weekly_sales AS DOUBLE) AS actual, CASE WHEN month <= m THEN lo ELSE hi END AS predicted
          FROM one JOIN plan p ON p.fold = one.fold JOIN complete ON date BETWEEN test_start AND test_end)
        SELECT fold, 'Random Forest' AS model, {measures("actual", "predicted")}, count(*) AS n_test_rows FROM scored GROUP BY fold""",
)
def k7_stump_backtest(spark, folder):
    # One split of all rows in each of the 20 folds.
    rows = models.model_rows(features.series_features(sales_panel(spark, folder)), ["month"])
    folds = backtest.folds(backtest_plan(backtest.week_counts(rows)))
    sizes = models.Sizes(**{**SOLVABLE.__dict__, "models": (models.FOREST,)})
    scored = models.backtest_scores(rows, folds, ["month"], [], sizes, at_once=4)
    return round_measures(metrics.metrics(scored, models.TARGET, "predicted", ["fold", "model"], "n_test_rows"))


@query(
    "t14_next_week_forecast",
    """WITH fit AS (SELECT regr_slope(weekly_sales, lag_1) AS b, regr_intercept(weekly_sales, lag_1) AS a FROM complete),
        coming AS (SELECT store_id, department, max_by(weekly_sales, date) AS lag_1 FROM sales GROUP BY store_id, department)
       SELECT store_id, department, (SELECT max(date) + 7 FROM sales) AS date, 'Linear Regression' AS model,
              round(a + b * lag_1, 2) AS predicted FROM coming, fit""",
)
def t14_next_week_forecast(spark, folder):
    sales = sales_panel(spark, folder)
    rows = models.model_rows(features.series_features(sales))
    scored = models.forecast_rows(rows, features.next_week_rows(sales), ["lag_1"], [], _only(models.LINEAR))
    return rounded(scored, "predicted", digits=2)


@query("k7_model_backtest")
def k7_model_backtest(spark, folder):
    rows = model_rows(spark, folder)
    weeks = backtest.week_counts(rows)
    # The 20 folds of 14 weeks of the other backtests; every fold has all rows of its weeks.
    plan = backtest_plan(weeks)
    numeric, categorical = features.scenario_features(features.OPERATIONAL, rows.columns)
    features.require_feature_count(numeric + categorical)
    # Both models at the sizes that the library publishes.
    sizes = models.Sizes(models=(models.FOREST, models.BOOSTED))
    scored = models.backtest_scores(rows, backtest.folds(plan), numeric, categorical, sizes, at_once=4)
    baseline = backtest.baseline_predictions(sales_panel(spark, folder), plan)
    return backtest.fold_results(weeks, scored, baseline, plan, len(numeric + categorical))
