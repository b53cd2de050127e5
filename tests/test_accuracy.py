"""Accuracy measures on small frames and on published numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailcast.operators import backtest, features, kpi, metrics

# Published weekly totals with their naive forecasts, and the measures they give.
ACTUAL = [
    48881099.52, 48190338.63, 48022074.6, 49305491.28, 49008711.24, 61377749.25, 48855286.85,
    50093008.42, 50271348.28, 49298141.15, 48268173.87, 51300404.4, 49526727.41, 49829911.58,
]
LAST_YEAR = [
    49341890.88, 48607818.92, 49048894.83, 50035018.76, 61919394.5, 49693566.38, 49045339.89,
    48895766.97, 47170184.1, 48117721.56, 50121478.71, 49321042.52, 49805709.22, 75339416.31,
]
ROLLING = [
    48804267.305, 48886084.24, 48726452.225, 48854775.3875, 48599751.00750001, 48631653.9375,
    51928506.5925, 52136809.655, 52333688.940000005, 52649348.2, 49629446.175000004,
    49482667.93000001, 49784516.925, 49598361.707499996,
]
BEFORE = 50325588.8
PUBLISHED = {
    "Last Week Baseline": (2664538.49, 4856044.92572316, 5.054679201886051, 5.312165575825803, 0.07058631822270567),
    "Rolling 4-Week Average Baseline": (2091545.98125, 3762620.5883714566, 3.8715993959583797, 4.169817251111675, -0.31074448796389315),
    "Previous Year Same Week Baseline": (4465679.786428571, 8348757.186414879, 8.685983216127761, 8.903016609877149, 3.451124274622415),
}
# (fold, model, MAPE, WAPE, bias)
FOLDS = [
    (1, "Boosted", 1.8594788990858202, 1.8353862869958306, 0.6897972476958513),
    (1, "Forest", 2.1092394674659407, 2.0760546293481617, 0.8758296558206631),
    (1, "Rolling 4-Week Baseline", 5.059832625364245, 5.324415595888506, -0.068320714813864),
    (2, "Boosted", 1.6271299478986039, 1.6220709641454185, -0.5657150780005874),
    (2, "Forest", 3.365281232535084, 3.445037873572179, -3.099195042042157),
    (2, "Rolling 4-Week Baseline", 7.904842137074416, 10.641774407613916, -8.215599654276218),
    (3, "Boosted", 2.367219707741253, 2.580597142452712, -0.6843639333458427),
    (3, "Forest", 3.4079015340306826, 3.529403511729069, 0.8771456125107068),
    (3, "Rolling 4-Week Baseline", 18.992758244520743, 19.683839423607154, 6.9044388683964915),
    (4, "Boosted", 1.3842124814585255, 1.3868260859070336, 0.26992233300189217),
    (4, "Forest", 1.7491122084850548, 1.7556345913799252, 0.4724607895723607),
    (4, "Rolling 4-Week Baseline", 3.18692556810018, 3.196766577360831, 1.84614499287014),
    (5, "Forest", 1.8809612263980087, 1.9477266075629223, 0.3178628249430504),
    (5, "Boosted", 1.9524186518395985, 2.158077068275764, 1.0182644684810767),
    (5, "Rolling 4-Week Baseline", 6.329362176428428, 7.416823977658926, -3.929778961567444),
    (6, "Boosted", 1.7143245559936147, 1.860118551399085, 0.7566186035390273),
    (6, "Forest", 2.9977566382925476, 3.1694721718797703, 0.5384822645065208),
    (6, "Rolling 4-Week Baseline", 14.65907969415283, 17.08986056214379, -4.349375591331271),
]


def measured(spark, rows):
    df = spark.createDataFrame(rows, "a double, p double")
    return metrics.metrics(df, "a", "p").first()


def test_mape_skips_zero_actuals(spark):
    assert measured(spark, [(0.0, 5.0), (10.0, 12.0)])["mape"] == pytest.approx(20)


def test_undefined_ratios_are_null(spark):
    row = measured(spark, [(0.0, 5.0), (0.0, 1.0)])
    assert row["mape"] is None and row["wape"] is None and row["forecast_bias"] is None
    assert row["mae"] == 3


def test_negative_actuals_weigh_by_size(spark):
    row = measured(spark, [(-10.0, -5.0), (30.0, 25.0)])
    assert row["wape"] == pytest.approx(25) and row["forecast_bias"] == pytest.approx(0)


def test_missing_forecasts_are_left_out(spark):
    assert measured(spark, [(1.0, None), (2.0, 2.0), (3.0, 3.0)])["n"] == 2


def test_published_baselines(spark):
    days = [dt.date(2024, 6, 1) + dt.timedelta(weeks=i) for i in range(14)]
    rows = list(zip(days, ACTUAL, [BEFORE, *ACTUAL[:-1]], ROLLING, LAST_YEAR))
    names = list(features.NAIVE_FORECASTS)
    df = spark.createDataFrame(rows, ["date", "total_weekly_sales", *names])
    got = {r["model"]: r for r in metrics.company_evaluation(df, features.NAIVE_FORECASTS).collect()}
    assert set(got) == set(PUBLISHED)
    for model, want in PUBLISHED.items():
        row = got[model]
        have = (row["mae"], row["rmse"], row["mape"], row["wape"], row["forecast_bias"])
        assert have == pytest.approx(want, rel=1e-9)
        assert row["n_test_weeks"] == 14 and row["evaluation_level"] == "company_week"


def test_published_rolling_forecast(spark):
    days = [dt.date(2024, 6, 1) + dt.timedelta(weeks=i) for i in range(14)]
    df = spark.createDataFrame(list(zip(days, ACTUAL)), ["date", "y"])
    got = features.naive_forecasts(df, "y").orderBy("date").collect()
    assert [r["pred_last_week"] for r in got] == [None, *ACTUAL[:-1]]
    assert [r["pred_rolling_4w"] for r in got[:4]] == [None] * 4
    assert [r["pred_rolling_4w"] for r in got[4:]] == pytest.approx(ROLLING[4:], rel=1e-12)


@pytest.fixture(scope="module")
def fold_results(spark):
    return spark.createDataFrame(
        FOLDS, "fold int, model string, company_mape double, company_wape double, company_forecast_bias double"
    )


def test_published_winners(fold_results):
    got = [(r["fold"], r["winning_model"]) for r in backtest.fold_winners(fold_results).collect()]
    assert got == [(i, "Forest" if i == 5 else "Boosted") for i in range(1, 7)]


def test_published_summary_and_selection(fold_results):
    summary = backtest.backtest_summary(fold_results)
    rows = {r["rank"]: r for r in summary.collect()}
    assert [rows[i]["model"] for i in (1, 2, 3)] == ["Boosted", "Forest", "Rolling 4-Week Baseline"]
    assert [rows[i]["fold_wins"] for i in (1, 2, 3)] == [5, 1, 0]
    best = rows[1]
    want = {
        "mean_company_mape": 1.8174640406695692,
        "mean_company_wape": 1.9071793498626406,
        "median_company_wape": 1.847752419197458,
        "std_company_wape": 0.4185366082017568,
        "min_company_wape": 1.3868260859070336,
        "max_company_wape": 2.580597142452712,
        "mean_company_bias": 0.24742060689523623,
        "mean_absolute_company_bias": 0.6641136106773796,
    }
    for name, value in want.items():
        assert best[name] == pytest.approx(value, rel=1e-9)
    cut = kpi.wape_reduction(summary).first()
    assert round(cut["wape_reduction_over_baseline_pct"], 2) == 81.94
    won = kpi.winning_folds(summary, backtest.fold_winners(fold_results)).first()
    assert won["folds_won"] == [1, 2, 3, 4, 6]


def test_missing_baseline_gives_null(fold_results):
    summary = backtest.backtest_summary(fold_results.where(F.col("model") != "Rolling 4-Week Baseline"))
    assert kpi.wape_reduction(summary).first()["wape_reduction_over_baseline_pct"] is None


def test_equal_winners_go_by_name(spark):
    rows = [(1, "b", 2.0), (1, "a", 2.0), (1, "c", 3.0)]
    df = spark.createDataFrame(rows, "fold int, model string, company_wape double")
    assert backtest.fold_winners(df).first()["winning_model"] == "a"


def test_sensitivity_on_published_numbers(spark):
    rows = [
        ("full_information", "Forest", 1.4827442826911406, 1.4713930535639603, 0.5615975720305336, 27),
        ("operational_conservative", "Forest", 1.4529851673241083, 1.436115807573435, 0.5525596580770149, 23),
        ("full_information", "Only here", 1.0, 1.0, 0.0, 27),
    ]
    schema = "scenario string, model string, mape double, wape double, forecast_bias double, feature_count int"
    got = backtest.sensitivity(spark.createDataFrame(rows, schema)).collect()
    assert [r["model"] for r in got] == ["Forest"]
    assert got[0]["wape_change"] == pytest.approx(-0.035277245990525286)
    assert got[0]["wape_relative_change_pct"] == pytest.approx(-2.397540609905551)
