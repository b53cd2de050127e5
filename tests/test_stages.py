"""The batch stages, from CSV files to business figures."""

import datetime as dt
from pathlib import Path

import pytest

from retailcast.operators import features, models
from retailcast.operators.models import Sizes
from retailcast.plans import stages
from retailcast.plans.stages import STAGES, Job
from retailcast.sources import orders_panel
from retailcast.sources.files import write_table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("job")
    for name in ("sales", "features", "stores"):
        write_table(getattr(orders_panel, name)(spark, FOLDER), f"{base}/raw/{name}.csv")
    sizes = Sizes(forest_trees=2, forest_depth=3, boosting_rounds=2, boosting_depth=2)
    return Job(
        spark,
        f"{base}/raw",
        f"{base}/processed",
        f"{base}/outputs",
        dt.date(2001, 6, 1),
        dt.date(2001, 8, 31),
        sizes=sizes,
        initial_train_weeks=209,
        test_weeks=70,
        fits_at_once=2,
    )


def test_stages_need_their_inputs(job):
    with pytest.raises(FileNotFoundError, match="panel"):
        STAGES["baseline"](job)
    with pytest.raises(FileNotFoundError, match="rolling_origin_fold_winners"):
        STAGES["business"](job)


def test_all_stages(job):
    for run in STAGES.values():
        run(job)
    read = lambda name: [r.asDict() for r in job.read(name).collect()]
    assert read("audit_verdict")[0]["verdict"] == "PASS"
    # The raw tables hold planned nulls.
    assert read("relationship_verdict")[0]["verdict"] == "FOLLOW-UP"
    assert job.panel().count() == 21420
    assert len(read("yearly_summer_sales")) == 7
    assert len(read("baseline_forecast")) == 13
    final = read("final_comparable_model_comparison")
    assert len(final) == 8
    assert [r["mape"] for r in final] == sorted(r["mape"] for r in final)
    assert len(read("feature_availability_sensitivity")) == 3
    results = read("rolling_origin_fold_results")
    assert len(results) == 6 and {r["feature_count"] for r in results} == {0, 23}
    assert {r["n_test_rows"] for r in results} == {None, 4200}
    summary = read("rolling_origin_summary")
    assert [r["rank"] for r in summary] == [1, 2, 3] and sum(r["fold_wins"] for r in summary) == 2
    table = read("business_summary_metrics")
    assert len(table) == 22 and {r["metric"]: r["value"] for r in table}["total_folds"] == "2"
    assert read("boosted_feature_importance")[0]["importance"] > 0
    coming = read("coming_week_forecast")
    assert len(coming) == 3 * 60 and all(r["predicted"] is not None for r in coming)
    assert len(read("ml_error_by_department")) == 3 * 6 and len(read("ml_error_by_store_id")) == 3 * 10
    for name in ("audit_sales_signs", "audit_negative_flag", "business_winning_folds"):
        assert len(read(name)) >= 1, name
    for name in ("key_coverage", "store_coverage", "holiday_variation", "holiday_mismatch", "sales_without_features", "sales_without_store"):
        assert job.read(name).count() >= 0, name
    assert len(read("top_departments")) == 6 and len(read("business_top_departments")) == 5
    assert len(read("audit_holiday_names")) > 1 and len(read("sales_by_temperature")) > 1


def test_inspect_writes_first_rows_and_types(job):
    types = {(r["table_name"], r["column_name"]): r["type"] for r in job.read("profile_column_types").collect()}
    assert types["sales", "date"] == "date" and ("stores", "region") in types
    assert all(job.read(f"profile_first_rows_{n}").count() == 3 for n in ("sales", "features", "stores"))


def test_the_next_week_may_use_the_models_again(job, monkeypatch):
    before = sorted(map(str, job.read("coming_week_forecast").collect()))
    monkeypatch.setattr(models, "fit_forecaster", None)  # no fit may be made
    job.reuse_models = True
    STAGES["coming-week"](job)
    job.reuse_models = False
    assert sorted(map(str, job.read("coming_week_forecast").collect())) == before


def test_saved_models_predict_the_same(job):
    rows = stages._model_rows(job)
    prepared, fitted = models.load_forecaster(job.spark, job.out("regression_models"))
    _, test = features.time_split(rows, job.test_start, job.test_end)
    scored = models.score(fitted, prepared.transform(test)).where("model = 'Linear Regression'")
    got = {(r["store_id"], r["department"], str(r["date"])): r["predicted"] for r in scored.collect()}
    for r in job.read("ml_forecast").collect():
        key = (int(r["store_id"]), int(r["department"]), str(r["date"]))
        assert got[key] == pytest.approx(float(r["pred_linear_regression"]))
