"""The batch stages from raw files to business figures.

Each stage reads tables and writes tables, so it can be run alone; a stage's inputs are checked
before its first job. The panel is stored as parquet by year, which later stages prune.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast import schema
from retailcast.functions.columns import MONTH_NAMES
from retailcast.operators import (
    arima,
    backtest,
    checks,
    clean,
    features,
    kpi,
    metrics,
    models,
    profile,
    rollups,
)
from retailcast.session import materialize
from retailcast.sources.files import (
    optional_table,
    path_exists,
    read_table,
    require_columns,
    require_inputs,
    stack_tables,
    write_table,
)
from retailcast.sources.versions import Published


YEAR_FILES = 32


@dataclass
class Job:
    """Where the tables are, and what is tested."""

    spark: SparkSession
    raw: str
    processed: str
    outputs: str
    test_start: dt.date
    test_end: dt.date
    raw_format: str = "csv"
    sizes: models.Sizes = field(default_factory=models.Sizes)
    initial_train_weeks: int = backtest.INITIAL_TRAIN_WEEKS
    test_weeks: int = backtest.TEST_WEEKS
    fits_at_once: int = 1
    # Whether the coming week may be forecast with the models of an earlier one.
    reuse_models: bool = False
    # What the running stage has written so far, by folder; None between stages.
    pending: dict[str, dict[str, str]] | None = field(default=None, repr=False)

    def raw_paths(self) -> dict[str, str]:
        return {name: f"{self.raw}/{name}.{self.raw_format}" for name in schema.RAW_SCHEMAS}

    def raw_tables(self, on_bad: str = "fail") -> tuple[DataFrame, DataFrame, DataFrame]:
        paths = self.raw_paths()
        require_inputs(self.spark, paths)
        sales, features_, stores = (
            read_table(self.spark, paths[n], s, on_bad=on_bad) for n, s in schema.RAW_SCHEMAS.items()
        )
        return sales, features_, stores

    def panel(self) -> DataFrame:
        path = self.at("panel.parquet", self.processed)
        require_inputs(self.spark, {"panel": path})
        df = read_table(self.spark, path)
        require_columns(df, [*schema.SALES_KEY, "weekly_sales"])
        return df

    def out(self, name: str, folder: str | None = None) -> str:
        """Where a stage writes a table; between stages, where the table is."""
        folder = folder or self.outputs
        if self.pending is None:
            return self.at(name, folder)
        published = Published(self.spark, folder)
        place = self.pending.setdefault(folder, {}).setdefault(name, f"{published.fresh()}/{name}")
        return f"{published.folder}/{place}"

    def at(self, name: str, folder: str | None = None) -> str:
        """Where a table is read: as the running stage wrote it, or as it was handed over last."""
        published = Published(self.spark, folder or self.outputs)
        written = (self.pending or {}).get(folder or self.outputs, {}).get(name)
        return f"{published.folder}/{written}" if written else published.path(name)

    def write(self, name: str, df: DataFrame) -> None:
        # Results are short tables. The shuffle to one file comes after their last stage, which keeps
        # its tasks; an ordered frame is sorted by a range shuffle, so its parts are gathered in order.
        ordered = df.withColumn("__place", F.monotonically_increasing_id()).repartition(1)
        write_table(ordered.sortWithinPartitions("__place").drop("__place"), self.out(name))

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.at(name))


def inspect(job: Job) -> None:
    """Profile the raw files."""
    require_inputs(job.spark, job.raw_paths())
    shapes, types, nulls, keys, copies = [], [], [], [], []
    for name, path in job.raw_paths().items():
        df = read_table(job.spark, path)
        shapes.append(profile.shape(df, name))
        types += [(name, *t) for t in profile.column_types(df)]
        job.write(f"profile_first_rows_{name}", profile.first_rows(df, schema.RAW_KEYS[name]))
        nulls.append(_named(profile.null_profile(df), name))
        keys.append(_named(profile.key_stats(df, schema.RAW_KEYS[name]), name))
        copies.append(_named(profile.duplicate_rows(df), name))
        if "date" in df.columns:
            job.write(f"profile_dates_{name}", profile.date_range(df))
    job.write("profile_shapes", _all(shapes))
    job.write("profile_column_types", job.spark.createDataFrame(types, "table_name string, position int, column_name string, type string"))
    job.write("profile_nulls", _all(nulls))
    job.write("profile_keys", _all(keys))
    job.write("profile_duplicates", _all(copies))


def validate(job: Job) -> None:
    """Check the relationships between the raw tables."""
    sales, features_, stores = job.raw_tables()
    found = checks.relationship_checks(sales, features_, stores).persist()
    job.write("relationship_checks", found)
    job.write("relationship_verdict", checks.verdict(found))
    job.write("panel_cardinality", checks.panel_cardinality(sales))
    job.write("panel_balance", checks.panel_balance(sales))
    # The rows behind the counts.
    job.write("key_coverage", checks.key_coverage(sales, features_))
    job.write("store_coverage", checks.store_coverage(sales, stores))
    job.write("holiday_variation", checks.holiday_variation(sales))
    job.write("holiday_mismatch", checks.holiday_mismatch(sales, features_))
    write_table(checks.unmatched_rows(sales, features_, schema.FEATURES_KEY), job.out("sales_without_features"))
    write_table(checks.unmatched_rows(sales, stores, schema.STORES_KEY), job.out("sales_without_store"))
    found.unpersist()


def prepare(job: Job) -> None:
    """Clean and join the raw tables; stops if a guard fails."""
    sales, features_, stores = job.raw_tables()
    panel = clean.checked_panel(sales, features_, stores)
    # Rows of a year go to one directory, in a bounded number of files.
    panel = panel.repartition("year", F.pmod(F.hash("store_id"), F.lit(YEAR_FILES)))
    write_table(panel, job.out("panel.parquet", job.processed), "parquet", partition_by=["year"])


def audit(job: Job) -> None:
    """Reconcile the panel with the raw sales."""
    sales, _, _ = job.raw_tables()
    panel = job.panel()
    found = checks.audit_checks(sales, panel).persist()
    job.write("audit_checks", found)
    job.write("audit_verdict", checks.verdict(found))
    job.write("audit_sales_signs", checks.sales_sign_counts(panel))
    job.write("audit_negative_flag", checks.negative_flag_mismatches(panel))
    job.write("audit_holiday_names", profile.value_counts(panel, "holiday_name"))
    job.write("audit_reconciliation", checks.reconciliation(sales, panel))
    job.write("audit_holiday_labels", checks.holiday_label_violations(panel))
    job.write("audit_calendar", checks.calendar_mismatches(panel))
    job.write("audit_sales_distribution", profile.distribution(panel, "weekly_sales"))
    job.write("audit_ranges", profile.numeric_ranges(panel, [*schema.ECONOMY, *schema.MARKDOWNS, "store_size"]))
    found.unpersist()


def describe(job: Job) -> None:
    """The summer rollups."""
    summer = rollups.summer(rollups.with_markdown_total(job.panel()))
    summer = read_table(job.spark, write_table(summer, job.out("summer_sales.parquet", job.processed), "parquet"))
    job.write("yearly_summer_sales", rollups.sales_by_year(summer))
    job.write("monthly_summer_sales", rollups.sales_by_month(summer))
    job.write("weekly_summer_sales_trend", rollups.sales_by_week(summer))
    job.write("holiday_sales_summary", rollups.sales_by_holiday(summer))
    job.write("markdown_sales_summary", rollups.sales_by_markdown(summer))
    for key in ("store_type", "region", "department"):
        job.write(f"{key}_sales_summary", rollups.ranked_totals(summer, key))
    job.write("top_departments", rollups.ranked_totals(summer, "department", 10))
    job.write("sales_by_temperature", rollups.sales_by_temperature(summer))
    write_table(rollups.subset_profile(summer), job.out("summer_profile.parquet", job.processed), "parquet")


def baseline(job: Job) -> None:
    """Naive company forecasts of the test period and their accuracy."""
    forecasts = features.company_forecasts(job.panel())
    _, tests = features.time_split(forecasts, job.test_start, job.test_end)
    job.write("baseline_forecast", tests.orderBy("date"))
    job.write("baseline_model_comparison", metrics.company_evaluation(tests, features.NAIVE_FORECASTS))


def statistical(job: Job) -> None:
    """ARIMA and SARIMA forecasts of company sales."""
    series = features.company_series(job.panel()).persist()
    long = reduce(
        DataFrame.unionByName,
        [arima.company_forecast(series, job.test_start, job.test_end, s) for s in (False, True)],
    ).persist()
    job.write("arima_sarima_forecast", long.orderBy("model", "date"))
    comparison = arima.company_comparison(long)
    job.write("arima_sarima_model_comparison", comparison)
    earlier = optional_table(job.spark, job.at("baseline_model_comparison"))
    if earlier is not None:
        job.write("model_comparison_baseline_arima", metrics.by_mape(stack_tables(earlier, comparison)))
    long.unpersist()
    series.unpersist()


def _model_rows(job: Job) -> DataFrame:
    panel = rollups.with_markdown_total(job.panel())
    return models.model_rows(features.series_features(panel))


def regression(job: Job) -> None:
    """The three regression models on all features, at both levels, with feature importance."""
    rows = _model_rows(job)
    train, test = features.time_split(rows, job.test_start, job.test_end)
    features.require_nonempty(train, test)
    numeric, categorical = features.scenario_features(features.FULL, rows.columns)
    prepared = models.fit_preprocessor(train, numeric, categorical)
    assembled = prepared.transform(train)
    fitted = models.train_models(assembled, job.sizes, prepared)
    scored = models.score(fitted, prepared.transform(test)).persist()
    job.write("ml_model_comparison", models.model_comparison(scored))
    for key in schema.SERIES_KEY:
        by = metrics.metrics(scored, models.TARGET, "predicted", ["model", key])
        job.write(f"ml_error_by_{key}", by.orderBy("model", key))
    models.save_forecaster(prepared, fitted, job.out("regression_models"))
    columns = {"pred_" + m.lower().replace(" ", "_"): m for m in fitted}
    write_table(metrics.prediction_table(scored, columns), job.out("ml_forecast"))
    company = metrics.by_mape(metrics.summed_evaluation(scored, models.TARGET))
    job.write("ml_aggregate_model_comparison", company)
    earlier = optional_table(job.spark, job.at("model_comparison_baseline_arima"))
    if earlier is not None:
        final = metrics.by_mape(stack_tables(earlier, company))
        job.write("final_comparable_model_comparison", final)
    if models.BOOSTED in fitted:
        job.write("boosted_feature_importance", models.feature_importance(fitted[models.BOOSTED], assembled))
    scored.unpersist()


def sensitivity(job: Job) -> None:
    """All models with and without the features that may be unknown at forecast time."""
    train, test = features.time_split(_model_rows(job), job.test_start, job.test_end)
    features.require_nonempty(train, test)
    scored = models.scenario_grid(train, test, job.sizes, at_once=job.fits_at_once).persist()
    granular, company = models.scenario_comparison(scored)
    job.write("feature_availability_granular_comparison", granular)
    job.write("feature_availability_aggregate_comparison", company)
    job.write("feature_availability_sensitivity", backtest.sensitivity(company))
    scored.unpersist()


def rolling_origin(job: Job) -> None:
    """Backtest the tree models over expanding training periods."""
    rows = _model_rows(job)
    numeric, categorical = features.scenario_features(features.OPERATIONAL, rows.columns)
    features.require_feature_count(numeric + categorical)
    weeks = backtest.week_counts(rows)
    plan = backtest.fold_plan(weeks, job.initial_train_weeks, job.test_weeks).persist()
    backtest.require_complete_folds(weeks, plan, job.test_weeks)
    trees = models.Sizes(**{**job.sizes.__dict__, "models": (models.FOREST, models.BOOSTED)})
    scored = models.backtest_scores(
        rows, backtest.folds(plan), numeric, categorical, trees, job.fits_at_once
    )
    scored = materialize(scored, "fold-scores")
    base = backtest.baseline_predictions(job.panel(), plan)
    results = backtest.fold_results(
        weeks, scored, base, plan, len(numeric + categorical), test_weeks=job.test_weeks
    ).persist()
    job.write("rolling_origin_fold_plan", plan)
    job.write("rolling_origin_fold_results", results)
    job.write("rolling_origin_company_predictions", backtest.weekly_predictions(scored, base))
    job.write("rolling_origin_fold_winners", backtest.fold_winners(results))
    job.write("rolling_origin_summary", backtest.backtest_summary(results))
    results.unpersist()


def business(job: Job) -> None:
    """The table of business figures, from the written outputs and the stored summer rows."""
    summer_path = job.at("summer_sales.parquet", job.processed)
    names = ["rolling_origin_summary", "rolling_origin_fold_winners"]
    require_inputs(job.spark, {"summer sales": summer_path, **{n: job.at(n) for n in names}})
    summer, summary = read_table(job.spark, summer_path), job.read("rolling_origin_summary")
    figures = [
        kpi.growth(summer),
        kpi.best_month(summer, MONTH_NAMES),
        kpi.top_group(rollups.total_by(summer, "store_type"), "store_type"),
        kpi.top_group(rollups.total_by(summer, "region"), "region"),
        kpi.selected_model(summary),
        kpi.wape_reduction(summary),
    ]
    job.write("business_summary_metrics", kpi.kpi_table(figures))
    won = kpi.winning_folds(summary, job.read("rolling_origin_fold_winners"))
    job.write("business_winning_folds", won.withColumn("folds_won", F.array_join("folds_won", ",")))
    job.write("business_top_departments", rollups.ranked_totals(summer, "department", 5))
    job.write("holiday_lift", kpi.holiday_lift(rollups.sales_by_holiday(summer)))


def coming_week(job: Job) -> None:
    """Rows of the week after the last one, as far as they are known, and their forecasts.

    Holidays and promotions come from the raw features, if they reach that far; the models learn from
    all complete rows, on the features that are known ahead, or are those of an earlier week if they may be
    used again.
    """
    _, raw_features, _ = job.raw_tables()
    panel = job.panel()
    ahead = raw_features.where(F.col("date") > panel.agg(F.max("date")).scalar())
    planned = rollups.with_markdown_total(clean.fill_texts(clean.fill_markdowns(ahead))).drop("season", *schema.ECONOMY)
    rows = features.next_week_rows(panel, planned)
    coming = read_table(job.spark, write_table(rows, job.out("coming_week.parquet", job.processed), "parquet"))
    kept = job.at("coming_week_models")
    if job.reuse_models and path_exists(job.spark, f"{kept}/settings"):
        prepared, fitted = models.load_forecaster(job.spark, kept)
    else:
        past = _model_rows(job)
        numeric, categorical = features.scenario_features(features.OPERATIONAL, past.columns)
        prepared, fitted = models.fit_forecaster(past, coming, numeric, categorical, job.sizes)
        models.save_forecaster(prepared, fitted, job.out("coming_week_models"))
    scored = models.score(fitted, prepared.transform(coming)).drop(models.TARGET)
    job.write("coming_week_forecast", scored.orderBy("model", *schema.SALES_KEY))


def handed_over(stage: Callable[[Job], None]) -> Callable[[Job], None]:
    """Run a stage whose tables become current together, after the last of them is written; one that fails
    on the way leaves the earlier results readable."""

    def run(job: Job) -> None:
        job.pending = {}
        try:
            stage(job)
            written = job.pending
        finally:
            job.pending = None
        # Intermediate tables first, so that results never point beyond them.
        for folder in sorted(written, key=lambda f: f == job.outputs):
            Published(job.spark, folder).hand_over(written[folder])

    return run


_STAGES: dict[str, Callable[[Job], None]] = {
    "inspect": inspect,
    "validate": validate,
    "prepare": prepare,
    "audit": audit,
    "describe": describe,
    "baseline": baseline,
    "statistical": statistical,
    "regression": regression,
    "sensitivity": sensitivity,
    "rolling-origin": rolling_origin,
    "business": business,
    "coming-week": coming_week,
}
STAGES = {name: handed_over(stage) for name, stage in _STAGES.items()}


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), *df.columns)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
