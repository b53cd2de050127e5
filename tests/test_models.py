"""Regression models against independent computations."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailcast.operators import metrics, models

START = dt.date(2022, 1, 1)
SMALL = models.Sizes(forest_trees=5, forest_depth=4, boosting_rounds=5, boosting_depth=3, boosting_rate=0.3)
NUMERIC, CATEGORICAL = ["a", "b"], ["store_id", "color"]


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        store, color = int(rng.integers(1, 4)), ["red", "blue"][int(rng.integers(0, 2))]
        a, b = float(rng.normal()), float(rng.normal())
        y = 3 * a - 2 * b + 5 * store + (4 if color == "red" else 0) + float(rng.normal() * 0.1)
        out.append((store, i % 7, START + dt.timedelta(weeks=i), y, a, b, color))
    return out


@pytest.fixture(scope="module")
def data(spark):
    schema = "store_id long, department int, date date, weekly_sales double, a double, b double, color string"
    df = spark.createDataFrame(rows(), schema).repartition(2, "department").persist()
    cut = START + dt.timedelta(weeks=300)
    return df.where(F.col("date") < F.lit(cut)), df.where(F.col("date") >= F.lit(cut))


def test_linear_regression_equals_least_squares(data):
    train, test = data
    scored = models.fit_and_score(train, test, NUMERIC, CATEGORICAL, models.Sizes(models=(models.LINEAR,)))
    got = {r["date"]: r["predicted"] for r in scored.collect()}

    def design(frame):
        stores, colors = (1, 2, 3), ("red", "blue")
        return np.column_stack(
            [frame["a"], frame["b"], np.ones(len(frame))]
            + [(frame["store_id"] == s).astype(float) for s in stores]
            + [(frame["color"] == c).astype(float) for c in colors]
        )

    left, right = train.toPandas(), test.toPandas()
    weights = np.linalg.lstsq(design(left), left["weekly_sales"].to_numpy(), rcond=None)[0]
    want = design(right) @ weights
    assert [got[d] for d in right["date"]] == pytest.approx(list(want), abs=1e-6)


def test_trees_beat_the_mean_and_repeat(data):
    train, test = data
    sizes = models.Sizes(**{**SMALL.__dict__, "models": (models.FOREST, models.BOOSTED)})
    runs = [models.fit_and_score(train, test, NUMERIC, CATEGORICAL, sizes).persist() for _ in range(2)]
    tables = [sorted((r["model"], r["date"], r["predicted"]) for r in run.collect()) for run in runs]
    assert tables[0] == tables[1]
    mean = train.agg(F.avg("weekly_sales")).first()[0]
    plain = metrics.metrics(test.withColumn("p", F.lit(mean)), "weekly_sales", "p").first()["rmse"]
    for row in models.model_comparison(runs[0]).collect():
        assert row["rmse"] < 0.7 * plain and row["n_test_rows"] == 100


def test_fill_values_come_from_training(spark):
    schema = "store_id long, department int, date date, weekly_sales double, a double, b double, color string"
    raw = [
        (1, 1, START, 1.0, 1.0, 0.0, "red"),
        (1, 2, START, 1.0, 1.5, 0.0, "red"),
        (2, 3, START, 1.0, 2.0, 0.0, "blue"),
        (2, 4, START, 1.0, 4.0, 0.0, None),
        (2, 5, START, 1.0, None, 0.0, "blue"),
        (10, 6, START, 1.0, None, 0.0, None),
    ]
    train = spark.createDataFrame(raw, schema)
    fitted = models.fit_preprocessor(train, NUMERIC, CATEGORICAL)
    assert fitted.medians["a"] == 1.75
    assert fitted.modes == {"store_id": "2", "color": "blue"}
    later = spark.createDataFrame([(99, 1, START, 1.0, None, 5.0, "green"), (10, 1, START, 1.0, 3.0, 5.0, None)], schema)
    unseen, filled = [r["features"].toArray().tolist() for r in fitted.transform(later).collect()]
    # a, b, colors blue and red, the mean target of the store
    assert unseen == [1.75, 5.0, 0, 0, 1.0]
    assert filled == [3.0, 5.0, 1, 0, 1.0]


def test_width_does_not_follow_the_stores(spark):
    raw = [(s, 1, START, float(s), 1.0 * (s % 7), 0.5, "red") for s in range(300)]
    schema = "store_id long, department int, date date, weekly_sales double, a double, b double, color string"
    train = spark.createDataFrame(raw, schema)
    prepared = models.fit_preprocessor(train, NUMERIC, CATEGORICAL)
    assert prepared.transform(train).first()["features"].size == 4
    assert (len(prepared.line.numbers), prepared.line.levels["color"].keys()) == (2, {"red"})


def linear_only(train, test, numeric, categorical):
    scored = models.fit_and_score(train, test, numeric, categorical, models.Sizes(models=(models.LINEAR,)))
    return {(r["store_id"], r["date"]): r["predicted"] for r in scored.collect()}


def test_least_squares_with_gaps_collinear_and_constant_columns(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        store, color = int(rng.integers(1, 6)), [None, "red", "blue", "green"][int(rng.integers(0, 4))]
        a, b = float(rng.normal(1000, 3)), float(rng.normal(-40, 2))
        y = 1e5 + 7 * a - 2 * b + 50 * store + (9 if color == "red" else 0) + float(rng.normal())
        rows.append((store, 1, START + dt.timedelta(weeks=i), y, None if i % 11 == 0 else a, b, a + b, 10.0 * store, color))
    schema = "store_id long, department int, date date, weekly_sales double, a double, b double, c double, size double, color string"
    df = spark.createDataFrame(rows, schema)
    numeric, cut = ["a", "b", "c", "size"], START + dt.timedelta(weeks=500)
    train, test = df.where(F.col("date") < F.lit(cut)), df.where(F.col("date") >= F.lit(cut))
    got = linear_only(train, test, numeric, ["store_id", "color"])
    left, right = train.toPandas(), test.toPandas()
    median = left["a"].median()
    counts = left["color"].value_counts()
    mode = sorted(counts.index, key=lambda v: (-counts[v], v))[0]

    def design(frame):
        colors = frame["color"].fillna(mode)
        parts = [frame["a"].fillna(median), frame["b"], frame["c"], frame["size"]]
        return np.column_stack(parts + [(frame["store_id"] == s).astype(float) for s in range(1, 6)] + [(colors == c).astype(float) for c in ("red", "blue", "green")])

    # Centred columns, so that the check itself is well conditioned.
    centre = design(left).mean(axis=0)
    wide = lambda frame: np.column_stack([design(frame) - centre, np.ones(len(frame))])
    weights = np.linalg.lstsq(wide(left), left["weekly_sales"].to_numpy(), rcond=1e-10)[0]
    want = wide(right) @ weights
    assert [got[s, d] for s, d in zip(right["store_id"], right["date"])] == pytest.approx(list(want), abs=1e-4)


def test_one_preparation_serves_all_folds(spark, data):
    train, test = data
    rows = train.unionByName(test)
    from retailcast.operators.backtest import Fold

    week = lambda n: START + dt.timedelta(weeks=n)
    folds = [Fold(i + 1, week(100 + 60 * i), week(159 + 60 * i)) for i in range(5)]
    sizes = models.Sizes(models=(models.LINEAR,))
    together = models.backtest_scores(rows, folds, NUMERIC, CATEGORICAL, sizes)
    got = {(r["fold"], r["date"]): r["predicted"] for r in together.collect()}
    for fold in folds:
        left, right = rows.where(F.col("date") < F.lit(fold.test_start)), rows.where(F.col("date").between(F.lit(fold.test_start), F.lit(fold.test_end)))
        alone = models.fit_and_score(left, right, NUMERIC, CATEGORICAL, sizes)
        for r in alone.collect():
            assert got[fold.number, r["date"]] == pytest.approx(r["predicted"], abs=1e-6)
    assert len(got) == 300


def test_reads_do_not_grow_with_the_folds(spark, monkeypatch):
    """Passes over the rows of one preparation: the same for one lesson and for twenty."""
    rows = spark.createDataFrame(rows_with_weeks(), "store_id long, department int, date date, weekly_sales double, a double, b double, color string")
    passes = []
    for count in (1, 20):
        reads = spark.sparkContext.accumulator(0)

        def seen(batches, reads=reads):
            reads.add(1)
            yield from batches

        counted = rows.coalesce(1).mapInArrow(seen, rows.schema)
        lessons = [models.Lesson(str(i), tuple(NUMERIC), tuple(CATEGORICAL), i) for i in range(count)]
        block = F.floor(F.datediff("date", F.lit(START)) / 70).cast("int")
        models.learn(counted, lessons, block)
        passes.append(reads.value)
    assert passes[0] == passes[1] <= 4


def rows_with_weeks():
    return [(s, d, START + dt.timedelta(weeks=w), float(s * w % 17), float(w % 5), float(s), "red" if w % 2 else "blue") for s in range(4) for d in range(2) for w in range(200)]


def test_importance_names(data):
    train, _ = data
    assembled = models.fit_preprocessor(train, NUMERIC, CATEGORICAL).transform(train)
    sizes = models.Sizes(**{**SMALL.__dict__, "models": (models.BOOSTED,)})
    model = models.train_models(assembled, sizes)[models.BOOSTED]
    got = models.feature_importance(model, assembled).collect()
    names = {r["feature"] for r in got}
    assert names == {"num__a", "num__b", "stat__store_id", "cat__color_blue", "cat__color_red"}
    assert sum(r["importance"] for r in got) == pytest.approx(1)
    assert [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)


def test_default_sizes():
    grid = models.estimators()
    forest, boosted = grid[models.FOREST], grid[models.BOOSTED]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (100, 12, 5)
    assert forest.getFeatureSubsetStrategy() == "all"
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (300, 6, 0.05)
    assert (boosted.getSubsamplingRate(), boosted.getFeatureSubsetStrategy()) == (0.8, "0.8")


def test_prediction_table(data):
    train, test = data
    scored = models.fit_and_score(train, test, NUMERIC, CATEGORICAL, models.Sizes(models=(models.LINEAR,)))
    wide = metrics.prediction_table(scored, {"pred_linear": models.LINEAR})
    assert wide.columns == ["store_id", "department", "date", "weekly_sales", "pred_linear"]
    assert wide.count() == 100 and wide.where("pred_linear is null").count() == 0


def test_merged_rows_give_the_trees_of_the_rows(spark, monkeypatch):
    """Unweighted fits on all rows, and fits on merged rows: the same trees, least leaf included."""
    raw = [(s, d, START + dt.timedelta(weeks=w), float((w * 7 + s * 5) % 23), float(w % 6), float(s % 2), "red" if w % 3 else None) for s in range(3) for d in range(2) for w in range(31)]
    raw.append((1, 1, START, 500.0, 99.0, 1.0, "red"))  # alone, and so never a leaf of a forest
    df = spark.createDataFrame([*raw, *raw[:40]], "store_id long, department int, date date, weekly_sales double, a double, b double, color string")
    sizes = models.Sizes(forest_trees=1, forest_depth=3, forest_bootstrap=False, boosting_rounds=3, boosting_depth=2, row_sample=1.0, column_sample=1.0, models=(models.FOREST, models.BOOSTED))
    assembled = models.fit_preprocessor(df, NUMERIC, ["color"]).transform(df)
    sizes_seen = []
    write = models.materialize

    def counted(table, label, rows_per_file=0):
        out = write(table, label, rows_per_file)
        sizes_seen.append((label, out.count()))
        return out

    monkeypatch.setattr(models, "materialize", counted)
    merged = models.train_models(assembled, sizes)
    assert sizes_seen == [("merged-rows", df.select("a", "b", F.coalesce("color", F.lit("red"))).distinct().count())]
    for name, estimator in models.estimators(sizes).items():
        alone = estimator.fit(assembled)
        got = [[r["prediction"] for r in m.transform(assembled).orderBy("date", "store_id", "department").collect()] for m in (alone, merged[name])]
        assert got[0] == pytest.approx(got[1])
        assert merged[name].featureImportances.toArray() == pytest.approx(alone.featureImportances.toArray())


def test_backtest_of_merged_rows_reads_the_training_rows_once(spark, data):
    train, test = data
    from retailcast.operators.backtest import Fold

    week = lambda n: START + dt.timedelta(weeks=n)
    rows = train.unionByName(test)
    folds = [Fold(i + 1, week(100 + 60 * i), week(159 + 60 * i)) for i in range(3)]
    sizes = models.Sizes(forest_trees=1, forest_depth=2, forest_bootstrap=False, models=(models.FOREST,))
    together = models.backtest_scores(rows, folds, ["a"], ["color"], sizes)
    got = {(r["fold"], r["date"]): r["predicted"] for r in together.collect()}
    for fold in folds:
        left, right = rows.where(F.col("date") < F.lit(fold.test_start)), rows.where(F.col("date").between(F.lit(fold.test_start), F.lit(fold.test_end)))
        for r in models.fit_and_score(left, right, ["a"], ["color"], sizes).collect():
            assert got[fold.number, r["date"]] == pytest.approx(r["predicted"])
    assert len(got) == 180


def test_files_of_assembled_rows_are_bounded(spark, monkeypatch, data):
    """Drawn rows are not merged; no file holds more of them than a task may read."""
    train, _ = data
    monkeypatch.setattr(models, "ROWS_PER_FILE", 50)
    files = []
    write = models.materialize
    monkeypatch.setattr(models, "materialize", lambda *a: files.append(write(*a)) or files[-1])
    models.train_models(models.fit_preprocessor(train, ["a"], []).transform(train), models.Sizes(**{**SMALL.__dict__, "models": (models.BOOSTED,)}))
    counts = [r["count"] for r in files[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == 300 and max(counts) <= 50


def test_shallow_trees_keep_no_node_ids(data):
    """Node ids are kept for deep trees only, and the trees are the same either way."""
    assert models.estimators()[models.FOREST].getCacheNodeIds()
    train, _ = data
    assembled = models.fit_preprocessor(train, NUMERIC, CATEGORICAL).transform(train).persist()
    for name, estimator in models.estimators(SMALL).items():
        assert not estimator.getCacheNodeIds(), name
        models.checkpoint_here(train.sparkSession)
        trees = [estimator.copy().setCacheNodeIds(ids).fit(assembled).toDebugString.split("\n", 1)[1] for ids in (False, True)]
        assert trees[0] == trees[1], name


def test_fits_leave_no_copy_of_their_rows(spark, data, monkeypatch):
    """Scenarios and folds one after the other hold one copy of the training rows at a time."""
    train, test = data
    written = []
    write = models.materialize

    def seen(table, label, rows_per_file=0):
        out = write(table, label, rows_per_file)
        if label in ("assembled-rows", "merged-rows"):
            written.append((label, Path(out.inputFiles()[0].removeprefix("file://")).parent))
        return out

    monkeypatch.setattr(models, "materialize", seen)
    drawn = models.Sizes(**{**SMALL.__dict__, "models": (models.FOREST, models.BOOSTED)})
    alike = models.Sizes(forest_trees=1, forest_depth=2, forest_bootstrap=False, models=(models.FOREST,))
    counts = [models.fit_and_score(train, test, NUMERIC, CATEGORICAL, sizes).count() for sizes in (drawn, alike)]
    assert counts == [200, 100]
    assert [label for label, _ in written] == ["assembled-rows", "merged-rows"]
    assert not any(folder.exists() for _, folder in written)


def test_backtest_writes_the_forecasts_of_each_fold(spark, data, monkeypatch):
    """The trees of a fold are not kept for a scoring at the end."""
    from retailcast.operators.backtest import Fold

    rows = data[0].unionByName(data[1])
    folds = [Fold(i + 1, START + dt.timedelta(weeks=100 + 60 * i), START + dt.timedelta(weeks=159 + 60 * i)) for i in range(2)]
    labels = []
    write = models.materialize
    monkeypatch.setattr(models, "materialize", lambda table, label, *a: labels.append(label) or write(table, label, *a))
    scored = models.backtest_scores(rows, folds, ["a"], ["color"], models.Sizes(**{**SMALL.__dict__, "models": (models.FOREST,)}))
    assert labels.count("fold-forecasts") == 2
    assert [(r["fold"], r["count"]) for r in scored.groupBy("fold").count().orderBy("fold").collect()] == [(1, 60), (2, 60)]


def test_series_shuffle_moves_what_the_scenario_needs(spark, monkeypatch):
    """The rows of one scenario are dealt out by series without its unknown features, and without what follows from the date."""
    from retailcast.operators import features
    from retailcast.queries import modelling

    numbers = [*features.AVAILABILITY["possibly_unavailable"], *[f"markdown_{i}" for i in range(1, 6)], "store_size"]
    rows = spark.createDataFrame([(1, 1, START + dt.timedelta(weeks=w), float(w), 0, *[1.0] * len(numbers)) for w in range(12)], "store_id long, department int, date date, weekly_sales double, is_holiday int, " + ", ".join(f"{n} double" for n in numbers))
    monkeypatch.setattr(modelling, "panel", lambda *_: modelling.clean.clean_sales(rows))
    monkeypatch.setattr(modelling.orders_panel, "partitions", lambda *_: 3)
    plans = []
    monkeypatch.setattr(models, "materialize_alone", lambda table, label: plans.append(table) or table)
    for scenario in (features.FULL, features.OPERATIONAL):
        train, _ = modelling.split(spark, "no folder", scenario)
        assert {"rolling_std_4", "markdown_5", "year"} <= set(train.columns)
        assert ("cpi" in train.columns) == (scenario == features.FULL)
    for table in plans:
        nodes, moved = [table._jdf.queryExecution().optimizedPlan()], []
        while nodes:
            node = nodes.pop()
            if node.nodeName().startswith("Repartition"):
                moved += [c.split("#")[0] for c in node.output().mkString(" ").split(" ")]
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert "weekly_sales" in moved and not {"year", "month", "week_of_year", "is_negative_sales"} & set(moved)
        assert ("cpi" in moved) == (table is plans[0])
