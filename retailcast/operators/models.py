"""Regression forecasts with spark.ml: linear, random forest and boosted trees."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.functions.quantiles import exact_quantiles, prefix_quantiles
from retailcast.operators import features as ft
from retailcast.operators.backtest import Fold, fold_split
from retailcast.operators.metrics import SERIES_LEVEL, evaluate, series_evaluation, summed_evaluation
from retailcast.operators.moments import Case, Layout, Line, collect_moments, solve, store_table
from retailcast.schema import SALES_KEY
from retailcast.session import checkpoint_here, discard, materialize, materialize_alone

TARGET = "weekly_sales"
# The category whose number of levels grows with the data.
WIDE = "store_id"

# Model names and sizes of the default grid.
LINEAR = "Linear Regression"
FOREST = "Random Forest"
BOOSTED = "Boosted Trees"
SEED = 42
# Trees, or levels of trees, after which a long fit cuts its lineage.
CHECKPOINT_EVERY = 10
# Trees up to this depth are small: a task walks them again at every level. Node ids of deeper ones are kept with
# the rows, at 16 bytes and 4 a tree for each row and level held.
SHALLOW = 6
# How many rows a merged training row stands for.
WEIGHT = "__weight"
# Rows per file of assembled rows; a task reads at most 32 files (by Spark's defaults), so that its part stays
# bounded however well the rows compress.
ROWS_PER_FILE = 100_000


@dataclass(frozen=True)
class Sizes:
    """Sizes of the tree models; smaller ones trade accuracy for time."""

    forest_trees: int = 100
    forest_depth: int = 12
    forest_min_leaf: int = 5
    # Each tree sees a bootstrap sample of the rows; without it, all rows.
    forest_bootstrap: bool = True
    boosting_rounds: int = 300
    boosting_depth: int = 6
    boosting_rate: float = 0.05
    row_sample: float = 0.8
    column_sample: float = 0.8
    # Named models only; the default is all three.
    models: tuple[str, ...] = field(default=(LINEAR, FOREST, BOOSTED))


def random_forest(sizes: Sizes = Sizes()) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="label",
        numTrees=sizes.forest_trees,
        maxDepth=sizes.forest_depth,
        minInstancesPerNode=sizes.forest_min_leaf,
        featureSubsetStrategy="all",
        bootstrap=sizes.forest_bootstrap,
        maxMemoryInMB=1024,
        cacheNodeIds=sizes.forest_depth > SHALLOW,
        checkpointInterval=CHECKPOINT_EVERY,
        seed=SEED,
    )


def boosted_trees(sizes: Sizes = Sizes()) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features",
        labelCol="label",
        lossType="squared",
        maxIter=sizes.boosting_rounds,
        maxDepth=sizes.boosting_depth,
        stepSize=sizes.boosting_rate,
        subsamplingRate=sizes.row_sample,
        featureSubsetStrategy=str(sizes.column_sample),
        maxMemoryInMB=1024,
        cacheNodeIds=sizes.boosting_depth > SHALLOW,
        checkpointInterval=CHECKPOINT_EVERY,
        seed=SEED,
    )


def estimators(sizes: Sizes = Sizes()) -> dict:
    """The tree models among the named ones; least squares is fitted from sums instead."""
    every = {FOREST: lambda: random_forest(sizes), BOOSTED: lambda: boosted_trees(sizes)}
    return {name: every[name]() for name in sizes.models if name in every}


def _draws_rows(name: str, sizes: Sizes) -> bool:
    """Whether a tree model draws rows at random, so that each of them counts by itself."""
    return sizes.forest_bootstrap if name == FOREST else sizes.row_sample < 1


def _merges_rows(sizes: Sizes) -> bool:
    """Whether there are tree models, and none of them draws rows."""
    trees = estimators(sizes)
    return bool(trees) and not any(_draws_rows(name, sizes) for name in trees)


# --- preprocessing ------------------------------------------------------------------------------


def numeric_medians(train: DataFrame, numeric: list[str]) -> DataFrame:
    """(feature, value): the exact median of each numeric feature."""
    return exact_quantiles(train, numeric, [0.5]).select(F.col("column").alias("feature"), "value")


def category_modes(train: DataFrame, categorical: list[str]) -> DataFrame:
    """(feature, value): the most frequent value of each categorical feature; of equals, the
    smallest (numbers by size, texts by order)."""
    texts = train.select([F.col(c).cast("string").alias(c) for c in categorical])
    counts = (
        texts.unpivot([], categorical, "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("number", F.col("value").try_cast("double"))
    )
    return counts.groupBy("feature").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("number"), F.col("value"))).alias("value")
    )


def _number(name: str) -> str:
    return f"num__{name}"


def _category(name: str) -> str:
    return f"cat__{name}"


@dataclass
class Preprocessor:
    """What training data taught: fill values, levels of short categories, the mean of the target for each
    store, and the least squares line.

    Short categories are one-hot. Stores are not, as their number grows with the data: the trees get
    the mean target of a row's store in training, and least squares works on deviations from store
    means, which gives the predictions that one column per store would give. A store not seen in
    training has the overall means, a level not seen an all-zero block.
    """

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    levels: dict[str, list[str]]
    overall: float
    line: Line
    # store, base, mean; None without stores.
    stores: DataFrame | None

    @property
    def inputs(self) -> dict[str, Column]:
        columns = {_number(c): F.col(_number(c)) for c in self.numeric}
        for category, levels in self.levels.items():
            for i, level in enumerate(levels):
                name = f"hot__{category}_{re.sub(r'[^0-9A-Za-z_]', '_', level)}"
                name = f"{name}_{i}" if name in columns else name
                columns[name] = (F.col(_category(category)) == level).cast("double")
        return columns

    def _filled(self, df: DataFrame) -> DataFrame:
        # Prefixed names keep features that are also keys (store, department) apart from the keys,
        # and name the model's inputs.
        number = {_number(c): F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0))) for c in self.numeric}
        text = {_category(c): F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c, ""))) for c in self.categorical}
        return df.withColumns({**number, **text})

    def transform(self, df: DataFrame) -> DataFrame:
        """Key, target, the assembled ``features`` for trees, and ``linear``, the least squares prediction.

        Either of the last two costs nothing where it is not used.
        """
        keep = [c for c in [*SALES_KEY, TARGET, WEIGHT] if c in df.columns]
        label = {"label": F.col(TARGET).cast("double")} if TARGET in keep else {}
        rows = self._filled(df)
        parts = [F.col(_number(c)) * w for c, w in self.line.numbers.items()]
        for category, weights in self.line.levels.items():
            if weights:
                table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
                parts.append(F.coalesce(F.element_at(table, F.col(_category(category))), F.lit(0.0)))
        base, mean = F.lit(self.line.base), F.lit(self.overall)
        if self.stores is not None:
            known = self.stores.withColumnsRenamed({"store": "__store", "base": "__base", "mean": "__mean"})
            rows = rows.join(known, F.col(_category(WIDE)) == F.col("__store"), "left")
            base, mean = F.coalesce("__base", base), F.coalesce("__mean", mean)
        columns = self.inputs | label | {"linear": reduce(Column.__add__, parts, base), f"stat__{WIDE}": mean}
        rows = rows.select(*keep, *[c.alias(n) for n, c in columns.items()])
        trees = list(self.inputs) + ([f"stat__{WIDE}"] if self.stores is not None else [])
        rows = VectorAssembler(inputCols=trees, outputCol="features").transform(rows)
        return rows.select(*keep, *label, "features", "linear")


@dataclass(frozen=True)
class Lesson:
    """Features to learn from, and up to which block of rows."""

    name: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    upto: int = 0


def _category_counts(rows: DataFrame, categorical: list[str], block: Column) -> DataFrame:
    """feature, value, block, n."""
    texts = rows.select(block.cast("int").alias("__block"), *[F.col(c).cast("string").alias(c) for c in categorical])
    long = texts.unpivot(["__block"], categorical, "feature", "value").where("value IS NOT NULL AND __block IS NOT NULL")
    counts = long.groupBy("feature", "value", F.col("__block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts, "category-counts")


def _store_modes(counts: DataFrame, uptos: list[int]) -> dict[int, str | None]:
    """The store with most rows, per prefix; of equals, the smallest."""
    upto = [F.sum(F.when(F.col("block") <= u, F.col("n")).otherwise(0)).alias(f"n{u}") for u in uptos]
    each = counts.where(F.col("feature") == WIDE).groupBy("value").agg(*upto)
    order = lambda u: F.struct(-F.col(f"n{u}"), F.col("value").try_cast("double"), F.col("value"))
    row = each.agg(F.lit(0), *[F.min_by("value", order(u)).alias(f"m{u}") for u in uptos]).first()
    return {u: row[f"m{u}"] for u in uptos}


def _as_number(text: str) -> tuple[bool, float]:
    try:
        return True, float(text)
    except ValueError:
        return False, 0.0


def learn(rows: DataFrame, lessons: list[Lesson], block: Column | None = None) -> dict[str, Preprocessor]:
    """What every lesson learns from ``rows``, whose ``block`` is a whole number from 0 (by default all are 0).

    The rows are read four times (sketches, quantiles, categories, sums), however many lessons there are:
    each pass keeps its findings per block, and a lesson adds up those of its own blocks. Fill values,
    levels of short categories and one matrix per block reach the driver; what grows with the stores stays
    a table.
    """
    block = F.lit(0) if block is None else block
    numeric = list(dict.fromkeys(c for lesson in lessons for c in lesson.numeric))
    categorical = list(dict.fromkeys(c for lesson in lessons for c in lesson.categorical))
    uptos = sorted({lesson.upto for lesson in lessons})
    found = prefix_quantiles(rows, numeric, [0.5], block, uptos) if numeric else {}
    medians = {u: {c: found[u, c, 0.5] for c in numeric if (u, c, 0.5) in found} for u in uptos}
    tallies: dict[str, list] = {c: [] for c in categorical}
    wide_modes: dict[int, str | None] = {}
    if categorical:
        counts = _category_counts(rows, categorical, block)
        for r in counts.where(F.col("feature") != WIDE).collect():  # short categories
            tallies[r["feature"]].append((r["value"], r["block"], r["n"]))
        wide_modes = _store_modes(counts, uptos) if WIDE in categorical else {}
    short = [c for c in categorical if c != WIDE]
    levels, modes = {}, {}
    for u in uptos:
        modes[u] = {WIDE: wide_modes[u]} if wide_modes.get(u) is not None else {}
        for c in short:
            totals: dict[str, int] = {}
            for value, b, n in tallies[c]:
                if b <= u:
                    totals[value] = totals.get(value, 0) + n
            levels[u, c] = sorted(totals, key=str.encode)
            if totals:
                modes[u][c] = min(totals, key=lambda v: (-totals[v], *_as_number(v), v))
    every = tuple((c, tuple(sorted({v for v, _, _ in tallies[c]}, key=str.encode))) for c in short)
    layout = Layout(tuple(numeric), tuple(medians[uptos[-1]].get(c, 0.0) for c in numeric), every)
    store = F.coalesce(F.col(WIDE).cast("string"), F.lit(wide_modes[uptos[-1]])) if wide_modes else F.lit("")
    moments = collect_moments(rows, layout, block, F.coalesce(store, F.lit("")), F.col(TARGET), uptos)
    cases = []
    for lesson in lessons:
        own = [c for c in lesson.categorical if c != WIDE]
        u = lesson.upto
        known = Case(lesson.name, u, lesson.numeric, {c: levels[u, c] for c in own}, medians[u], modes[u], WIDE in lesson.categorical)
        cases.append((known, *solve(moments, known)))
    by_store = [(c, w) for c, _, w in cases if c.by_store]
    table = store_table(moments, by_store) if by_store else None
    out = {}
    for (case, line, _), lesson in zip(cases, lessons):
        total = moments.total(case.upto)
        stores = table.where(F.col("case") == case.name).drop("case") if case.by_store else None
        kept = {c: modes[case.upto][c] for c in lesson.categorical if c in modes[case.upto]}
        fills = {c: medians[case.upto][c] for c in lesson.numeric if c in medians[case.upto]}
        mean = float(total[0, -1] / max(1.0, total[0, 0]))
        out[lesson.name] = Preprocessor(list(lesson.numeric), list(lesson.categorical), fills, kept, case.levels, mean, line, stores)
    return out


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor:
    """What the training rows alone teach."""
    return learn(train, [Lesson("all", tuple(numeric), tuple(categorical))])["all"]


# --- training and scoring -----------------------------------------------------------------------


def merged_rows(rows: DataFrame, numeric: list[str], categorical: list[str], *by: Column) -> DataFrame:
    """Training rows alike in all features as one row with their mean target and their number.

    Least squares trees see rows through sums only, so they split the merged rows as they split the rows.
    """
    inputs = list(dict.fromkeys([*numeric, *categorical]))
    target = F.col(TARGET).cast("double")
    grouped = rows.where(target.isNotNull()).groupBy(*by, *[F.col(c) for c in inputs])
    return grouped.agg(F.avg(target).alias(TARGET), F.count(F.lit(1)).cast("double").alias(WEIGHT))


def _merged_features(assembled: DataFrame) -> DataFrame:
    """As ``merged_rows``, of assembled rows."""
    if WEIGHT in assembled.columns:
        return assembled.select("label", "features", WEIGHT)
    return assembled.groupBy("features").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias(WEIGHT))


def _weighted(estimator, rows: DataFrame):
    """The estimator for merged rows; a leaf's least number of rows becomes a share of their weights."""
    least = estimator.getMinInstancesPerNode()
    total = rows.agg(F.sum(WEIGHT)).first()[0] or 0.0
    estimator = estimator.setWeightCol(WEIGHT).setMinInstancesPerNode(1)
    if total < 2 * least:
        return estimator.setMaxDepth(0)
    # Half a row less, so that rounding does not decide.
    return estimator.setMinWeightFractionPerNode((least - 0.5) / total) if least > 1 else estimator


def train_models(
    assembled: DataFrame, sizes: Sizes = Sizes(), prepared: Preprocessor | None = None, keep_rows: bool = True
) -> dict[str, Model | Line]:
    """The named models: least squares as ``prepared`` has it, and each tree model fitted on the assembled rows.

    The rows are written once for all tree fits, and deleted after them unless ``keep_rows``; for models that draw no
    rows, equal ones are merged. Node ids of deep trees are kept with the rows and checkpointed on the shared folder,
    so that long fits neither send their trees to every task nor grow without end.
    """
    models: dict[str, Model | Line] = {}
    if LINEAR in sizes.models:
        if prepared is None:
            raise ValueError("least squares comes with the preprocessor")
        models[LINEAR] = prepared.line
    trees = estimators(sizes)
    if trees:
        checkpoint_here(assembled.sparkSession)
    known = assembled.where(F.col("label").isNotNull())
    drawn = {n: e for n, e in trees.items() if _draws_rows(n, sizes)}
    written = []
    if drawn:
        stored = materialize(known.select("label", "features"), "assembled-rows", ROWS_PER_FILE)
        written.append(stored)
        models |= {name: estimator.fit(stored) for name, estimator in drawn.items()}
    if len(drawn) < len(trees):
        merged = materialize(_merged_features(known), "merged-rows", ROWS_PER_FILE)
        written.append(merged)
        models |= {n: _weighted(e, merged).fit(merged) for n, e in trees.items() if n not in drawn}
    for frame in [] if keep_rows else written:
        discard(frame)  # what was fitted is on the driver
    return {n: models[n] for n in dict.fromkeys([LINEAR, *trees]) if n in models}


def score(models: dict[str, Model | Line], test: DataFrame) -> DataFrame:
    """Long forecasts (key, actual, model, predicted) of assembled rows.

    The models are applied one after the other in one pass over the test rows.
    """
    out = test
    columns = {}
    for i, (name, model) in enumerate(models.items()):
        if name == LINEAR:
            columns["linear"] = name
        else:
            columns[f"p{i}"] = name
            out = model.setPredictionCol(f"p{i}").transform(out)
    options = [F.struct(F.lit(n).alias("model"), F.col(c).alias("predicted")) for c, n in columns.items()]
    keep = [c for c in [*SALES_KEY, TARGET] if c in test.columns]
    return out.select(*keep, F.explode(F.array(*options)).alias("s")).select(
        *keep, "s.model", "s.predicted"
    )


def _fit_and_score(prepared: Preprocessor, train: DataFrame, test: DataFrame, sizes: Sizes) -> DataFrame:
    if _merges_rows(sizes) and WEIGHT not in train.columns:
        train = merged_rows(train, prepared.numeric, prepared.categorical)
    # Further scenarios and folds write rows of their own.
    models = train_models(prepared.transform(train), sizes, prepared, keep_rows=False)
    return score(models, prepared.transform(test))


def fit_and_score(
    train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], sizes: Sizes = Sizes()
) -> DataFrame:
    return _fit_and_score(fit_preprocessor(train, numeric, categorical), train, test, sizes)


def fit_forecaster(rows: DataFrame, coming: DataFrame, numeric: list[str], categorical: list[str], sizes: Sizes = Sizes()) -> tuple[Preprocessor, dict[str, Model | Line]]:
    """Models for rows whose sales are still ahead, learnt from all ``rows``.

    Features that ``coming`` lacks are left out of the fit as well.
    """
    known = [[c for c in names if c in coming.columns] for names in (numeric, categorical)]
    prepared = fit_preprocessor(rows, *known)
    return prepared, train_models(prepared.transform(rows), sizes, prepared)


def forecast_rows(
    rows: DataFrame, coming: DataFrame, numeric: list[str], categorical: list[str], sizes: Sizes = Sizes()
) -> DataFrame:
    """(key, model, predicted) for rows whose sales are still ahead."""
    prepared, models = fit_forecaster(rows, coming, numeric, categorical, sizes)
    return score(models, prepared.transform(coming)).drop(TARGET)


def save_forecaster(prepared: Preprocessor, models: dict[str, Model | Line], path: str) -> None:
    """Write what was learnt: one row of settings, the table of stores, the fitted trees."""
    spark = SparkSession.active()
    kept = {k: getattr(prepared, k) for k in ("numeric", "categorical", "medians", "modes", "levels", "overall")}
    row = [(json.dumps(kept | {"line": prepared.line.__dict__, "models": list(models)}),)]
    spark.createDataFrame(row, "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
    if prepared.stores is not None:
        prepared.stores.write.mode("overwrite").parquet(f"{path}/stores")
    for i, (name, model) in enumerate(models.items()):
        if name != LINEAR:
            model.write().overwrite().save(f"{path}/model-{i}")


def load_forecaster(spark: SparkSession, path: str) -> tuple[Preprocessor, dict[str, Model | Line]]:
    kept = json.loads(spark.read.text(f"{path}/settings").first()[0])
    names, line = kept.pop("models"), Line(**kept.pop("line"))
    kinds = {FOREST: RandomForestRegressionModel, BOOSTED: GBTRegressionModel}
    stores = spark.read.parquet(f"{path}/stores") if WIDE in kept["categorical"] else None
    models = {n: line if n == LINEAR else kinds[n].load(f"{path}/model-{i}") for i, n in enumerate(names)}
    return Preprocessor(**kept, line=line, stores=stores), models


def feature_importance(model: Model, assembled: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, importance) of a tree model, highest first; one row per model input."""
    attributes = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    # As long as the model has inputs; the model itself holds these numbers on the driver.
    weights = model.featureImportances.toArray()
    rows = [(names[i].replace("hot__", "cat__"), float(w)) for i, w in enumerate(weights)]
    spark = SparkSession.active()
    table = spark.createDataFrame(rows, "feature string, importance double")
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


# --- scenarios and folds ------------------------------------------------------------------------


def model_rows(featured: DataFrame, inputs: list[str] | None = None) -> DataFrame:
    """The rows with complete history features, written once for all fits that read them; with all features, or
    with those named in ``inputs``."""
    wanted = [*SALES_KEY, TARGET, *([*ft.NUMERIC_FEATURES, *ft.CATEGORICAL_FEATURES] if inputs is None else inputs)]
    columns = [c for c in dict.fromkeys(wanted) if c in featured.columns]
    return materialize_alone(ft.drop_incomplete(featured).select(*columns), "model-rows")


def _fit_all(fit: Callable, cases: list, at_once: int) -> DataFrame:
    """Rows of ``fit`` for every case. Each fit is a series of Spark jobs; on a cluster that one of
    them cannot fill, some may run side by side."""
    with ThreadPool(max(1, min(at_once, len(cases)))) as pool:
        parts = pool.map(inheritable_thread_target(SparkSession.active())(fit), cases)
    return reduce(DataFrame.unionByName, parts)


def scenario_grid(
    train: DataFrame,
    test: DataFrame,
    sizes: Sizes = Sizes(),
    scenarios: tuple[str, ...] = (ft.FULL, ft.OPERATIONAL),
    at_once: int = 1,
) -> DataFrame:
    """Long forecasts of every model in every scenario, with the scenario's feature count."""

    lessons = [Lesson(s, *map(tuple, ft.scenario_features(s, train.columns))) for s in scenarios]
    prepared = learn(train, lessons)

    def fit(lesson: Lesson) -> DataFrame:
        scored = _fit_and_score(prepared[lesson.name], train, test, sizes)
        count = F.lit(len(lesson.numeric) + len(lesson.categorical)).cast("long")
        return scored.withColumns({"scenario": F.lit(lesson.name), "feature_count": count})

    return _fit_all(fit, lessons, at_once)


def scenario_comparison(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series-level and company-level measures per scenario and model, best first."""
    keys = ["scenario", "model", "feature_count"]
    order = ["scenario", F.asc_nulls_last("wape"), "model"]
    granular = evaluate(scored, TARGET, SERIES_LEVEL, keys)
    company = summed_evaluation(scored, TARGET, keys)
    return granular.orderBy(*order), company.orderBy(*order)


def model_comparison(scored: DataFrame) -> DataFrame:
    return series_evaluation(scored, TARGET).orderBy(F.asc_nulls_last("mape"), "model")


def backtest_scores(
    rows: DataFrame,
    folds: list[Fold],
    numeric: list[str],
    categorical: list[str],
    sizes: Sizes = Sizes(),
    at_once: int = 1,
) -> DataFrame:
    """Test-row forecasts of every fold and model; each fold learns from the weeks before it.

    A row's block is the number of folds whose tests have begun, so the first n blocks are what fold n
    learns from: one preparation serves all folds, and only tree models are fitted fold by fold. Where these draw
    no rows, equal rows of a block are merged in one pass, and the folds learn from the merged ones.
    """
    ordered = sorted(folds, key=lambda f: f.test_start)
    begun = [(F.col("date") >= F.lit(f.test_start)).cast("int") for f in ordered]
    block = reduce(Column.__add__, begun)
    lessons = {f.number: Lesson(str(f.number), tuple(numeric), tuple(categorical), i) for i, f in enumerate(ordered)}
    prepared = learn(rows, list(lessons.values()), block)
    merged = None
    if _merges_rows(sizes):
        merged = materialize(merged_rows(rows, numeric, categorical, block.alias("__block")), "merged-rows")

    def fit(fold: Fold) -> DataFrame:
        train, test = fold_split(rows, fold)
        if merged is not None:
            train = merged.where(F.col("__block") <= lessons[fold.number].upto)
        scored = _fit_and_score(prepared[str(fold.number)], train, test, sizes).withColumn("fold", F.lit(fold.number))
        # Forecasts of drawn trees are written fold by fold, so that the driver holds no trees of folds that are done.
        return scored if merged is not None or not estimators(sizes) else materialize(scored, "fold-forecasts")

    return _fit_all(fit, folds, at_once)
