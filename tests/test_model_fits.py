"""Every model query makes its own fits."""

import pytest

from retailcast.operators import features, models
from retailcast.queries import modelling


@pytest.mark.parametrize(
    "query, names",
    [(modelling.l3_random_forest, (models.FOREST,)), (modelling.l4_boosted_trees, (models.BOOSTED,)), (modelling.l6_prediction_table, modelling.SIZES.models)],
)
def test_each_call_fits_what_it_compares(spark, monkeypatch, query, names):
    fits = []

    def grid(train, test, sizes, scenarios=(features.FULL, features.OPERATIONAL), at_once=1):
        fits.append((sizes.models, scenarios))
        value = float(len(fits))
        rows = [(1, 1, m, s, 2, value, 3.0) for m in sizes.models for s in scenarios]
        table = spark.createDataFrame(rows, "store_id int, department int, model string, scenario string, feature_count long, predicted double, weekly_sales double")
        return table.selectExpr("*", "DATE '2001-06-02' AS date")

    monkeypatch.setattr(modelling, "split", lambda *_: (None, None))
    monkeypatch.setattr(modelling.models, "scenario_grid", grid)
    first, second = [query(spark, "folder of " + query.__name__).collect() for _ in range(2)]
    assert fits == [(names, (features.OPERATIONAL,))] * 2
    assert first != second
