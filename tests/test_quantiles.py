"""Exact quantiles against numpy, with hot values and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailcast.functions import quantiles as module
from retailcast.functions.quantiles import exact_median, exact_quantiles, prefix_quantiles


def quantiles(df, columns, probabilities):
    rows = exact_quantiles(df, columns, probabilities).collect()
    return {(r["column"], r["probability"]): r["value"] for r in rows}


def test_equal_numpy_on_many_rows(spark):
    df = spark.range(0, 200_001, numPartitions=7).select(
        # A third of all values are one value.
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(5) * 100).alias("x"),
        F.when(F.col("id") % 5 != 0, (F.xxhash64("id") % 1000).cast("double")).alias("y"),
    )
    df = df.cache()
    probabilities = [0.0, 0.25, 0.3, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, ["x", "y"], probabilities)
    data = df.toPandas()
    for c in ("x", "y"):
        for p in probabilities:
            assert got[c, p] == pytest.approx(np.nanquantile(data[c].dropna(), p), abs=1e-9)
    df.unpersist()


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [1.0, 1.5, 2.0, 4.0], [None, 5.0, 5.0, None]])
def test_few_rows(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None]
    got = quantiles(df, ["x"], [0.25, 0.5])
    assert got["x", 0.5] == pytest.approx(np.quantile(known, 0.5))
    assert got["x", 0.25] == pytest.approx(np.quantile(known, 0.25))


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1)], "x double, k int")
    assert df.select(exact_median(df, "x").alias("m")).first()["m"] is None


def test_prefixes_of_blocks_in_one_go(spark):
    # Blocks lie in different ranges, and half of all values of a block may be one value.
    rng = np.random.default_rng(7)
    rows = [(b, float(v), None if i % 9 == 0 else float(b)) for b in range(4) for i, v in enumerate(np.r_[rng.normal(b * 3, 1, 4000), np.full(3000, b * 1.0)])]
    df = spark.createDataFrame([*rows, (None, 1e9, 1e9)], "b int, x double, y double").repartition(5)
    got = prefix_quantiles(df, ["x", "y"], [0.1, 0.5, 0.99], F.col("b"), [0, 2, 3])
    for upto in (0, 2, 3):
        x = [r[1] for r in rows if r[0] <= upto]
        y = [r[2] for r in rows if r[0] <= upto and r[2] is not None]
        for p in (0.1, 0.5, 0.99):
            assert got[upto, "x", p] == pytest.approx(np.quantile(x, p), abs=1e-12)
            assert got[upto, "y", p] == pytest.approx(np.quantile(y, p), abs=1e-12)


def test_a_rank_outside_its_bracket_is_sought_again(spark, monkeypatch):
    sketched = module._bracket

    def wrong(sketches, column, upto, probability):
        cell = sketched(sketches, column, upto, probability)
        return module.replace(cell, low=cell.high + 1, high=cell.high + 2)

    monkeypatch.setattr(module, "_bracket", wrong)
    df = spark.range(5000).select(F.sqrt("id").alias("x"))
    got = prefix_quantiles(df, ["x"], [0.25, 0.75])
    want = np.quantile(np.sqrt(np.arange(5000)), [0.25, 0.75])
    assert [got[0, "x", p] for p in (0.25, 0.75)] == pytest.approx(list(want), abs=1e-12)


def test_no_step_holds_more_as_the_table_grows(spark, monkeypatch):
    """Ten times the rows: what reaches the driver at the end stays as small."""
    held = []
    picked = module._picked

    def watched(values, cells):
        held.append(max((values.where((F.col("value") >= c.low) & (F.col("value") <= c.high)).count() for c in cells), default=0))
        return picked(values, cells)

    monkeypatch.setattr(module, "_picked", watched)
    for size in (20_000, 200_000):
        df = spark.range(size, numPartitions=4).select(F.rand(3).alias("x"))
        value = prefix_quantiles(df, ["x"], [0.5], few=16, split=32)[0, "x", 0.5]
        assert value == pytest.approx(np.median([r["x"] for r in df.collect()]), abs=1e-15)
    assert max(held) <= 16


def test_signs_zero_and_wide_ranges(spark):
    values = [-1e300, -5.0, -0.0, 0.0, 1e-300, 1e-9, 3.0, 1e300] * 40 + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = prefix_quantiles(df, ["x"], [0.0, 0.2, 0.5, 0.7, 1.0], few=2, split=3)
    for p in (0.0, 0.2, 0.5, 0.7, 1.0):
        assert got[0, "x", p] == np.quantile(values[:-1], p)
