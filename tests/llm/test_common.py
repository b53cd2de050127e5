from helpers import plain
from pyspark.sql import functions as F

from retailcast.llm.common import join_by_group, maybe_among


def test_filter_lets_all_wanted_pass(spark):
    rows = spark.range(200_000).select((F.col("id") * 7 - 50_000).alias("k"), F.lit(1).alias("__bits"), F.lit("x").alias("a.b"))
    wanted = rows.where("k % 100 = 0").select("k")
    for bitmaps in (1, 8_192):
        found = maybe_among(rows, "k", wanted, bitmaps)
        assert found.columns == rows.columns
        assert found.join(wanted, "k", "left_semi").count() == wanted.count()
    assert found.count() < wanted.count() + 200_000 * 0.06
    assert maybe_among(rows, "k", wanted.where("false")).count() == 0
    assert maybe_among(rows.where("false"), "k", wanted).count() == 0


def test_nulls_pass_only_by_chance(spark):
    rows = spark.createDataFrame([(None,), (3,), (3,), (4,)], "k long")
    found = [r.k for r in maybe_among(rows, "k", rows.where("k = 3")).collect()]
    assert found.count(3) == 2


def test_hot_groups_join_like_any_other(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") < 2_000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    assert plain(join_by_group(rows, groups, "k", "size", 5_000)) == plain(rows.join(groups, "k"))
