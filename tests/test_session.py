"""The shared folder and what is written to it."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from retailcast.session import clear_scratch, discard, materialize, materialize_alone, scratch_path, shared_dir


class Context:
    """Stands for a cluster session without a shared folder."""

    master = "yarn"

    def getConf(self):  # noqa: N802
        return {}


class Session:
    sparkContext = Context()


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_shared_folder_follows_the_setting(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_materialized_frames_prune_and_push_down(spark):
    df = materialize(spark.range(10).selectExpr("id", "id * 2 AS twice", "id * 3 AS thrice"), "numbers")
    picked = df.where("id > 7").select("twice")
    assert sorted(r[0] for r in picked.collect()) == [16, 18]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "thrice" not in plan and "GreaterThan(id,7)" in plan


def test_scratch_is_cleared(spark):
    df = materialize(spark.range(3), "gone")
    path = Path(df.inputFiles()[0].removeprefix("file://"))
    assert path.exists()
    clear_scratch(spark)
    assert not path.exists()


def test_discard_takes_one_frame_of_this_application(spark, tmp_path):
    gone, kept = materialize(spark.range(3), "gone"), materialize(spark.range(4), "kept")
    spark.range(5).write.parquet(f"{tmp_path}/other rows")
    other = spark.read.parquet(f"{tmp_path}/other rows")
    path = Path(gone.inputFiles()[0].removeprefix("file://"))
    discard(gone)
    discard(other)
    assert not path.exists()
    assert (kept.count(), other.count()) == (4, 5)


def test_shuffle_files_go_with_the_write(spark):
    """A table that is written alone leaves its rows and no shuffle files; the session's setting stays."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk, setting = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(name)
    files = lambda: {f for f in disk.getAllFiles().mkString(" ").split(" ") if "/shuffle_" in f}
    left = []
    for write in (materialize, materialize_alone):
        before = files()
        rows = write(spark.range(100).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        left.append(len(files() - before))
        assert rows.count() == 7
    assert left[0] > 0 and left[1] == 0
    assert spark.conf.get(name) == setting
