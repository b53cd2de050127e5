"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "retailcast",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution on; master and partition count are left to the cluster
    unless given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # All executor work happens in the driver's JVM, whose default heap is one gigabyte.
        builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local path
    would be lost with its machine, so an unset folder is an error there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    # An application's scratch folder, kept in the session so that one application uses one.
    folder = spark.conf.get("retailcast.local.scratch", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="retailcast-")
        spark.conf.set("retailcast.local.scratch", folder)
    return folder


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/retailcast/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_application_dir(spark)}/{uuid.uuid4().hex}/{label}"


def checkpoint_here(spark: SparkSession) -> None:
    """Let long iterations checkpoint in the shared folder; a folder that is already set stays."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{_application_dir(spark)}/checkpoints")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; frames read from it end here."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once and read it back: later stages start from files that outlive executors,
    and each of them still prunes columns and pushes filters into the scan. Files hold at most
    ``rows_per_file`` rows, if given."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_alone(df: DataFrame, label: str) -> DataFrame:
    """As ``materialize``, and the shuffle files of the write go with it, so that later steps do not find the disk
    holding both. Not for writes side by side, as a setting of the session is changed meanwhile."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete the files that ``materialize`` wrote for ``df``, which ends with them; files that this application did
    not write stay."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if f"/retailcast/{spark.sparkContext.applicationId}/" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
