"""Reading, checking and writing tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailcast.functions.columns import nan_to_null, normalise_columns


def _format_of(path: str) -> str:
    return "parquet" if path.rstrip("/").lower().endswith(".parquet") else "csv"


def _typed(df: DataFrame, schema: T.StructType, on_bad: str) -> DataFrame:
    """Declared columns by name, in declared order and type; further columns are kept as read."""
    require_columns(df, schema.names)
    columns = []
    for field in schema.fields:
        source = F.col(field.name)
        if df.schema[field.name].dataType == T.StringType():
            source = F.nullif(F.trim(source), F.lit(""))
        convert = source.try_cast if on_bad == "null" else source.cast
        columns.append(convert(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in schema.names]
    return nan_to_null(df.select(columns + extra))


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str | None = None,
    on_bad: str = "fail",
) -> DataFrame:
    """Read one table and normalise its column names.

    With a schema, columns are matched by name (a CSV header may list them in any order) and
    cast; a value that does not fit stops the job, or becomes NULL with ``on_bad="null"``.
    Without a schema a CSV gets inferred types, which costs one more pass over the file.
    """
    fmt = fmt or _format_of(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    df = normalise_columns(reader.load(path))
    return nan_to_null(df) if schema is None else _typed(df, schema, on_bad)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(target))


def missing_inputs(spark: SparkSession, paths: Mapping[str, str]) -> list[str]:
    return [name for name, path in paths.items() if not path_exists(spark, path)]


def require_inputs(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Fail once, naming every missing input."""
    missing = [f"{name}: {paths[name]}" for name in missing_inputs(spark, paths)]
    if missing:
        raise FileNotFoundError("required inputs are missing:\n" + "\n".join(missing))


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"required columns are missing: {missing}")


def optional_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there yet."""
    return read_table(spark, path, schema) if path_exists(spark, path) else None


def stack_tables(*tables: DataFrame | None) -> DataFrame:
    """All rows of the given tables, by column name; absent tables and columns are left out."""
    present = [t for t in tables if t is not None]
    if not present:
        raise ValueError("no table to stack")
    out = present[0]
    for table in present[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def write_table(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None
) -> str:
    """Overwrite ``path`` with ``df``, in parallel, one file per task."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
