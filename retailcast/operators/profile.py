"""Profiling of any table: shape, nulls, duplicates, dates, keys and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.functions.columns import find_column
from retailcast.functions.quantiles import exact_quantiles
from retailcast.session import materialize


def shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")
    )


def column_types(df: DataFrame) -> list[tuple[int, str, str]]:
    """Position, name and type of each column; read from the schema, no job is run."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]


def first_rows(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows in the given order (a distributed table has no order of its own)."""
    return df.orderBy(*order_by).limit(n)


def null_profile(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, most first, counted in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counted.unpivot("n", df.columns, "column_name", "n_null")
        .where("n_null > 0")
        .select(
            "column_name",
            "n_null",
            (F.col("n_null") / F.col("n").cast("double") * 100).alias("pct_null"),
        )
        .orderBy(F.desc("n_null"), "column_name")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in every column.

    Equal rows have equal digests, so whole rows are compared only where a digest repeats; all others
    are told apart by eight bytes each.
    """
    digest = "_" * (1 + max((len(c) for c in df.columns), default=0))  # longer than any column's name
    marked = df.withColumn(digest, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    repeated = marked.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(digest)
    alike = marked.join(repeated, digest, "left_semi").drop(digest)
    copies = alike.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate_rows"))


def date_range(df: DataFrame, column: str = "date") -> DataFrame:
    """Earliest and latest date, and how many values are no date (missing ones included)."""
    name = find_column(df, column)
    if name is None:
        raise ValueError(f"no column named {column}")
    day = F.col(name).try_cast("date")
    return df.agg(
        F.min(day).alias("earliest"),
        F.max(day).alias("latest"),
        F.count_if(day.isNull()).alias("n_invalid"),
    )


def key_counts(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))


def key_stats(df: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys, and all rows (first ones included) that share their key with another row."""
    n = F.col("n_rows")
    return key_counts(df, key).agg(
        F.count(F.lit(1)).alias("n_unique_keys"),
        F.coalesce(F.sum(F.when(n > 1, n).otherwise(0)), F.lit(0)).alias("n_rows_in_duplicates"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum; one row per statistic."""
    # Moments and quartiles are several passes over one column; what it comes from is read once.
    df = materialize(df.select(F.col(column).cast("double").alias("value")), "distribution")
    value, column = F.col("value"), "value"
    names = ["count", "mean", "std", "min", "max"]
    moments = df.agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).unpivot([], names, "statistic", "value")
    quartiles = exact_quantiles(df, [column], [0.25, 0.5, 0.75]).select(
        F.concat((F.col("probability") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
        "value",
    )
    return moments.unionByName(quartiles)


def value_counts(df: DataFrame, column: str, by: str = "frequency", top: int | None = None) -> DataFrame:
    """Rows per value, NULL being a value of its own; ordered by frequency or by the value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    order = [F.asc_nulls_last("value")]
    if by == "frequency":
        order.insert(0, F.desc("n_rows"))
    ordered = counts.orderBy(*order)
    return ordered if top is None else ordered.limit(top)


def numeric_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum and mean of the listed columns that exist, one row each, in one pass."""
    present = [c for c in columns if c in df.columns]
    one_row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
                F.avg(F.col(c).cast("double")).alias("mean"),
            ).alias(c)
            for c in present
        ]
    )
    return one_row.select(F.explode(F.array(*present)).alias("s")).select("s.*")
