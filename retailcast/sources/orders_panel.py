"""The three retail tables derived from order lines.

A store is a supplier, a department is a part type, and a week is labelled by its Saturday. Money
is held in whole cents so that sums are exact. Nulls and holidays are planned by fixed rules of
the store number and the week number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Department numbers, holiday weeks (ISO) and their names.
DEPARTMENTS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
HOLIDAYS = {1: "New Year", 27: "Independence Day", 36: "Labor Day", 47: "Black Friday", 52: "Christmas"}

# Order lines per part of the panel.
LINES_PER_PART = 100_000

# A Monday; weeks are counted from it.
_MONDAY = "1970-01-05"


# Schemas of files read before, so that reading one again opens no footer on the driver.
_SCHEMAS: dict[str, T.StructType] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _week_number(day: Column) -> Column:
    return F.floor(F.date_diff(day.cast("date"), F.lit(_MONDAY).cast("date")) / F.lit(7)).cast("int")


def _saturday(week: Column) -> Column:
    return F.date_add(F.lit(_MONDAY).cast("date"), week * 7 + 5)


def _holiday_flag(date: Column) -> Column:
    return F.weekofyear(date).isin(*HOLIDAYS).cast("int")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("store_id"),
        "l_partkey",
        "l_orderkey",
        _week_number(F.col("l_shipdate")).alias("week"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("discount_pct"),
    )


def calendar(spark: SparkSession, folder: str) -> Column:
    """First and last week of the order lines, as one scalar struct."""
    days = _table(spark, folder, "lineitem").agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")
    )
    return days.select(
        F.struct(
            _week_number(F.col("first")).alias("first"), _week_number(F.col("last")).alias("last")
        ).alias("weeks")
    ).scalar()


def partitions(spark: SparkSession, folder: str) -> int:
    """How many parts the panel is shuffled into: as many more as there are more order lines.

    Filling weeks makes a small shuffle large, so its size says little about what a task then holds.
    """
    lines = _table(spark, folder, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-lines // LINES_PER_PART))


def densify(cells: DataFrame, key: list[str], weeks: Column, parts: int | None = None) -> DataFrame:
    """Every week of the calendar for every key seen, in so many ``parts`` if given.

    Each row fills the gap up to the next row of its key (the first one also the gap before it),
    so missing weeks need neither a join with the calendar nor the cross product of keys and
    weeks, and the rows stay partitioned by key. Filled rows have NULL values.
    """
    order = Window.partitionBy(*key).orderBy("week")
    if parts is not None:
        cells = cells.repartition(parts, *key)
    values = [c for c in cells.columns if c not in [*key, "week"]]
    spans = (
        cells.withColumn("calendar", weeks)
        .withColumn("starts", F.row_number().over(order) == 1)
        .withColumn("next", F.lead("week").over(order))
    )
    filled = spans.withColumn(
        "at",
        F.explode(
            F.sequence(
                F.when(F.col("starts"), F.col("calendar.first")).otherwise(F.col("week")),
                F.coalesce(F.col("next") - 1, F.col("calendar.last")),
            )
        ),
    )
    own = F.col("at") == F.col("week")
    return filled.select(
        *key,
        F.col("at").alias("week"),
        (F.col("at") - F.col("calendar.first")).alias("w"),
        *[F.when(own, F.col(v)).alias(v) for v in values],
    )


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    number = F.create_map(*[F.lit(x) for item in DEPARTMENTS.items() for x in item])
    parts = _table(spark, folder, "part").select(
        "p_partkey", number[F.col("p_type")].alias("department")
    )
    cells = (
        _lines(spark, folder)
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("store_id", "department", "week")
        .agg(F.sum("cents").alias("cents"))
    )
    dense = densify(cells, ["store_id", "department"], calendar(spark, folder), partitions(spark, folder))
    date = _saturday(F.col("week"))
    return dense.select(
        "store_id",
        "department",
        date.alias("date"),
        F.coalesce("cents", F.lit(0).cast("long")).alias("weekly_sales"),
        _holiday_flag(date).alias("is_holiday"),
        "w",
    )


def _features(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    amount = F.col("cents") * F.col("discount_pct")
    cells = (
        _lines(spark, folder)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("store_id", "week")
        .agg(
            *[
                F.sum(F.when(F.substring("o_orderpriority", 1, 1) == str(i), amount)).alias(f"p{i}")
                for i in range(1, 6)
            ]
        )
    )
    dense = densify(cells, ["store_id"], calendar(spark, folder), partitions(spark, folder))
    store, w = F.col("store_id"), F.col("w")
    date = _saturday(F.col("week"))
    names = F.create_map(*[F.lit(x) for item in HOLIDAYS.items() for x in item])
    month = F.month(date)
    season = (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )
    return dense.select(
        "store_id",
        date.alias("date"),
        F.when((store + w) % 11 != 0, ((store * 7 + w * 3) % 40).cast("double")).alias("temperature"),
        (2 + ((store + w) % 50).cast("double") / F.lit(100.0)).alias("fuel_price"),
        F.when(store != 3, (200 + w % 26).cast("double")).alias("cpi"),
        F.when(w % 13 != 0, 4 + (store % 7).cast("double") / F.lit(2.0)).alias("unemployment"),
        *[(F.col(f"p{i}").cast("double") / F.lit(10000.0)).alias(f"markdown_{i}") for i in range(1, 6)],
        _holiday_flag(date).alias("is_holiday"),
        names[F.weekofyear(date)].alias("holiday_name"),
        F.when(w != 5, season).alias("season"),
        "w",
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return _sales(spark, folder).drop("w")


def features(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).drop("w")


def stores(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation").join(
        F.broadcast(_table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    kinds = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    store = F.col("s_suppkey")
    return (
        _table(spark, folder, "supplier")
        # 25 nations and 5 regions at every scale
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            store.alias("store_id"),
            F.when(store != 7, F.element_at(kinds, (store % 3 + 1).cast("int"))).alias("store_type"),
            F.when(
                store % 10 != 4, F.round(F.col("s_acctbal") * 100).cast("long").cast("double") / F.lit(100.0)
            ).alias("store_size"),
            F.col("r_name").alias("region"),
        )
    )


def faulty_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Planted faults: store 1 doubled in week 0, store 4 negated in week 20, no target for store 6
    in week 30, a differing holiday flag in one department of store 8 in week 15."""
    at = lambda s, w: (F.col("store_id") == s) & (F.col("w") == w)
    return (
        _sales(spark, folder)
        .withColumn("copies", F.when(at(1, 0), 2).otherwise(1))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "store_id",
            "department",
            "date",
            F.when(at(4, 20), -F.col("weekly_sales"))
            .when(~at(6, 30), F.col("weekly_sales"))
            .alias("weekly_sales"),
            F.when(at(8, 15) & (F.col("department") == 2), 1 - F.col("is_holiday"))
            .otherwise(F.col("is_holiday"))
            .alias("is_holiday"),
        )
    )


def faulty_features(spark: SparkSession, folder: str) -> DataFrame:
    """Planted faults: store 2 lacks week 3, and store 5 has the other holiday flag in week 10."""
    at = lambda s, w: (F.col("store_id") == s) & (F.col("w") == w)
    return (
        _features(spark, folder)
        .where(~at(2, 3))
        .withColumn(
            "is_holiday",
            F.when(at(5, 10), 1 - F.col("is_holiday")).otherwise(F.col("is_holiday")),
        )
        .drop("w")
    )


def faulty_stores(spark: SparkSession, folder: str) -> DataFrame:
    """Planted fault: store 9 is missing."""
    return stores(spark, folder).where(F.col("store_id") != 9)
