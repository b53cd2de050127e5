"""Relationship and integrity checks.

Checks return DataFrames; those that must stop a job have a ``require_`` form that raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.functions.columns import SUMMER_MONTHS, differs
from retailcast.operators.profile import key_counts, key_stats, null_profile
from retailcast.schema import FEATURES_KEY, SALES_KEY, SERIES_KEY, STORES_KEY
from retailcast.session import materialize

# Texts that stand for "no holiday".
HOLIDAY_PLACEHOLDERS = ["Non-Holiday", "No Holiday", "None", "", "nan"]


# --- keys ---------------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return key_counts(df, key).where("n_rows > 1")


def require_unique_key(df: DataFrame, key: list[str], name: str) -> None:
    """Stop on repeated keys, showing up to ten of them; rows are never dropped."""
    bad = duplicate_keys(df, key)
    sample = bad.orderBy(*key).limit(10).collect()
    if sample:
        n = bad.agg(F.sum("n_rows")).first()[0]
        shown = "\n".join(str(tuple(r[k] for k in key)) for r in sample)
        raise ValueError(f"{name}: {n} rows share their key {key} with another row, such as\n{shown}")


def require_no_null_key(df: DataFrame, key: list[str], name: str) -> None:
    """A NULL key matches nothing in a Spark join, so it may not enter one."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    if not df.where(any_null).isEmpty():
        raise ValueError(f"{name}: rows with a missing key part among {key}")


def panel_cardinality(sales: DataFrame) -> DataFrame:
    """Stores, departments, dates and series, with the rows a full panel would have."""
    count = F.count_distinct
    return sales.agg(
        count("store_id").alias("n_stores"),
        count("department").alias("n_departments"),
        count("date").alias("n_dates"),
        count("store_id", "department").alias("n_series"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("n_theoretical_rows", F.col("n_stores") * F.col("n_departments") * F.col("n_dates"))


def panel_balance(sales: DataFrame) -> DataFrame:
    """Fewest and most observations per series and departments per store."""
    # The second level groups the few series, not the rows.
    series = key_counts(sales.dropna(subset=SERIES_KEY), SERIES_KEY)
    stores = series.groupBy("store_id").agg(
        F.min("n_rows").alias("lo"), F.max("n_rows").alias("hi"), F.count(F.lit(1)).alias("departments")
    )
    return stores.agg(
        F.min("lo").alias("min_observations"),
        F.max("hi").alias("max_observations"),
        F.min("departments").alias("min_departments"),
        F.max("departments").alias("max_departments"),
    )


# --- coverage -----------------------------------------------------------------------------------


def missing_keys(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*key).distinct().join(right.select(*key), key, "left_anti")


def key_coverage(sales: DataFrame, features: DataFrame) -> DataFrame:
    """Store-dates present on one side only."""
    one = missing_keys(sales, features, FEATURES_KEY).withColumn("missing_in", F.lit("features"))
    two = missing_keys(features, sales, FEATURES_KEY).withColumn("missing_in", F.lit("sales"))
    return one.unionByName(two)


def store_coverage(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Store numbers present on one side only, sorted."""
    one = missing_keys(sales, stores, STORES_KEY)
    two = missing_keys(stores, sales, STORES_KEY)
    return (
        one.withColumn("missing_in", F.lit("stores"))
        .unionByName(two.withColumn("missing_in", F.lit("sales")))
        .orderBy("missing_in", "store_id")
    )


# --- holiday flags ------------------------------------------------------------------------------


def store_week_flags(sales: DataFrame) -> DataFrame:
    """One row per store-date: its smallest and largest holiday flag and its number of rows."""
    return sales.groupBy(*FEATURES_KEY).agg(
        F.min("is_holiday").alias("flag_min"),
        F.max("is_holiday").alias("flag_max"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def holiday_variation(sales: DataFrame) -> DataFrame:
    """Store-dates whose rows disagree on the holiday flag."""
    # More than one distinct flag means the smallest and the largest differ; no distinct needed.
    return store_week_flags(sales).where("flag_min <> flag_max").select(*FEATURES_KEY)


def holiday_mismatch(sales: DataFrame, features: DataFrame) -> DataFrame:
    """Store-dates on both sides whose flags differ or are missing on one side."""
    left = store_week_flags(sales).select(*FEATURES_KEY, F.col("flag_min").alias("is_holiday_sales"))
    right = features.select(*FEATURES_KEY, F.col("is_holiday").alias("is_holiday_features"))
    return left.join(right, FEATURES_KEY).where(
        differs(F.col("is_holiday_sales"), F.col("is_holiday_features"))
    )


# --- joins --------------------------------------------------------------------------------------


def join_on_store_week(sales: DataFrame, features: DataFrame, parts: int | None = None) -> DataFrame:
    """Left join on store and date; other shared names get a suffix per side. Made in so many ``parts`` if given,
    by the size of the shuffle otherwise."""
    clash = [c for c in sales.columns if c in features.columns and c not in FEATURES_KEY]
    left = sales.withColumnsRenamed({c: f"{c}_sales" for c in clash})
    right = features.withColumnsRenamed({c: f"{c}_features" for c in clash})
    if parts is not None:
        left, right = (side.repartition(parts, *FEATURES_KEY) for side in (left, right))
    return left.join(right, FEATURES_KEY, "left")


def join_on_store(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Left join on store; adaptive execution broadcasts the stores while they are small."""
    return df.join(stores, STORES_KEY, "left")


def join_cardinality(left: DataFrame, right: DataFrame, key: list[str], expected: str) -> DataFrame:
    """Whether a join would be ``one_to_one`` or ``many_to_one`` as expected."""
    if expected not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown join cardinality {expected}")
    n_left = duplicate_keys(left, key).agg(F.count(F.lit(1)).alias("n")).scalar()
    right_side = duplicate_keys(right, key).agg(F.count(F.lit(1)).alias("n_right_duplicate_keys"))
    allowed = F.lit(True) if expected == "many_to_one" else F.col("n_left_duplicate_keys") == 0
    return right_side.select(
        F.lit(expected).alias("expected"), n_left.alias("n_left_duplicate_keys"), "n_right_duplicate_keys"
    ).withColumn("valid", allowed & (F.col("n_right_duplicate_keys") == 0))


def unmatched_rows(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    return left.join(right.select(*key), key, "left_anti")


def require_matched(left: DataFrame, right: DataFrame, key: list[str], name: str) -> None:
    n = unmatched_rows(left, right, key).count()
    if n:
        raise ValueError(f"{n} rows have no {name} record")


def row_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    n_after = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        before.agg(F.count(F.lit(1)).alias("n_before"))
        .select("n_before", n_after.alias("n_after"))
        .withColumn("preserved", F.col("n_before") == F.col("n_after"))
    )


def require_same_rows(before: DataFrame, after: DataFrame) -> None:
    row = row_preservation(before, after).first()
    if not row["preserved"]:
        raise ValueError(f"the join changed the number of rows: {row['n_before']} to {row['n_after']}")


def unexpected_nulls(df: DataFrame, allowed: tuple[str, ...] = ("holiday_name",)) -> DataFrame:
    return null_profile(df.drop(*allowed)).select("column_name", "n_null")


# --- verdicts -----------------------------------------------------------------------------------


def _checks(one_row: DataFrame, names: list[str], expected: dict[str, Column] | None = None) -> DataFrame:
    """Turn a one-row frame of numbers into rows of (check, observed, expected, passed)."""
    expected = expected or {}
    rows = [
        F.struct(
            F.lit(n).alias("check_name"),
            F.col(n).cast("double").alias("observed"),
            expected.get(n, F.lit(0)).cast("double").alias("expected"),
        )
        for n in names
    ]
    return (
        one_row.select(F.explode(F.array(*rows)).alias("s"))
        .select("s.*")
        .withColumn("passed", F.coalesce(F.col("observed") == F.col("expected"), F.lit(False)))
    )


def verdict(checks: DataFrame) -> DataFrame:
    """PASS if every check passed, FOLLOW-UP otherwise."""
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.when(F.bool_and("passed"), "PASS").otherwise("FOLLOW-UP").alias("verdict"),
    )


def joined_raw(sales: DataFrame, features: DataFrame, stores: DataFrame) -> DataFrame:
    """The plain left joins of the raw tables."""
    return join_on_store(join_on_store_week(sales, features), stores)


def _any_null(columns: list[str]) -> list[Column]:
    return [F.bool_or(F.col(c).isNull()).alias(f"null_{c}") for c in columns]


def store_weeks(sales: DataFrame, features: DataFrame, stores: DataFrame) -> DataFrame:
    """One row per store-date of either side: how many rows of each table meet there, the holiday flags, and
    which columns have nulls among them.

    What the joins of the three tables would give follows from these counts, so they are never made: a
    store-date has as many joined rows as the product of its sides. Each table is read once.
    """
    # Repeated sales keys are counted before the department is summed away.
    keys = sales.groupBy(*SALES_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("is_holiday").alias("lo"),
        F.max("is_holiday").alias("hi"),
        *_any_null([c for c in sales.columns if c not in SALES_KEY]),
    )
    inner = [c for c in keys.columns if c.startswith("null_")]
    left = keys.groupBy(*FEATURES_KEY).agg(
        F.sum("n").alias("n_sales"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_repeated"),
        F.min("lo").alias("flag_min"),
        F.max("hi").alias("flag_max"),
        F.struct(*[F.bool_or(c).alias(c) for c in inner], *_any_null([c for c in SALES_KEY if c not in FEATURES_KEY])).alias("sales"),
    )
    right = features.groupBy(*FEATURES_KEY).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.min("is_holiday").alias("flag_features"),
        F.struct(*_any_null([c for c in features.columns if c not in FEATURES_KEY])).alias("features"),
    )
    shops = stores.groupBy(*STORES_KEY).agg(
        F.count(F.lit(1)).alias("n_stores"),
        F.struct(*_any_null([c for c in stores.columns if c not in STORES_KEY])).alias("stores"),
    )
    return left.join(right, FEATURES_KEY, "full").join(shops, STORES_KEY, "left")


def relationship_checks(sales: DataFrame, features: DataFrame, stores: DataFrame) -> DataFrame:
    """The nine checks that decide whether the three tables may be joined."""
    both = materialize(store_weeks(sales, features, stores), "store-weeks")
    in_sales, in_features, in_stores = (F.col(c).isNotNull() for c in ("n_sales", "n_features", "n_stores"))
    times = F.coalesce("n_features", F.lit(1)) * F.coalesce("n_stores", F.lit(1))
    joined = F.col("n_sales") * times
    # Names as the joins would give them; the holiday's name may be missing.
    clash = [c for c in sales.columns if c in features.columns and c not in FEATURES_KEY]
    name = lambda c, side: f"{c}_{side}" if c in clash else c
    nulls = [F.col(c).isNull() for c in FEATURES_KEY]
    nulls += [F.col(f"sales.null_{c}") for c in sales.columns if c not in FEATURES_KEY and name(c, "sales") != "holiday_name"]
    nulls += [~in_features | F.col(f"features.null_{c}") for c in features.columns if c not in FEATURES_KEY and name(c, "features") != "holiday_name"]
    nulls += [~in_stores | F.col(f"stores.null_{c}") for c in stores.columns if c not in STORES_KEY and c != "holiday_name"]
    found = both.agg(
        F.count_if(in_sales & ~in_features).alias("sales_keys_without_features"),
        F.count_if(in_features & ~in_sales).alias("features_keys_without_sales"),
        F.count_if(F.col("flag_min") != F.col("flag_max")).alias("inconsistent_holiday_keys"),
        F.count_if(
            in_sales & in_features & differs(F.col("flag_min"), F.col("flag_features"))
        ).alias("holiday_mismatches"),
        F.coalesce(F.sum(joined), F.lit(0)).alias("rows_after_merge"),
        F.coalesce(F.sum("n_sales"), F.lit(0)).alias("rows_before"),
        reduce(
            lambda a, b: a + b,
            [F.coalesce(F.bool_or(in_sales & n), F.lit(False)).cast("int") for n in nulls],
        ).alias("columns_with_unexpected_nulls"),
        F.coalesce(F.sum(F.when(times > 1, joined).otherwise(F.col("n_repeated"))), F.lit(0)).alias("rows_in_duplicate_keys"),
    )
    sold = both.where(in_sales).select("store_id").distinct().withColumn("in_sales", F.lit(True))
    ids = (
        sold.join(stores.select("store_id").distinct().withColumn("in_stores", F.lit(True)), "store_id", "full")
        .agg(
            F.count_if(F.col("in_stores").isNull()).alias("sales_stores_missing"),
            F.count_if(F.col("in_sales").isNull()).alias("stores_unused"),
        )
    )
    tables = [
        _checks(
            found,
            [
                "sales_keys_without_features",
                "features_keys_without_sales",
                "inconsistent_holiday_keys",
                "holiday_mismatches",
                "rows_after_merge",
                "columns_with_unexpected_nulls",
                "rows_in_duplicate_keys",
            ],
            {"rows_after_merge": F.col("rows_before")},
        ),
        _checks(ids, ["sales_stores_missing", "stores_unused"]),
    ]
    return reduce(DataFrame.unionByName, tables)


# --- audit of the cleaned panel -----------------------------------------------------------------


def reconciliation(raw_sales: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows and total sales before and after cleaning."""
    total = F.coalesce(F.sum("weekly_sales"), F.lit(0)).cast("double")
    after = cleaned.agg(F.struct(F.count(F.lit(1)).alias("rows"), total.alias("total")).alias("s")).scalar()
    return (
        raw_sales.agg(
            F.count(F.lit(1)).alias("raw_rows"),
            total.alias("raw_total"),
            F.count_if(F.col("weekly_sales").isNull()).alias("n_dropped_null_target"),
        )
        .withColumn("after", after)
        .select(
            "raw_rows",
            F.col("after.rows").alias("cleaned_rows"),
            "raw_total",
            F.col("after.total").alias("cleaned_total"),
            (F.col("after.total") - F.col("raw_total")).alias("difference"),
            "n_dropped_null_target",
        )
        .withColumn(
            "reconciled",
            (F.col("raw_rows") == F.col("cleaned_rows")) & (F.abs("difference") < F.lit(1e-6)),
        )
    )


def sales_sign_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("weekly_sales") < 0).alias("n_negative"),
        F.count_if(F.col("weekly_sales") == 0).alias("n_zero"),
    )


def negative_flag_mismatches(df: DataFrame) -> DataFrame:
    # A missing amount is not below zero.
    expected = F.coalesce(F.col("weekly_sales") < 0, F.lit(False))
    return df.agg(
        F.count_if(differs(F.col("is_negative_sales").cast("boolean"), expected)).alias("n_mismatches")
    )


def holiday_label_violations(df: DataFrame) -> DataFrame:
    """Holiday rows with a placeholder name, and ordinary rows with a holiday's name."""
    name = F.trim(F.coalesce(F.col("holiday_name"), F.lit("")))
    placeholder = name.isin(HOLIDAY_PLACEHOLDERS)
    return df.agg(
        F.count_if((F.col("is_holiday") == 1) & placeholder).alias("n_holiday_without_name"),
        F.count_if((F.col("is_holiday") == 0) & ~placeholder).alias("n_ordinary_with_name"),
    )


def calendar_mismatches(df: DataFrame) -> DataFrame:
    """Stored summer flag, year and month against the date."""
    summer = F.month("date").isin(*SUMMER_MONTHS).cast("int")
    stored = {"is_summer": summer, "year": F.year("date"), "month": F.month("date")}
    return df.agg(
        *[
            F.count_if(differs(F.col(c), want)).alias(f"n_{c}_mismatches")
            for c, want in stored.items()
            if c in df.columns
        ]
    )


def audit_checks(raw_sales: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The four gating checks of the cleaned panel."""
    totals = reconciliation(raw_sales, cleaned).select(
        "raw_rows",
        F.col("cleaned_rows").alias("row_count"),
        (F.abs("difference") >= F.lit(1e-6)).cast("int").alias("total_sales_changed"),
    )
    keys = key_stats(cleaned, SALES_KEY).select(
        F.col("n_rows_in_duplicates").alias("rows_in_duplicate_keys")
    )
    summer = calendar_mismatches(cleaned).select(
        F.col("n_is_summer_mismatches").alias("summer_flag_mismatches")
    )
    tables = [
        _checks(totals, ["row_count", "total_sales_changed"], {"row_count": F.col("raw_rows")}),
        _checks(keys, ["rows_in_duplicate_keys"]),
        _checks(summer, ["summer_flag_mismatches"]),
    ]
    return reduce(DataFrame.unionByName, tables)
