"""Queries: relationship and integrity checks, on clean tables and on tables with planted faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast import schema
from retailcast.operators import checks, clean
from retailcast.queries.registry import faulty, query, raw, stored
from retailcast.sources import orders_panel


@query(
    "v1_duplicate_keys",
    """SELECT store_id, department, date, count(*) AS n_rows FROM bad_sales
       GROUP BY ALL HAVING count(*) > 1""",
)
def v1_duplicate_keys(spark, folder):
    return checks.duplicate_keys(orders_panel.faulty_sales(spark, folder), schema.SALES_KEY)


@query(
    "v2_panel_cardinality",
    """SELECT *, n_stores * n_departments * n_dates AS n_theoretical_rows FROM (
         SELECT count(DISTINCT store_id) AS n_stores, count(DISTINCT department) AS n_departments,
                count(DISTINCT date) AS n_dates, count(DISTINCT (store_id, department)) AS n_series,
                count(*) AS n_rows FROM sales)""",
)
def v2_panel_cardinality(spark, folder):
    return checks.panel_cardinality(orders_panel.sales(spark, folder))


@query(
    "v3_panel_balance",
    """SELECT min(n) AS min_observations, max(n) AS max_observations,
              min(d) AS min_departments, max(d) AS max_departments FROM
       (SELECT n, count(*) OVER (PARTITION BY store_id) AS d FROM
         (SELECT store_id, department, count(*) AS n FROM bad_sales GROUP BY ALL))""",
)
def v3_panel_balance(spark, folder):
    return checks.panel_balance(orders_panel.faulty_sales(spark, folder))


@query(
    "v4_key_coverage",
    """SELECT *, 'features' AS missing_in FROM
         (SELECT store_id, date FROM bad_sales EXCEPT SELECT store_id, date FROM bad_features)
       UNION ALL SELECT *, 'sales' FROM
         (SELECT store_id, date FROM bad_features
          EXCEPT SELECT store_id, date FROM bad_sales WHERE weekly_sales IS NOT NULL)""",
)
def v4_key_coverage(spark, folder):
    sales, features, _ = faulty(spark, folder)
    # Rows without a target count as sales for one direction only, so that both find something.
    left = checks.key_coverage(sales, features).where(F.col("missing_in") == "features")
    right = checks.key_coverage(clean.drop_missing_target(sales), features)
    return left.unionByName(right.where(F.col("missing_in") == "sales"))


@query(
    "v5_store_coverage",
    """SELECT *, 'stores' AS missing_in FROM
         (SELECT DISTINCT store_id FROM bad_sales EXCEPT SELECT store_id FROM bad_stores)
       UNION ALL SELECT *, 'sales' FROM
         (SELECT store_id FROM bad_stores EXCEPT SELECT store_id FROM bad_sales)""",
)
def v5_store_coverage(spark, folder):
    sales, _, stores = faulty(spark, folder)
    return checks.store_coverage(sales, stores)


@query(
    "v6_holiday_variation",
    """SELECT store_id, date FROM bad_sales GROUP BY ALL HAVING count(DISTINCT is_holiday) > 1""",
)
def v6_holiday_variation(spark, folder):
    return checks.holiday_variation(orders_panel.faulty_sales(spark, folder))


@query(
    "v7_holiday_mismatch",
    """SELECT store_id, date, s.flag AS is_holiday_sales, f.is_holiday AS is_holiday_features
       FROM (SELECT store_id, date, min(is_holiday) AS flag FROM bad_sales GROUP BY ALL) s
       JOIN bad_features f USING (store_id, date) WHERE s.flag IS DISTINCT FROM f.is_holiday""",
)
def v7_holiday_mismatch(spark, folder):
    sales, features, _ = faulty(spark, folder)
    return checks.holiday_mismatch(sales, features)


_DUPLICATES = "(SELECT count(*) FROM (SELECT {k} FROM {t} GROUP BY ALL HAVING count(*) > 1))"


@query(
    "v8_join_cardinality",
    f"""SELECT *, n_right_duplicate_keys = 0 AND (expected = 'many_to_one' OR n_left_duplicate_keys = 0) AS valid FROM (
          SELECT 'sales-features' AS relation, 'many_to_one' AS expected,
                 {_DUPLICATES.format(k="store_id, date", t="bad_sales")} AS n_left_duplicate_keys,
                 {_DUPLICATES.format(k="store_id, date", t="bad_features")} AS n_right_duplicate_keys
          UNION ALL SELECT 'features-sales', 'one_to_one',
                 {_DUPLICATES.format(k="store_id, date", t="bad_features")},
                 {_DUPLICATES.format(k="store_id, date", t="bad_sales")}
          UNION ALL SELECT 'sales-stores', 'many_to_one',
                 {_DUPLICATES.format(k="store_id", t="bad_sales")},
                 {_DUPLICATES.format(k="store_id", t="bad_stores")})""",
)
def v8_join_cardinality(spark, folder):
    sales, features, stores = faulty(spark, folder)
    cases = [
        ("sales-features", sales, features, schema.FEATURES_KEY, "many_to_one"),
        ("features-sales", features, sales, schema.FEATURES_KEY, "one_to_one"),
        ("sales-stores", sales, stores, schema.STORES_KEY, "many_to_one"),
    ]
    parts = [
        checks.join_cardinality(left, right, key, expected).withColumn("relation", F.lit(name))
        for name, left, right, key, expected in cases
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "v9_unmatched_rows",
    """SELECT 'features' AS missing_in, store_id, department, date FROM bad_sales s
       WHERE NOT EXISTS (SELECT 1 FROM bad_features f WHERE f.store_id = s.store_id AND f.date = s.date)
       UNION ALL SELECT 'stores', store_id, department, date FROM bad_sales s
       WHERE NOT EXISTS (SELECT 1 FROM bad_stores t WHERE t.store_id = s.store_id)""",
)
def v9_unmatched_rows(spark, folder):
    sales, features, stores = faulty(spark, folder)
    one = checks.unmatched_rows(sales, features, schema.FEATURES_KEY).withColumn("missing_in", F.lit("features"))
    two = checks.unmatched_rows(sales, stores, schema.STORES_KEY).withColumn("missing_in", F.lit("stores"))
    return one.unionByName(two).select("missing_in", *schema.SALES_KEY)


@query(
    "v10_row_preservation",
    # Features of one store stand twice, so its sales rows double.
    """SELECT *, n_before = n_after AS preserved FROM (SELECT count(*) AS n_before,
         CAST(sum(CASE WHEN store_id = 3 THEN 2 ELSE 1 END) AS BIGINT) AS n_after FROM sales)""",
)
def v10_row_preservation(spark, folder):
    sales, features, stores = raw(spark, folder)
    twice = features.unionByName(features.where("store_id = 3"))
    return checks.row_preservation(sales, checks.joined_raw(sales, twice, stores))


@query("v10_row_preservation_clean", "SELECT count(*) AS n_before, count(*) AS n_after, true AS preserved FROM sales")
def v10_row_preservation_clean(spark, folder):
    sales, features, stores = raw(spark, folder)
    return checks.row_preservation(sales, checks.joined_raw(sales, features, stores))


_JOINED = """joined AS (SELECT s.store_id, s.department, s.date, s.weekly_sales, s.is_holiday AS is_holiday_sales,
    f.* EXCLUDE (store_id, date, is_holiday), f.is_holiday AS is_holiday_features, t.* EXCLUDE (store_id)
    FROM {p}sales s LEFT JOIN {p}features f ON f.store_id = s.store_id AND f.date = s.date
    LEFT JOIN {p}stores t ON t.store_id = s.store_id)"""
_TRACKED = [
    "weekly_sales",
    "is_holiday_sales",
    "temperature",
    "fuel_price",
    "cpi",
    "unemployment",
    "markdown_1",
    "markdown_2",
    "markdown_3",
    "markdown_4",
    "markdown_5",
    "season",
    "is_holiday_features",
    "store_type",
    "store_size",
    "region",
]


@query(
    "v11_unexpected_nulls",
    f"WITH {_JOINED.format(p='bad_')} SELECT column_name, n_null FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM joined" for c in _TRACKED
    )
    + ") WHERE n_null > 0",
)
def v11_unexpected_nulls(spark, folder):
    return checks.unexpected_nulls(checks.joined_raw(*faulty(spark, folder)))


def _relationship_sql(p: str) -> str:
    nulls = " + ".join(f"CAST(count({c}) < count(*) AS INTEGER)" for c in _TRACKED)
    observed = {
        "sales_keys_without_features": f"""SELECT count(*) FROM (SELECT store_id, date FROM {p}sales
            EXCEPT SELECT store_id, date FROM {p}features)""",
        "features_keys_without_sales": f"""SELECT count(*) FROM (SELECT store_id, date FROM {p}features
            EXCEPT SELECT store_id, date FROM {p}sales)""",
        "sales_stores_missing": f"""SELECT count(*) FROM (SELECT store_id FROM {p}sales
            EXCEPT SELECT store_id FROM {p}stores)""",
        "stores_unused": f"""SELECT count(*) FROM (SELECT store_id FROM {p}stores
            EXCEPT SELECT store_id FROM {p}sales)""",
        "inconsistent_holiday_keys": f"""SELECT count(*) FROM (SELECT store_id, date FROM {p}sales
            GROUP BY ALL HAVING count(DISTINCT is_holiday) > 1)""",
        "holiday_mismatches": f"""SELECT count(*) FROM
            (SELECT store_id, date, min(is_holiday) AS flag FROM {p}sales GROUP BY ALL) s
            JOIN {p}features f USING (store_id, date) WHERE s.flag IS DISTINCT FROM f.is_holiday""",
        "rows_after_merge": "SELECT count(*) FROM joined",
        "rows_in_duplicate_keys": """SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM joined
            GROUP BY store_id, department, date HAVING count(*) > 1)""",
        "columns_with_unexpected_nulls": f"SELECT {nulls} FROM joined",
    }
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS check_name, CAST(({sql}) AS DOUBLE) AS observed,
            CAST({f"(SELECT count(*) FROM {p}sales)" if name == "rows_after_merge" else "0"} AS DOUBLE) AS expected"""
        for name, sql in observed.items()
    )
    return f"""WITH {_JOINED.format(p=p)}, checked AS (SELECT *, observed = expected AS passed FROM ({rows}))"""


@query(
    "v12_relationship_checks",
    _relationship_sql("") + " SELECT * FROM checked",
)
def v12_relationship_checks(spark, folder):
    return checks.relationship_checks(*raw(spark, folder))


@query("v12_relationship_checks_faulty", _relationship_sql("bad_") + " SELECT * FROM checked")
def v12_relationship_checks_faulty(spark, folder):
    return checks.relationship_checks(*faulty(spark, folder))


@query(
    "v12_relationship_verdict",
    _relationship_sql("bad_")
    + """ SELECT count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed,
          CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FOLLOW-UP' END AS verdict FROM checked""",
)
def v12_relationship_verdict(spark, folder):
    return checks.verdict(checks.relationship_checks(*faulty(spark, folder)))


_CLEANED_FAULTY = "cleaned AS (SELECT * FROM bad_sales WHERE weekly_sales IS NOT NULL)"


@query(
    "v13_reconciliation",
    f"""WITH {_CLEANED_FAULTY} SELECT *, cleaned_total - raw_total AS difference,
          raw_rows = cleaned_rows AND abs(cleaned_total - raw_total) < 0.000001 AS reconciled FROM (
          SELECT (SELECT count(*) FROM bad_sales) AS raw_rows, (SELECT count(*) FROM cleaned) AS cleaned_rows,
                 CAST((SELECT sum(weekly_sales) FROM bad_sales) AS DOUBLE) AS raw_total,
                 CAST((SELECT sum(weekly_sales) FROM cleaned) AS DOUBLE) AS cleaned_total,
                 (SELECT count(*) FROM bad_sales WHERE weekly_sales IS NULL) AS n_dropped_null_target)""",
)
def v13_reconciliation(spark, folder):
    sales = orders_panel.faulty_sales(spark, folder)
    return checks.reconciliation(sales, clean.clean_sales(sales))


@query(
    "v14_sales_signs",
    """SELECT count(*) FILTER (WHERE weekly_sales < 0) AS n_negative,
              count(*) FILTER (WHERE weekly_sales = 0) AS n_zero FROM bad_sales""",
)
def v14_sales_signs(spark, folder):
    return checks.sales_sign_counts(orders_panel.faulty_sales(spark, folder))


@query(
    "v15_negative_flag",
    # The stored flag comes from the clean sales, the amounts from those with negated ones.
    "SELECT count(*) AS n_mismatches FROM bad_sales WHERE weekly_sales < 0",
)
def v15_negative_flag(spark, folder):
    stored = orders_panel.faulty_sales(spark, folder).withColumn("is_negative_sales", F.lit(0))
    return checks.negative_flag_mismatches(stored)


@query(
    "v16_holiday_labels",
    """WITH labelled AS (SELECT is_holiday, trim(coalesce(holiday_name, '')) IN ('Non-Holiday', 'No Holiday', 'None', '', 'nan')
          AS placeholder FROM bad_features)
       SELECT count(*) FILTER (WHERE is_holiday = 1 AND placeholder) AS n_holiday_without_name,
              count(*) FILTER (WHERE is_holiday = 0 AND NOT placeholder) AS n_ordinary_with_name FROM labelled""",
)
def v16_holiday_labels(spark, folder):
    return checks.holiday_label_violations(orders_panel.faulty_features(spark, folder))


@query(
    "v17_calendar_fields",
    # Stored fields are those of the following week, so month and year ends differ.
    """SELECT count(*) FILTER (WHERE (month(date) IN (6, 7, 8)) <> (month(date + 7) IN (6, 7, 8))) AS n_is_summer_mismatches,
              count(*) FILTER (WHERE year(date) <> year(date + 7)) AS n_year_mismatches,
              count(*) FILTER (WHERE month(date) <> month(date + 7)) AS n_month_mismatches FROM sales""",
)
def v17_calendar_fields(spark, folder):
    later = F.date_add("date", 7)
    stored = orders_panel.sales(spark, folder).withColumns(
        {"year": F.year(later), "month": F.month(later), "is_summer": F.month(later).isin(6, 7, 8).cast("int")}
    )
    return checks.calendar_mismatches(stored)


def _audit_sql(raw_table: str, cleaned: str, summer: str = "0") -> str:
    return f"""SELECT *, observed = expected AS passed FROM (
        SELECT 'row_count' AS check_name, CAST((SELECT count(*) FROM {cleaned}) AS DOUBLE) AS observed,
               CAST((SELECT count(*) FROM {raw_table}) AS DOUBLE) AS expected
        UNION ALL SELECT 'total_sales_changed', CAST((SELECT sum(weekly_sales) FROM {raw_table})
               <> (SELECT sum(weekly_sales) FROM {cleaned}) AS INTEGER), 0
        UNION ALL SELECT 'rows_in_duplicate_keys', (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n
               FROM {cleaned} GROUP BY store_id, department, date HAVING count(*) > 1)), 0
        UNION ALL SELECT 'summer_flag_mismatches', (SELECT {summer}), 0)"""


@query("v18_audit_checks", _audit_sql("sales", "panel"))
def v18_audit_checks(spark, folder):
    sales, features, stores = stored(raw(spark, folder))
    return checks.audit_checks(sales, clean.panel(sales, features, stores, parts=orders_panel.partitions(spark, folder)))


@query(
    "v18_audit_checks_shifted",
    _audit_sql("sales", "panel", "count(*) FROM panel WHERE (month(date) IN (6, 7, 8)) <> (month(date + 7) IN (6, 7, 8))"),
)
def v18_audit_checks_shifted(spark, folder):
    # The stored summer flags are those of the following week.
    sales, features, stores = stored(raw(spark, folder))
    later = F.month(F.date_add("date", 7)).isin(6, 7, 8).cast("int")
    return checks.audit_checks(sales, clean.panel(sales, features, stores, parts=orders_panel.partitions(spark, folder)).withColumn("is_summer", later))


@query(
    "v18_audit_verdict",
    f"""WITH {_CLEANED_FAULTY}, checked AS ({_audit_sql("bad_sales", "cleaned")})
        SELECT count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed,
               CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FOLLOW-UP' END AS verdict FROM checked""",
)
def v18_audit_verdict(spark, folder):
    sales, features, stores = stored(faulty(spark, folder))
    return checks.verdict(checks.audit_checks(sales, clean.panel(sales, features, stores, parts=orders_panel.partitions(spark, folder))))
