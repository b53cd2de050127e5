"""Queries: sources and profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast import schema
from retailcast.functions import columns
from retailcast.operators import features, metrics, profile
from retailcast.queries.registry import panel, query, raw, rounded, sales_panel
from retailcast.queries.tables_sql import measures
from retailcast.session import scratch_path
from retailcast.sources import orders_panel
from retailcast.sources.files import (
    missing_columns,
    missing_inputs,
    optional_table,
    read_table,
    require_columns,
    require_inputs,
    stack_tables,
    write_table,
)


@query(
    "a1_read_csv",
    "SELECT store_id, store_type, store_size, region FROM stores",
)
def a1_read_csv(spark, folder):
    path = write_table(orders_panel.stores(spark, folder), scratch_path(spark, "stores"))
    return read_table(spark, path, schema.STORES)


@query(
    "a2_read_csv_dates",
    "SELECT store_id, department, date, CAST(weekly_sales AS DOUBLE) AS weekly_sales, is_holiday FROM sales",
)
def a2_read_csv_dates(spark, folder):
    path = write_table(orders_panel.sales(spark, folder), scratch_path(spark, "sales"))
    return read_table(spark, path, schema.SALES)


_INPUTS = ["customer", "lineitem", "never_written", "orders"]


@query(
    "a3_required_inputs",
    " UNION ALL ".join(
        f"SELECT '{n}' AS input, {'false' if n == 'never_written' else 'true'} AS present, "
        + ("CAST(NULL AS BIGINT)" if n == "never_written" else f"(SELECT count(*) FROM {n})")
        + " AS n_rows"
        for n in _INPUTS
    ),
)
def a3_required_inputs(spark, folder):
    paths = {n: f"{folder}/{n}.parquet" for n in _INPUTS}
    absent = missing_inputs(spark, paths)
    require_inputs(spark, {n: p for n, p in paths.items() if n not in absent})
    rows = F.count(F.lit(1)).alias("n_rows")
    found = [spark.read.parquet(paths[n]).agg(rows).select(F.lit(n).alias("input"), F.lit(True).alias("present"), "n_rows") for n in _INPUTS if n not in absent]
    lacking = spark.createDataFrame([(n, False, None) for n in absent], "input string, present boolean, n_rows long")
    return reduce(DataFrame.unionByName, found).unionByName(lacking)


@query(
    "a4_required_columns",
    """SELECT 'date' AS column_name, true AS present, count(date) AS n_known FROM bad_sales
       UNION ALL SELECT 'shelf', false, NULL
       UNION ALL SELECT 'store_id', true, count(store_id) FROM bad_sales
       UNION ALL SELECT 'weekly_sales', true, count(weekly_sales) FROM bad_sales""",
)
def a4_required_columns(spark, folder):
    sales = orders_panel.faulty_sales(spark, folder)
    wanted = ["date", "shelf", "store_id", "weekly_sales"]
    absent = missing_columns(sales, wanted)
    known = [c for c in wanted if c not in absent]
    require_columns(sales, known)
    counted = sales.agg(*[F.count(c).alias(c) for c in known]).unpivot([], known, "column_name", "n_known")
    counted = counted.select("column_name", F.lit(True).alias("present"), "n_known")
    return counted.unionByName(spark.createDataFrame([(c, False, None) for c in absent], "column_name string, present boolean, n_known long"))


@query(
    "a5_write_csv",
    """SELECT department, date, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(weekly_sales) AS VARCHAR) AS written_sum
       FROM sales GROUP BY ALL""",
)
def a5_write_csv(spark, folder):
    totals = orders_panel.sales(spark, folder).groupBy("department", "date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("weekly_sales").alias("written_sum"))
    path = write_table(totals, scratch_path(spark, "totals"))
    # The sum is read back as it stands in the file.
    return spark.read.option("header", True).csv(path, schema="department int, date date, n_rows long, written_sum string").select("department", "date", "n_rows", "written_sum")


@query(
    "b1_normalised_names",
    "SELECT store_id, department, sum(weekly_sales) AS weekly_sales, CAST(sum(is_holiday) AS BIGINT) AS is_holiday FROM sales GROUP BY store_id, department",
)
def b1_normalised_names(spark, folder):
    odd = {"store_id": " Store ID", "department": "Department ", "weekly_sales": "Weekly-Sales", "is_holiday": "IS_Holiday"}
    renamed = columns.normalise_columns(orders_panel.sales(spark, folder).withColumnsRenamed(odd))
    return renamed.groupBy("store_id", "department").agg(F.sum("weekly_sales").alias("weekly_sales"), F.sum("is_holiday").alias("is_holiday"))


@query(
    "b2_found_column",
    """SELECT 'Weekly_Sales ' AS found, sum(weekly_sales) AS total, count(*) AS n_rows, true AS other_is_absent FROM sales""",
)
def b2_found_column(spark, folder):
    sales = orders_panel.sales(spark, folder).withColumnRenamed("weekly_sales", "Weekly_Sales ")
    name = columns.find_column(sales, " weekly_sales")
    absent = columns.find_column(sales, "weekly") is None
    return sales.agg(F.lit(name).alias("found"), F.sum(F.col(f"`{name}`")).alias("total"), F.count(F.lit(1)).alias("n_rows"), F.lit(absent).alias("other_is_absent"))


@query(
    "a6_optional_input",
    f"""SELECT model, {measures("actual", "predicted")}, count(*) AS n_test_weeks
        FROM company_long WHERE predicted IS NOT NULL AND year = 2001 AND month IN (6, 7, 8) GROUP BY model""",
)
def a6_optional_input(spark, folder):
    tests = features.seasonal_test_rows(features.company_forecasts(sales_panel(spark, folder)), 2001)
    comparison = metrics.company_evaluation(tests, features.NAIVE_FORECASTS)
    earlier = optional_table(spark, scratch_path(spark, "never-written"))
    out = stack_tables(earlier, comparison).drop("evaluation_level")
    return rounded(rounded(out, "mae", "rmse", digits=2), "mape", "wape", "forecast_bias")


@query(
    "b3_shape",
    """SELECT 'sales' AS table_name, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM sales
       UNION ALL SELECT 'features', count(*), 14 FROM features
       UNION ALL SELECT 'stores', count(*), 4 FROM stores""",
)
def b3_shape(spark, folder):
    tables = zip(("sales", "features", "stores"), raw(spark, folder))
    return reduce(DataFrame.unionByName, [profile.shape(df, name) for name, df in tables])


@query("b3_first_rows", "SELECT * FROM sales ORDER BY store_id, department, date LIMIT 3")
def b3_first_rows(spark, folder):
    return profile.first_rows(orders_panel.sales(spark, folder), schema.SALES_KEY)


@query(
    "b4_null_profile",
    """SELECT column_name, n_null, round(n_null / CAST(n AS DOUBLE) * 100, 4) AS pct_null FROM (
         SELECT unnest(['temperature', 'fuel_price', 'cpi', 'unemployment', 'markdown_1', 'markdown_2',
                        'markdown_3', 'markdown_4', 'markdown_5', 'holiday_name', 'season']) AS column_name,
                unnest([count(*) - count(temperature), count(*) - count(fuel_price), count(*) - count(cpi),
                        count(*) - count(unemployment), count(*) - count(markdown_1), count(*) - count(markdown_2),
                        count(*) - count(markdown_3), count(*) - count(markdown_4), count(*) - count(markdown_5),
                        count(*) - count(holiday_name), count(*) - count(season)]) AS n_null,
                count(*) AS n FROM features) WHERE n_null > 0""",
)
def b4_null_profile(spark, folder):
    return rounded(profile.null_profile(orders_panel.features(spark, folder)), "pct_null")


@query(
    "b5_duplicate_rows",
    """SELECT CAST((SELECT count(*) FROM bad_sales) - (SELECT count(*) FROM (SELECT DISTINCT * FROM bad_sales))
              AS BIGINT) AS n_duplicate_rows""",
)
def b5_duplicate_rows(spark, folder):
    return profile.duplicate_rows(orders_panel.faulty_sales(spark, folder))


@query(
    "b6_date_range",
    """SELECT min(TRY_CAST(d AS DATE)) AS earliest, max(TRY_CAST(d AS DATE)) AS latest,
              count(*) FILTER (WHERE TRY_CAST(d AS DATE) IS NULL) AS n_invalid
       FROM (SELECT CASE WHEN weekly_sales IS NULL THEN 'n/a' ELSE CAST(date AS VARCHAR) END AS d FROM bad_sales)""",
)
def b6_date_range(spark, folder):
    # Dates as text, some of them not dates.
    text = F.when(F.col("weekly_sales").isNull(), "n/a").otherwise(F.col("date").cast("string"))
    return profile.date_range(orders_panel.faulty_sales(spark, folder).select(text.alias("Date ")))


@query(
    "b7_key_stats",
    """SELECT count(*) AS n_unique_keys,
              CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS n_rows_in_duplicates
       FROM (SELECT count(*) AS n FROM bad_sales GROUP BY store_id, department, date)""",
)
def b7_key_stats(spark, folder):
    return profile.key_stats(orders_panel.faulty_sales(spark, folder), schema.SALES_KEY)


@query(
    "b8_distribution",
    """SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic,
              unnest([CAST(count(v) AS DOUBLE), round(avg(v), 2), round(stddev_samp(v), 2), min(v),
                      round(quantile_cont(v, 0.25), 2), round(quantile_cont(v, 0.5), 2),
                      round(quantile_cont(v, 0.75), 2), max(v)]) AS value
       FROM (SELECT CAST(weekly_sales AS DOUBLE) AS v FROM sales)""",
)
def b8_distribution(spark, folder):
    return rounded(profile.distribution(orders_panel.sales(spark, folder), "weekly_sales"), "value", digits=2)


@query(
    "b9_value_counts",
    """SELECT 'is_holiday' AS column_name, CAST(is_holiday AS VARCHAR) AS value, count(*) AS n_rows FROM panel GROUP BY ALL
       UNION ALL (SELECT 'holiday_name', holiday_name, count(*) AS n FROM panel GROUP BY ALL ORDER BY n DESC, 2 LIMIT 15)
       UNION ALL SELECT 'store_type', store_type, count(*) FROM panel GROUP BY ALL
       UNION ALL SELECT 'region', region, count(*) FROM panel GROUP BY ALL
       UNION ALL SELECT 'season', season, count(*) FROM panel GROUP BY ALL""",
)
def b9_value_counts(spark, folder):
    df = panel(spark, folder)
    wanted = [
        ("is_holiday", "value", None),
        ("holiday_name", "frequency", 15),
        ("store_type", "frequency", None),
        ("region", "frequency", None),
        ("season", "frequency", None),
    ]
    parts = [
        profile.value_counts(df, column, by, top).select(
            F.lit(column).alias("column_name"), F.col("value").cast("string").alias("value"), "n_rows"
        )
        for column, by, top in wanted
    ]
    return reduce(DataFrame.unionByName, parts)


_RANGES = [*schema.ECONOMY, *schema.MARKDOWNS, "store_size"]


@query(
    "b10_numeric_ranges",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean FROM panel"
        for c in _RANGES
    ),
)
def b10_numeric_ranges(spark, folder):
    return rounded(profile.numeric_ranges(panel(spark, folder), _RANGES), "mean")
