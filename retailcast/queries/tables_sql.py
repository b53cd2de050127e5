"""The shared tables in DuckDB SQL, written independently of the Spark code.

``with_tables`` puts the definitions that a query needs in front of it.
"""

from __future__ import annotations

import re

_ECONOMY = ["temperature", "fuel_price", "cpi", "unemployment"]
_MARKDOWNS = [f"markdown_{i}" for i in range(1, 6)]
_I = range(1, 6)

_DEFINITIONS = {
    "lines": """
        SELECT l_suppkey AS store_id, l_partkey, l_orderkey,
               CAST(date_trunc('week', l_shipdate) AS DATE) + 5 AS wk,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(round(l_discount * 100) AS BIGINT) AS pct
        FROM lineitem""",
    "weeks": """
        SELECT CAST(g AS DATE) AS wk, CAST(row_number() OVER (ORDER BY g) - 1 AS INTEGER) AS w
        FROM (SELECT unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY)) AS g FROM lines)""",
    "cells": """
        SELECT store_id,
               CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                           WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS department,
               wk, CAST(sum(cents) AS BIGINT) AS cents
        FROM lines JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "sales_w": """
        SELECT p.store_id, p.department, k.wk AS date, coalesce(c.cents, 0) AS weekly_sales,
               CAST(weekofyear(k.wk) IN (1, 27, 36, 47, 52) AS INTEGER) AS is_holiday, k.w
        FROM (SELECT DISTINCT store_id, department FROM cells) p CROSS JOIN weeks k
        LEFT JOIN cells c ON c.store_id = p.store_id AND c.department = p.department AND c.wk = k.wk""",
    "sales": "SELECT store_id, department, date, weekly_sales, is_holiday FROM sales_w",
    "promotions": "SELECT store_id, wk, "
    + ", ".join(
        f"CAST(sum(CASE WHEN o_orderpriority LIKE '{i}%' THEN cents * pct END) AS BIGINT) AS p{i}" for i in _I
    )
    + " FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "features_w": """
        SELECT s.store_id, k.wk AS date,
               CASE WHEN (s.store_id + w) % 11 <> 0 THEN CAST((s.store_id * 7 + w * 3) % 40 AS DOUBLE) END AS temperature,
               2 + CAST((s.store_id + w) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS fuel_price,
               CASE WHEN s.store_id <> 3 THEN CAST(200 + w % 26 AS DOUBLE) END AS cpi,
               CASE WHEN w % 13 <> 0 THEN 4 + CAST(s.store_id % 7 AS DOUBLE) / CAST(2 AS DOUBLE) END AS unemployment,
               """
    + ", ".join(f"CAST(p{i} AS DOUBLE) / CAST(10000 AS DOUBLE) AS markdown_{i}" for i in _I)
    + """,
               CAST(weekofyear(k.wk) IN (1, 27, 36, 47, 52) AS INTEGER) AS is_holiday,
               CASE weekofyear(k.wk) WHEN 1 THEN 'New Year' WHEN 27 THEN 'Independence Day'
                    WHEN 36 THEN 'Labor Day' WHEN 47 THEN 'Black Friday' WHEN 52 THEN 'Christmas' END AS holiday_name,
               CASE WHEN w = 5 THEN NULL WHEN month(k.wk) IN (12, 1, 2) THEN 'Winter'
                    WHEN month(k.wk) IN (3, 4, 5) THEN 'Spring' WHEN month(k.wk) IN (6, 7, 8) THEN 'Summer'
                    ELSE 'Fall' END AS season,
               w
        FROM (SELECT DISTINCT store_id FROM promotions) s CROSS JOIN weeks k
        LEFT JOIN promotions m ON m.store_id = s.store_id AND m.wk = k.wk""",
    "features": "SELECT * EXCLUDE (w) FROM features_w",
    "stores": """
        SELECT s_suppkey AS store_id,
               CASE WHEN s_suppkey = 7 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'A'
                    WHEN s_suppkey % 3 = 1 THEN 'B' ELSE 'C' END AS store_type,
               CASE WHEN s_suppkey % 10 <> 4
                    THEN CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE) END AS store_size,
               r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "bad_sales": """
        SELECT store_id, department, date,
               CASE WHEN store_id = 4 AND w = 20 THEN -weekly_sales
                    WHEN store_id = 6 AND w = 30 THEN NULL ELSE weekly_sales END AS weekly_sales,
               CASE WHEN store_id = 8 AND w = 15 AND department = 2 THEN 1 - is_holiday ELSE is_holiday END AS is_holiday
        FROM (SELECT * FROM sales_w UNION ALL SELECT * FROM sales_w WHERE store_id = 1 AND w = 0)""",
    "bad_features": """
        SELECT * EXCLUDE (w) REPLACE
               (CASE WHEN store_id = 5 AND w = 10 THEN 1 - is_holiday ELSE is_holiday END AS is_holiday)
        FROM features_w WHERE NOT (store_id = 2 AND w = 3)""",
    "bad_stores": "SELECT * FROM stores WHERE store_id <> 9",
    "store_filled": "SELECT * REPLACE ("
    + ", ".join(
        [f"coalesce({c}, median({c}) OVER (PARTITION BY store_id)) AS {c}" for c in _ECONOMY]
        + [f"coalesce({c}, 0) AS {c}" for c in _MARKDOWNS]
    )
    + ") FROM features",
    "clean_features": "SELECT * REPLACE ("
    + ", ".join(
        [f"coalesce({c}, (SELECT median({c}) FROM store_filled)) AS {c}" for c in _ECONOMY]
        + [
            "coalesce(holiday_name, 'Non-Holiday') AS holiday_name",
            "coalesce(season, 'Unknown') AS season",
        ]
    )
    + ") FROM store_filled",
    "clean_stores": """
        SELECT store_id, coalesce(store_type, 'Unknown') AS store_type,
               coalesce(store_size, (SELECT median(store_size) FROM stores)) AS store_size,
               coalesce(region, 'Unknown') AS region FROM stores""",
    "clean_sales": """
        SELECT *, weekly_sales < 0 AS is_negative_sales, CAST(year(date) AS INTEGER) AS year,
               CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week_of_year
        FROM sales WHERE weekly_sales IS NOT NULL""",
    "panel": """
        SELECT s.*, f.* EXCLUDE (store_id, date, is_holiday), t.* EXCLUDE (store_id),
               CAST(s.month IN (6, 7, 8) AS INTEGER) AS is_summer,
               f.markdown_1 + f.markdown_2 + f.markdown_3 + f.markdown_4 + f.markdown_5 AS total_markdown
        FROM clean_sales s
        LEFT JOIN clean_features f ON f.store_id = s.store_id AND f.date = s.date
        LEFT JOIN clean_stores t ON t.store_id = s.store_id""",
    "summer": "SELECT * FROM panel WHERE month IN (6, 7, 8)",
    "company": """
        SELECT date, CAST(sum(weekly_sales) AS BIGINT) AS total_weekly_sales, CAST(year(date) AS INTEGER) AS year,
               CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
               CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer
        FROM sales GROUP BY date""",
    "company_naive": """
        SELECT *, lag(total_weekly_sales, 1) OVER o AS pred_last_week,
               CASE WHEN count(total_weekly_sales) OVER r = 4 THEN avg(total_weekly_sales) OVER r END AS pred_rolling_4w,
               lag(total_weekly_sales, 52) OVER o AS pred_prev_year_same_week
        FROM company
        WINDOW o AS (ORDER BY date), r AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""",
    "series_naive": """
        SELECT *, lag(weekly_sales, 1) OVER o AS pred_last_week,
               CASE WHEN count(weekly_sales) OVER r = 4 THEN avg(weekly_sales) OVER r END AS pred_rolling_4w,
               lag(weekly_sales, 52) OVER o AS pred_prev_year_same_week
        FROM clean_sales
        WINDOW o AS (PARTITION BY store_id, department ORDER BY date),
               r AS (PARTITION BY store_id, department ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""",
    "series_long": """
        SELECT store_id, department, date, year, month, weekly_sales, model, predicted FROM (
          SELECT *, 'Last Week Baseline' AS model, CAST(pred_last_week AS DOUBLE) AS predicted FROM series_naive
          UNION ALL
          SELECT *, 'Rolling 4-Week Average Baseline', pred_rolling_4w FROM series_naive
          UNION ALL
          SELECT *, 'Previous Year Same Week Baseline', CAST(pred_prev_year_same_week AS DOUBLE) FROM series_naive)""",
    "company_long": """
        SELECT date, year, month, CAST(total_weekly_sales AS DOUBLE) AS actual, model, predicted FROM (
          SELECT *, 'Last Week Baseline' AS model, CAST(pred_last_week AS DOUBLE) AS predicted FROM company_naive
          UNION ALL
          SELECT *, 'Rolling 4-Week Average Baseline', pred_rolling_4w FROM company_naive
          UNION ALL
          SELECT *, 'Previous Year Same Week Baseline', CAST(pred_prev_year_same_week AS DOUBLE) FROM company_naive)""",
    "candidates": "SELECT * FROM series_long WHERE model <> 'Rolling 4-Week Average Baseline'",
    "featured": """
        SELECT *, lag(weekly_sales, 1) OVER o AS lag_1, lag(weekly_sales, 4) OVER o AS lag_4,
               lag(weekly_sales, 8) OVER o AS lag_8,
               CASE WHEN count(weekly_sales) OVER r4 = 4 THEN avg(weekly_sales) OVER r4 END AS rolling_mean_4,
               CASE WHEN count(weekly_sales) OVER r8 = 8 THEN avg(weekly_sales) OVER r8 END AS rolling_mean_8,
               CASE WHEN count(weekly_sales) OVER r4 = 4 THEN stddev_samp(weekly_sales) OVER r4 END AS rolling_std_4
        FROM clean_sales
        WINDOW o AS (PARTITION BY store_id, department ORDER BY date),
               r4 AS (PARTITION BY store_id, department ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
               r8 AS (PARTITION BY store_id, department ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
    "complete": """
        SELECT * FROM featured WHERE lag_1 IS NOT NULL AND lag_4 IS NOT NULL AND lag_8 IS NOT NULL
          AND rolling_mean_4 IS NOT NULL AND rolling_mean_8 IS NOT NULL AND rolling_std_4 IS NOT NULL""",
    "numbered": """
        SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS weeks
        FROM (SELECT DISTINCT date FROM complete)""",
    "tested": """
        SELECT date, CAST((n - first_n - 1) // 14 + 1 AS INTEGER) AS fold, n FROM
          (SELECT *, 69 AS first_n FROM numbered) WHERE n > first_n""",
    "plan": """
        SELECT fold, (SELECT min(date) FROM numbered) AS train_start,
               (SELECT max(m.date) FROM numbered m WHERE m.n < min(t.n)) AS train_end,
               min(t.date) AS test_start, max(t.date) AS test_end,
               CAST(min(t.n) - 1 AS BIGINT) AS n_train_weeks, count(*) AS n_test_weeks
        FROM tested t GROUP BY fold""",
    "fold_weekly": """
        SELECT fold, model, date, CAST(sum(weekly_sales) AS DOUBLE) AS actual_total_sales,
               sum(predicted) AS predicted_total_sales
        FROM candidates JOIN tested USING (date) WHERE predicted IS NOT NULL GROUP BY ALL
        UNION ALL
        SELECT fold, 'Rolling 4-Week Baseline', date, CAST(total_weekly_sales AS DOUBLE), pred_rolling_4w
        FROM company_naive JOIN tested USING (date) WHERE pred_rolling_4w IS NOT NULL""",
    "fold_company": """
        SELECT fold, model, avg(abs(predicted_total_sales - actual_total_sales)) AS company_mae,
               sqrt(avg((predicted_total_sales - actual_total_sales) * (predicted_total_sales - actual_total_sales))) AS company_rmse,
               avg(CASE WHEN actual_total_sales <> 0 THEN abs((predicted_total_sales - actual_total_sales) / actual_total_sales) END) * 100 AS company_mape,
               sum(abs(predicted_total_sales - actual_total_sales)) / nullif(sum(abs(actual_total_sales)), 0) * 100 AS company_wape,
               sum(predicted_total_sales - actual_total_sales) / nullif(sum(abs(actual_total_sales)), 0) * 100 AS company_forecast_bias,
               count(*) AS n_test_weeks
        FROM fold_weekly GROUP BY ALL""",
    "winners": """
        SELECT fold, model AS winning_model, company_wape AS winning_company_wape FROM
          (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY company_wape, model) AS place FROM fold_company)
        WHERE place = 1""",
    "summary": """
        SELECT row_number() OVER (ORDER BY mean_company_wape, std_company_wape, model) AS rank, * FROM (
          SELECT model, count(DISTINCT fold) AS folds, avg(company_mape) AS mean_company_mape,
                 avg(company_wape) AS mean_company_wape, median(company_wape) AS median_company_wape,
                 stddev_samp(company_wape) AS std_company_wape, min(company_wape) AS min_company_wape,
                 max(company_wape) AS max_company_wape, avg(company_forecast_bias) AS mean_company_bias,
                 avg(abs(company_forecast_bias)) AS mean_absolute_company_bias,
                 coalesce((SELECT count(*) FROM winners v WHERE v.winning_model = c.model), 0) AS fold_wins
          FROM fold_company c GROUP BY model)""",
}


def with_tables(sql: str) -> str:
    """Put the definitions that ``sql`` refers to, directly or not, in front of it."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, body in _DEFINITIONS.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    tables = ",\n".join(f"{n} AS ({_DEFINITIONS[n]})" for n in needed)
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {tables},\n{sql.lstrip()[len('WITH RECURSIVE ') :]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {tables},\n{sql.lstrip()[5:]}"
    return f"WITH {tables}\n{sql}"


def measures(actual: str, predicted: str) -> str:
    """The five accuracy measures as SQL aggregates, rounded for comparison."""
    e = f"({predicted} - {actual})"
    return f"""round(avg(abs({e})), 2) AS mae, round(sqrt(avg({e} * {e})), 2) AS rmse,
        round(avg(CASE WHEN {actual} <> 0 THEN abs({e} / {actual}) END) * 100, 4) AS mape,
        round(sum(abs({e})) / nullif(sum(abs({actual})), 0) * 100, 4) AS wape,
        round(sum({e}) / nullif(sum(abs({actual})), 0) * 100, 4) AS forecast_bias"""
