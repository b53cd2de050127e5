"""Cleaning rules, guards and checks on small frames."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from retailcast.functions import columns as fx
from retailcast.operators import checks, clean, profile, rollups

D = [dt.date(2022, 6, 4) + dt.timedelta(weeks=i) for i in range(4)]
SALES = "store_id long, department int, date date, weekly_sales double, is_holiday int"
FEATURES = "store_id long, date date, cpi double, markdown_1 double, is_holiday int, holiday_name string"
STORES = "store_id long, store_type string, store_size double, region string"


@pytest.fixture()
def tables(spark):
    sales = [(s, d, day, 10.0 * s + d, 0) for s in (1, 2) for d in (1, 2) for day in D]
    features = [(s, day, float(i), None, 0, None) for s in (1, 2) for i, day in enumerate(D)]
    stores = [(1, None, 5.0, "East"), (2, "A", None, None)]
    make = spark.createDataFrame
    return make(sales, SALES), make(features, FEATURES), make(stores, STORES)


def test_panel_of_clean_tables(tables):
    panel = clean.checked_panel(*tables)
    assert panel.count() == 16
    row = panel.where("store_id = 2").first()
    assert (row["store_type"], row["region"], row["store_size"]) == ("A", "Unknown", 5.0)
    assert (row["holiday_name"], row["markdown_1"], row["is_summer"]) == ("Non-Holiday", 0.0, 1)
    assert "is_holiday_sales" not in panel.columns
    assert checks.verdict(checks.audit_checks(tables[0], panel)).first()["verdict"] == "PASS"


def test_wanted_columns_prune_joins(tables):
    lean = clean.panel(*tables, columns=["region"])
    assert "region" in lean.columns and "cpi" not in lean.columns
    assert lean._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(lean.columns) == sorted(set(lean.columns))


def test_guards(spark, tables):
    sales, features, stores = tables
    with pytest.raises(ValueError, match="share their key"):
        clean.require_joinable(sales.union(sales.limit(1)), features, stores)
    with pytest.raises(ValueError, match="no features record"):
        clean.require_joinable(sales, features.where(F.col("date") != F.lit(D[0])), stores)
    with pytest.raises(ValueError, match="no stores record"):
        clean.require_joinable(sales, features, stores.where("store_id = 1"))
    with pytest.raises(ValueError, match="holiday flags"):
        clean.require_joinable(sales, features.withColumn("is_holiday", F.lit(1)), stores)
    empty_key = spark.createDataFrame([(None, 1, D[0], 1.0, 0)], SALES)
    with pytest.raises(ValueError, match="missing key"):
        clean.require_joinable(sales.union(empty_key), features, stores)


def test_row_guard(tables):
    sales, _, stores = tables
    checks.require_same_rows(sales, checks.join_on_store(sales, stores))
    with pytest.raises(ValueError, match="changed the number of rows"):
        checks.require_same_rows(sales, checks.join_on_store(sales, stores.union(stores)))


def test_global_median_follows_the_store_fill(spark):
    rows = [(1, D[0], 1.0), (1, D[1], None), (1, D[2], 1.0), (2, D[0], 9.0), (3, D[0], None)]
    df = spark.createDataFrame(rows, "store_id long, date date, cpi double")
    got = {(r["store_id"], r["date"]): r["cpi"] for r in clean.impute_by_store(df).collect()}
    # The filled column is 1, 1, 1, 9: its median is 1, while that of the raw values is 1, 1, 9.
    assert got[1, D[1]] == 1.0 and got[3, D[0]] == 1.0


def test_even_median_interpolates(spark):
    rows = [(1, D[i], v) for i, v in enumerate([1.0, 1.5, 2.0, 4.0])] + [(1, dt.date(2023, 1, 7), None)]
    df = spark.createDataFrame(rows, "store_id long, date date, cpi double")
    filled = clean.impute_by_store(df).where(F.col("date") == "2023-01-07")
    assert filled.first()["cpi"] == 1.75


def test_missing_flag_counts_as_mismatch(spark):
    sales = spark.createDataFrame([(1, 1, D[0], 1.0, 1)], SALES)
    features = spark.createDataFrame([(1, D[0], 1.0, None, None, None)], FEATURES)
    assert checks.holiday_mismatch(sales, features).count() == 1


def test_duplicate_keys_count_all_rows(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(2, 1)], "k int, v int")
    row = profile.key_stats(df, ["k"]).first()
    assert (row["n_unique_keys"], row["n_rows_in_duplicates"]) == (2, 3)
    assert profile.duplicate_rows(df).first()[0] == 2


def test_join_cardinality(spark):
    one = spark.createDataFrame([(1,), (2,)], "k int")
    many = spark.createDataFrame([(1,), (1,)], "k int")
    valid = lambda *a: checks.join_cardinality(*a).first()["valid"]
    assert valid(many, one, ["k"], "many_to_one") and valid(one, one, ["k"], "one_to_one")
    assert not valid(many, one, ["k"], "one_to_one") and not valid(one, many, ["k"], "many_to_one")


def test_relationship_verdict(tables):
    sales, features, stores = tables
    full = features.fillna(0.0)
    filled = stores.fillna("x").fillna(1.0)
    assert checks.verdict(checks.relationship_checks(sales, full, filled)).first()["verdict"] == "PASS"
    found = checks.relationship_checks(sales, features, stores)
    bad = {r["check_name"] for r in found.collect() if not r["passed"]}
    assert bad == {"columns_with_unexpected_nulls"}


def test_sums_and_groups_of_nulls(spark):
    rows = [(1, None), (None, 5.0)]
    df = spark.createDataFrame(rows, "year int, weekly_sales double")
    assert [tuple(r) for r in rollups.total_by(df, "year").collect()] == [(1, 0.0)]


def test_labels(spark):
    df = spark.createDataFrame([(6, True), (1, False), (9, None)], "m int, h boolean")
    got = df.select(
        fx.label(F.col("m"), fx.MONTH_NAMES), fx.label(F.col("h"), fx.HOLIDAY_TYPES), fx.season_of(F.col("m"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("June", "Holiday", "Summer"),
        (None, "Non-Holiday", "Winter"),
        (None, None, "Fall"),
    ]
    months = spark.range(1, 13).select(F.collect_list(fx.season_of(F.col("id")))).first()[0]
    assert months == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], [" Store-ID", "Weekly Sales "])
    assert fx.find_column(df, "store-id ") == " Store-ID" and fx.find_column(df, "x") is None
    assert fx.normalise_columns(df).columns == ["store_id", "weekly_sales"]
    with pytest.raises(ValueError, match="collide"):
        fx.normalise_columns(spark.createDataFrame([(1, 2)], ["a b", "A-B"]))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert fx.nan_to_null(df).where("x is null").count() == 1


def test_date_range_counts_bad_dates(spark):
    df = spark.createDataFrame([("2022-01-01",), ("soon",), (None,)], ["DATE"])
    row = profile.date_range(df).first()
    assert (row["earliest"], row["n_invalid"]) == (dt.date(2022, 1, 1), 2)


def test_value_counts_keep_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "x string")
    assert [tuple(r) for r in profile.value_counts(df, "x", top=2).collect()] == [("a", 2), ("b", 1)]
    assert [r[0] for r in profile.value_counts(df, "x", "value").collect()] == ["a", "b", None]


def test_parts_of_the_panel_follow_the_order_lines(spark, tmp_path, monkeypatch):
    """The filled panel and its join lie in as many more parts as there are more lines, in whichever size shuffles are read."""
    import datetime as dt

    from retailcast.operators import clean
    from retailcast.sources import orders_panel

    day = dt.date(1999, 1, 4)
    for name, rows, schema in [
        ("lineitem", [(k, k % 50, k % 40, day + dt.timedelta(days=k), 10.0, 0.1) for k in range(400)], "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double, l_discount double"),
        ("part", [(k, ["ECONOMY", "LARGE"][k % 2]) for k in range(50)], "p_partkey long, p_type string"),
        ("orders", [(k, f"{k % 5 + 1}-X") for k in range(400)], "o_orderkey long, o_orderpriority string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    stores = spark.range(40).selectExpr("id AS store_id", "'A' AS store_type", "1.0 AS store_size", "'R' AS region")
    seen = []
    for lines in (10, 5):
        monkeypatch.setattr(orders_panel, "LINES_PER_PART", lines)
        parts = orders_panel.partitions(spark, folder)
        assert parts == max(spark.sparkContext.defaultParallelism, 400 // lines)
        sales, features = orders_panel.sales(spark, folder), orders_panel.features(spark, folder)
        panel = clean.panel(sales, features, stores, parts=parts)
        assert [df.rdd.getNumPartitions() for df in (sales, features, panel)] == [parts] * 3
        seen.append(sorted(map(str, panel.collect())))
    assert seen[0] == seen[1] and len(seen[0]) > 400


def shuffled_columns(df):
    """The columns that each dealing out by number moves."""
    found, nodes = [], [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Repartition"):
            found.append(re.findall(r"(\w+)#\d+", node.output().mkString(" ")))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_derived_columns_do_not_pass_the_join(spark, tables):
    """What follows from a row's date and sales is made behind the shuffle, with the same rows and order of columns."""
    sales, features, stores = tables
    sales = sales.unionByName(spark.createDataFrame([(1, 1, D[0], -3.0, 1), (1, 1, None, 4.0, 0), (9, 1, D[0], None, 0)], SALES))
    features = features.unionByName(features.limit(1))  # a repeated key
    panel = clean.panel(sales, features, stores, parts=3)
    moved = shuffled_columns(panel)
    assert len(moved) == 2 and any("weekly_sales" in names for names in moved)
    assert not any(set(clean.DERIVED) & set(names) for names in moved)
    plain = clean.unify_holiday(checks.join_on_store_week(clean.clean_sales(sales), clean.clean_features(features), 3))
    plain = checks.join_on_store(plain, clean.clean_stores(stores)).withColumn("is_summer", fx.is_summer(F.col("month")))
    assert panel.columns == plain.columns
    assert sorted(map(str, panel.collect())) == sorted(map(str, plain.collect()))


def test_derived_names_on_both_sides_keep_their_suffixes(tables):
    sales, features, stores = tables
    panel = clean.panel(sales, features.withColumn("year", F.lit(7)), stores, parts=2)
    rows = panel.select("year_sales", "year_features", "month").distinct().collect()
    assert {tuple(r) for r in rows} == {(2022, 7, 6)}
