"""Reading, writing and input checks."""

import datetime as dt

import pytest

from retailcast import schema
from retailcast.sources.files import (
    optional_table,
    path_exists,
    read_table,
    require_columns,
    require_inputs,
    stack_tables,
    write_table,
)


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        "Date,Weekly-Sales,Store ID,department,IS_HOLIDAY,note\n2022-01-01, 1.5 ,7,2,0,x\n2022-01-08,,7,2,1,\n"
    )
    df = read_table(spark, str(path), schema.SALES)
    assert df.columns == [*schema.SALES.names, "note"]
    assert [tuple(r)[:5] for r in df.collect()] == [
        (7, 2, dt.date(2022, 1, 1), 1.5, 0),
        (7, 2, dt.date(2022, 1, 8), None, 1),
    ]


def test_bad_values(spark, tmp_path):
    path = tmp_path / "stores.csv"
    path.write_text("store_id,store_type,store_size,region\n1,A,big,East\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_table(spark, str(path), schema.STORES).collect()
    assert read_table(spark, str(path), schema.STORES, on_bad="null").first()["store_size"] is None


def test_inferred_types(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("A,B b\n1,2.5\n")
    assert dict(read_table(spark, str(path)).dtypes) == {"a": "int", "b_b": "double"}


def test_missing_inputs_are_listed_together(spark, tmp_path):
    here = str(tmp_path)
    with pytest.raises(FileNotFoundError) as error:
        require_inputs(spark, {"here": here, "one": here + "/1", "two": here + "/2"})
    assert "one" in str(error.value) and "two" in str(error.value) and "here:" not in str(error.value)


def test_missing_columns(spark):
    df = spark.range(1)
    require_columns(df, ["id"])
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        require_columns(df, ["id", "b", "a"])


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "A", 2.5, None)], schema.STORES)
    path = write_table(df, str(tmp_path / f"t.{fmt}"), fmt)
    assert [tuple(r) for r in read_table(spark, path, schema.STORES).collect()] == [(1, "A", 2.5, None)]


def test_partitioned_write_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, 2022), (2, 2023)], "v int, year int")
    path = write_table(df, str(tmp_path / "t.parquet"), "parquet", ["year"])
    picked = read_table(spark, path).where("year = 2023")
    assert picked.count() == 1
    assert "PartitionFilters: [isnotnull(year" in picked._jdf.queryExecution().executedPlan().toString()


def test_optional_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert optional_table(spark, path) is None and not path_exists(spark, path)
    write_table(spark.createDataFrame([(1,)], "a int"), path, "parquet")
    other = spark.createDataFrame([(2, 3)], "a int, b int")
    both = stack_tables(optional_table(spark, path), None, other)
    assert sorted(tuple(r) for r in both.collect()) == [(1, None), (2, 3)]
