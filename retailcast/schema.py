"""Declared schemas, business keys and shared column names."""

from pyspark.sql import types as T

SALES_KEY = ["store_id", "department", "date"]
FEATURES_KEY = ["store_id", "date"]
STORES_KEY = ["store_id"]
SERIES_KEY = ["store_id", "department"]

MARKDOWNS = [f"markdown_{i}" for i in range(1, 6)]
ECONOMY = ["temperature", "fuel_price", "cpi", "unemployment"]

SALES = T.StructType(
    [
        T.StructField("store_id", T.LongType()),
        T.StructField("department", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("weekly_sales", T.DoubleType()),
        T.StructField("is_holiday", T.IntegerType()),
    ]
)

FEATURES = T.StructType(
    [T.StructField("store_id", T.LongType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ECONOMY + MARKDOWNS]
    + [
        T.StructField("is_holiday", T.IntegerType()),
        T.StructField("holiday_name", T.StringType()),
        T.StructField("season", T.StringType()),
    ]
)

STORES = T.StructType(
    [
        T.StructField("store_id", T.LongType()),
        T.StructField("store_type", T.StringType()),
        T.StructField("store_size", T.DoubleType()),
        T.StructField("region", T.StringType()),
    ]
)

RAW_SCHEMAS = {"sales": SALES, "features": FEATURES, "stores": STORES}
RAW_KEYS = {"sales": SALES_KEY, "features": FEATURES_KEY, "stores": STORES_KEY}
