"""Small tables for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, *texts, sources=None, ids=None) -> DataFrame:
    ids = range(len(texts)) if ids is None else ids
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in zip(ids, texts, sources)], SCHEMA)


def table(spark: SparkSession, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def plain(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Names that operators use inside; as extra columns they must do no harm.
CLASHING = ("kept", "keep_id", "group_size", "size", "bucket", "block", "key", "row", "slot", "target", "part", "spans", "words", "path", "n", "rid", "score", "label", "length")


def with_clashing(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASHING})


# What every operator has to cope with: nulls, empty and blank texts, ties, repeated rows, a long text.
def odd_rows(spark: SparkSession) -> DataFrame:
    long = "word " * 30_000 + "end " + "x" * 50_000
    texts = [None, "", "   ", "one two three four five six", "one two three four five six", long, "same text", None]
    rows = [(i, t, None, "s" if i % 2 else None, None) for i, t in enumerate(texts)] + [(6, "same text", None, "s", None), (None, "no id here", None, "s", None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
