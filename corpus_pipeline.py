"""From raw documents to batches for training: each stage works on what the one before it kept.

All stages read whole texts, of any length. Null texts count as empty ones, columns other than those of
documents stay as they are whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retailcast.llm.exact_dedup import drop_copies
from retailcast.llm.jaccard_join import drop_near_duplicates
from retailcast.llm.mixing import mixed_documents
from retailcast.llm.packing import pack
from retailcast.llm.quality import good_documents
from retailcast.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; it is fitted on the labels of those given.

    Equal texts, empty ones too, are judged alike, so repeated rows stay or go together.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays: of all empty and null texts one, of
    rows that share the smallest id one, and a null id only where there is no other."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar texts connect, the one with the smallest id stays.

    Each row is judged by its own text, also where an id stands on several; rows without an id, and texts
    without words, stay.
    """
    return drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents taken more than once stand more than once.

    A null source is one of its own and comes last; documents without words stand once; equal keys go by
    id, then size.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their texts, in batches of equal padded length.

    Documents without words give none; repeated rows, as the mix makes them, are packed one by one.
    """
    return pack(docs, with_text=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("jaccard join", jaccard_join),
    ("source mix", source_mix),
    ("packing", packing),
]

# The stages fit a model, draw keys and join by random paths, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
