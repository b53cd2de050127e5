"""Packing into batches with optimal length buckets.

Long documents are cut into sequences of at most ``max_words`` words, so the histogram of lengths has
a fixed number of entries. Dynamic programming over it chooses the bucket boundaries for which the
least padding is needed; inside each bucket, batches hold as many padded sequences as the budget lets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import SPACE, sent_if_small, text_or_empty, word_count
from retailcast.session import materialize

MAX_WORDS = 2048
BUCKETS = 16
BATCH_WORDS = 16_384
SHARD_ROWS = 4096
SEED = 7


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` upper bounds for which rounding every length up to the next bound adds
    the least; of equally good choices the one with fewest bounds.

    ``histogram`` maps lengths from 1 to their counts.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[n] for n in lengths], dtype=np.float64)
    rows, words = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    size = len(lengths)
    # best[j]: least padding of the first j lengths with the buckets so far.
    best = np.r_[0.0, np.full(size, np.inf)]
    choices, totals = [], []
    for _ in range(min(buckets, size)):
        nxt, came = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=np.int64)
        for j in range(1, size + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (words[j] - words[:j])
            came[j] = np.argmin(cost)
            nxt[j] = cost[came[j]]
        best = nxt
        choices.append(came)
        totals.append(best[size])
    used = int(np.argmin(np.round(totals, 6))) + 1
    bounds, j = [], size
    for came in reversed(choices[:used]):
        bounds.append(int(lengths[j - 1]))
        j = int(came[j])
    return bounds[::-1]


def sequences(docs: DataFrame, id_col: str, text_col: str, max_words: int) -> DataFrame:
    """doc_id, chunk, start, length: consecutive pieces of every document, the last one shorter."""
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(text_col).alias("size"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(max_words).cast("long"))
    cut = sized.where("size > 0").select("doc_id", "size", F.posexplode(starts).alias("chunk", "start"))
    return cut.select("doc_id", "chunk", "start", F.least(F.lit(max_words), F.col("size") - F.col("start")).cast("int").alias("length"))


def _in_buckets(pieces: DataFrame, bounds: list[int], batch_words: int) -> DataFrame:
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>")
    padded = F.element_at(F.filter(array, lambda b: b >= F.col("length")), 1)
    fits = F.greatest(F.lit(1), F.floor(F.lit(batch_words) / F.col("padded"))).cast("long")
    return pieces.withColumn("padded", padded).withColumn("fits", fits)


def _batched(pieces: DataFrame, rows: int) -> DataFrame:
    """batch and place within the bucket: sequences are numbered within shards of the bucket, each
    shard starts where those before it end, and batches are cut from these numbers."""
    shards = max(1, -(-rows // SHARD_ROWS))
    mixed = F.xxhash64("doc_id", "chunk", F.lit(SEED))
    own = pieces.withColumn("mixed", mixed).withColumn("shard", F.pmod("mixed", F.lit(shards)))
    sums = own.groupBy("padded", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("padded").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("padded").alias("b"), F.col("shard").alias("s"), F.coalesce(before, F.lit(0)).alias("offset"))
    offsets = sent_if_small(materialize(offsets, "shard-offsets"))
    inside = F.row_number().over(Window.partitionBy("padded", "shard").orderBy("mixed", "doc_id", "chunk", "length"))
    numbered = own.withColumn("inside", inside).join(offsets, (F.col("padded") == F.col("b")) & (F.col("shard") == F.col("s")))
    number = F.col("offset") + F.col("inside") - 1
    return numbered.withColumn("batch", F.floor(number / F.col("fits"))).withColumn("place", (number % F.col("fits")).cast("int"))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = MAX_WORDS,
    buckets: int = BUCKETS,
    batch_words: int = BATCH_WORDS,
    with_text: bool = False,
) -> DataFrame:
    """One row per sequence: doc_id, chunk, start, length, padded, batch, place (and its text).

    Words are runs of non-space characters. Documents without words, null texts among them, give no
    sequence. ``padded`` is the length of the bucket, ``batch`` counts from 0 in each bucket, and only
    the last batch of a bucket may be short. Equal rows, and rows that share an id, are packed one by
    one. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    pieces = materialize(sequences(docs, id_col, text_col, max_words), "sequences")
    counted = pieces.groupBy("length").count().collect()  # at most max_words rows
    histogram = {r["length"]: r["count"] for r in counted}
    packed = _batched(_in_buckets(pieces, bucket_bounds(histogram, buckets), batch_words), sum(histogram.values()))
    columns = ["doc_id", "chunk", "start", "length", "padded", "batch", "place"]
    packed = packed.select(*columns)
    if not with_text:
        return packed
    words = F.split(F.regexp_replace(text_or_empty(text_col), f"^{SPACE}|{SPACE}$", ""), SPACE)
    texts = docs.select(F.col(id_col).alias("__id"), F.when(word_count(text_col) > max_words, words).alias("__words"), F.col(text_col).alias("__text"), word_count(text_col).alias("__size"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("__size") - 1, F.lit(max_words).cast("long"))
    cut = texts.where("__size > 0").select("*", F.posexplode(starts).alias("__chunk", "__start"))
    piece = F.when(F.col("__words").isNull(), F.col("__text")).otherwise(F.array_join(F.slice("__words", (F.col("__start") + 1).cast("int"), max_words), " "))
    cut = cut.select("__id", "__chunk", F.least(F.lit(max_words), F.col("__size") - F.col("__start")).cast("int").alias("__length"), piece.alias("text"))
    # Copies of a row, as a mix makes them, are numbered, so that each sequence gets one text.
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1)))
    left = packed.withColumn("__nth", nth("doc_id", "chunk", "length"))
    right = cut.withColumn("__nth", nth("__id", "__chunk", "__length"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("chunk") == F.col("__chunk")) & (F.col("length") == F.col("__length")) & (left["__nth"] == right["__nth"])
    return left.join(right, same).select(*columns, "text")
