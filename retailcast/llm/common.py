"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.session import materialize

# What the contracts call white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# A share of all rows that at most this many keys can hold.
HOT_KEYS = 1000
# Tables of at most so many rows are sent to every task; larger ones are joined through a shuffle.
BROADCAST_ROWS = 10_000
# A filter is made of bitmaps of 4 KB, at most so many of them (32 MB).
BITMAP_BITS = 32_768
FILTER_BITMAPS = 8_192


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(column), F.lit(WORD))).cast("long")


def free_prefix(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` has, for columns that stand beside them for a while."""
    return "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else the planner chooses."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key``, where ``size`` says how many rows a key has.

    Keys with over a thousandth of all ``total`` rows, of which there are fewer than a thousand, are
    sent to every task; the rest is joined through a shuffle in which no key is large.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_KEYS > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups, key)
    return rows.join(hot, key).unionByName(rest)


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame, bitmaps: int = FILTER_BITMAPS) -> DataFrame:
    """The rows whose ``key`` may be among the values of the only column of ``wanted``: all that are, and
    some that are not, so that a join with ``wanted`` has little to shuffle.

    The filter has one bit per value, about 32 of them for each value as long as ``bitmaps`` allow it, and
    is sent to every task. Beyond that it lets more rows pass and stays as large.
    """
    count = min(bitmaps, max(1, -(-wanted.count() * 32 // BITMAP_BITS)))
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(count * BITMAP_BITS))
    bitmap = lambda column: F.floor(place(column) / BITMAP_BITS)
    name = free_prefix(rows)
    at, bits = f"{name}bitmap", f"{name}bits"
    value = F.col(wanted.columns[0])
    own = wanted.groupBy(bitmap(value).alias(at)).agg(F.bitmap_construct_agg(place(value) % BITMAP_BITS).alias(bits))
    met = rows.join(F.broadcast(own), bitmap(F.col(key)) == F.col(at))
    bit = (place(F.col(key)) % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, bit % 8) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``materialize``, and the shuffle files of the job go as soon as the table is written, so that
    the steps of an operator do not need their disk at the same time."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(name, before)
