"""Exact duplicates by two passes over a Bloom filter.

The first pass sets, for every fingerprint, a few positions of a filter with two levels: set once,
set at least twice. A fingerprint whose positions are all set twice may be repeated; every other one
is unique for certain. The second pass tests every row: unique rows go straight to the result, and
only the rest are shuffled and grouped.

The filter has a fixed largest size. Fingerprints are cut into as many ranges as keep the filter of
each within it, and the ranges are worked through one after the other over a table of fingerprints
that is sorted within its files, so that each range reads its own row groups only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.llm.common import HOT_KEYS, SPACE, free_prefix, text_or_empty
from retailcast.session import materialize

HASHES = 2
SLOTS = 1 << 16  # ranges are made of whole slots, the first two bytes of a fingerprint
SEGMENT_BITS = 20  # the filter is put together in segments of so many bits


@dataclass(frozen=True)
class Sizes:
    """bits_per_key: bits of the filter for each row; filter_bytes: the largest filter that is sent to
    the executors."""

    bits_per_key: int = 8
    filter_bytes: int = 64 << 20


def fingerprint(text: str = "text") -> Column:
    """SHA-256 of the text with every run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACE, " "), 256))


def _slot(column: Column) -> Column:
    return F.conv(F.substring(F.hex(column), 1, 4), 16, 10).cast("int")


def _positions(fingerprints: pa.Array, bits: int) -> np.ndarray:
    """One row of filter positions for each fingerprint."""
    raw = np.frombuffer(b"".join(fingerprints.to_pylist()), dtype="<u8").reshape(-1, 4)
    return raw[:, 1 : 1 + HASHES] & np.uint64((1 << bits) - 1)


def _local_marks(bits: int):
    """Each task's positions by segment, once and at least twice, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_positions(b.column(0), bits).ravel() for b in batches if b.num_rows]
        if not found:
            return
        position, count = np.unique(np.concatenate(found), return_counts=True)
        segment = position >> np.uint64(SEGMENT_BITS)
        offset = (position & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u4")
        edges = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True])
        rows = [(int(segment[a]), offset[a:b][count[a:b] == 1].tobytes(), offset[a:b][count[a:b] > 1].tobytes()) for a, b in zip(edges, edges[1:])]
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary())],
                ["segment", "once", "twice"],
            )

    return run


def _merge_segment(bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << min(bits, SEGMENT_BITS), dtype=np.uint8)
        for once, twice in zip(table.column("once"), table.column("twice")):
            at = np.frombuffer(once.as_py(), dtype="<u4")
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[np.frombuffer(twice.as_py(), dtype="<u4")] = 2
        packed = np.packbits(counts == 2, bitorder="little").tobytes()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bitmap": pa.array([packed], pa.binary())})

    return run


def _filter_of(fingerprints: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of positions set at least twice; its size is fixed by ``bits``."""
    marks = fingerprints.mapInArrow(_local_marks(bits), "segment long, once binary, twice binary")
    merged = marks.groupBy("segment").applyInArrow(_merge_segment(bits), "segment long, bitmap binary")
    size = 1 << min(bits, SEGMENT_BITS)
    bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():
        start = row.segment * size // 8
        bitmap[start : start + size // 8] = np.frombuffer(row.bitmap, dtype=np.uint8)
    return bitmap


def _may_repeat(spark: SparkSession, fingerprints: DataFrame, bits: int):
    """A column function that tells which fingerprints may be repeated."""
    sent = spark.sparkContext.broadcast(_filter_of(fingerprints, bits))

    @F.pandas_udf("boolean")
    def test(column):
        import pandas as pd

        bitmap = sent.value
        at = _positions(pa.array(column, pa.binary()), bits)
        hit = (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1) if len(column) else [], dtype=bool)

    return test, sent


def _ranges(rows: int, sizes: Sizes) -> tuple[list[tuple[int, int]], int]:
    """Slot ranges, and the filter's bits (as a power of two) that each of them needs."""
    wanted = max(1, rows) * sizes.bits_per_key
    parts = min(SLOTS, -(-wanted // (sizes.filter_bytes * 8)))
    bits = min(max(16, (-(-wanted // parts) - 1).bit_length()), (sizes.filter_bytes * 8).bit_length() - 1)
    edges = [SLOTS * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:])), bits


def _fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_col).alias("fingerprint"))
    numbered = narrow.select("doc_id", "fingerprint", _slot(F.col("fingerprint")).alias("slot"), F.monotonically_increasing_id().alias("row"))
    return materialize(numbered.sortWithinPartitions("slot"), "fingerprints")


def _groups(maybe: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """One row per fingerprint of ``maybe``: which row stays, and the group's size; and those of them
    that hold over a thousandth of all rows, of which there are fewer than a thousand."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = maybe.groupBy("fingerprint").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.select("fingerprint", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "repeated")
    return groups, F.broadcast(groups.where(F.col("group_size") * HOT_KEYS > rows))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are equal after every run of white space became one space. Of
    equal rows the one with the smallest id stays (null ids last; of rows that share the id too, one).
    Null texts count as empty, and all empty texts are equal. An empty table gives an empty result;
    other columns of ``docs``, whatever their names, are not read. Texts of any length are whole.
    """
    spark = docs.sparkSession
    table = _fingerprint_table(docs, id_col, text_col)
    rows = table.count()
    ranges, bits = _ranges(rows, sizes)
    done = []
    for low, high in ranges:
        part = table.where((F.col("slot") >= low) & (F.col("slot") < high))
        test, sent = _may_repeat(spark, part.select("fingerprint"), bits)
        tested = materialize(part.select("doc_id", "row", "fingerprint", test("fingerprint").alias("maybe")), "tested")
        sent.destroy()
        maybe = tested.where("maybe").drop("maybe")
        groups, hot = _groups(maybe, rows)
        straight = tested.where("NOT maybe").select(
            "doc_id", "fingerprint", "row", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size")
        )
        in_hot = maybe.join(hot, "fingerprint")
        in_rest = maybe.join(hot.select("fingerprint"), "fingerprint", "left_anti").join(groups, "fingerprint")
        done += [d.select(*straight.columns) for d in (straight, in_hot, in_rest)]
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("fingerprint")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """The rows of ``docs`` that stay (see :func:`exact_dedup`), all their columns as they were.

    Rows that are unique for certain are passed on where they were read; only those that may be
    repeated are shuffled with their texts.
    """
    spark = docs.sparkSession
    table = _fingerprint_table(docs, id_col, text_col)
    rows = table.count()
    ranges, bits = _ranges(rows, sizes)
    mark, print_col, stays_col, keep_col = (f"{free_prefix(docs)}{n}" for n in ("may_repeat", "fingerprint", "stays", "keep_id"))
    parts = []
    for low, high in ranges:
        part = table.where((F.col("slot") >= low) & (F.col("slot") < high))
        test, sent = _may_repeat(spark, part.select("fingerprint"), bits)
        groups, _ = _groups(part.where(test("fingerprint")), rows)
        stays = groups.select(F.col("fingerprint").alias(stays_col), F.col("keep_id").alias(keep_col))
        own = docs.withColumn(print_col, fingerprint(text_col))
        own = own.where((_slot(F.col(print_col)) >= low) & (_slot(F.col(print_col)) < high)).withColumn(mark, test(print_col))
        straight = own.where(~F.col(mark)).drop(mark, print_col)
        kept = own.where(mark).join(stays, (F.col(print_col) == F.col(stays_col)) & F.col(id_col).eqNullSafe(F.col(keep_col)), "left_semi")
        kept = kept.dropDuplicates([print_col, id_col]).drop(mark, print_col)
        both = straight.unionByName(kept)
        if len(ranges) > 1:  # one filter at a time
            both = materialize(both, "kept")
            sent.destroy()
        parts.append(both)
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result
