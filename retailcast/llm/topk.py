"""Exact top rows by inner product over a bit-sliced index.

Vectors are quantised to integers and stored in blocks: for every component one bitmap per bit (its
slices) and the integers themselves. A query adds the slices of all components, times its own values,
with carry-save adders over whole bitmaps. The top rows are then picked from the most significant
slice of the sum downward. The lowest bits are left out of the index, so that rows near the boundary
are found by their bounds and resolved with the exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailcast.session import materialize

BLOCK_ROWS = 16_384
QUERY_ROWS = 256
SCALE = 256
LOW_BITS = 2  # left out of the slices


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, values (longs), dims, row; vectors that are null or hold null or non-finite components
    are left out."""
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    narrow = vectors.select(F.col(id_col).alias("vec_id"), values.alias("v")).where(F.col("v").isNotNull())
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = narrow.where(~odd).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("values"))
    return kept.withColumn("dims", F.size("values")).withColumn("row", F.monotonically_increasing_id())


def _matrix(table: pa.Table, column: str, dims: int) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.int64).reshape(table.num_rows, dims)


def slices_of(matrix: np.ndarray) -> np.ndarray:
    """uint64 words by (component, bit, word) of the high bits, counted from each component's least."""
    rows, dims = matrix.shape
    high = matrix >> LOW_BITS
    high = high - high.min(axis=0)
    bits = max(1, int(high.max()).bit_length()) if high.size else 1
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words), dtype="<u8")
    for bit in range(bits):
        packed = np.packbits(((high >> bit) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, bit].view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def weighted_sum(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices, least first, of the sum over components of |q| * w, where w is the stored value for a
    positive q and its bitwise complement for a negative one: the sum's order is the scores' order."""
    columns: dict[int, list[np.ndarray]] = {}
    for at, value in enumerate(query.tolist()):
        size, own = abs(value), slices[at] if value > 0 else ~slices[at]
        for shift in range(size.bit_length()):
            if size >> shift & 1:
                for bit in range(len(own)):
                    columns.setdefault(shift + bit, []).append(own[bit])
    total, weight = [], 0
    while columns and weight <= max(columns):
        waiting = columns.get(weight, [])
        carried = columns.setdefault(weight + 1, []) if len(waiting) > 1 else []
        while len(waiting) > 2:
            a, b, c = waiting.pop(), waiting.pop(), waiting.pop()
            either = a ^ b
            carried.append((a & b) | (c & either))
            waiting.append(either ^ c)
        if len(waiting) == 2:
            a, b = waiting
            carried.append(a & b)
            waiting = [a ^ b]
        total.append(waiting[0] if waiting else np.zeros(slices.shape[2], dtype="<u8"))
        weight += 1
    return total


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_value(total: list[np.ndarray], rows: np.ndarray, k: int) -> int | None:
    """The k-th largest sum among ``rows`` (a bitmap), from the most significant slice downward."""
    if _count(rows) < k:
        return None
    tied, sure, value = rows, 0, 0
    for weight in range(len(total) - 1, -1, -1):
        ones = tied & total[weight]
        found = _count(ones)
        if sure + found >= k:
            tied, value = ones, value + (1 << weight)
        else:
            sure += found
            tied = tied & ~total[weight]
    return value


def at_least(total: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """The rows whose sum is ``bound`` or more."""
    if bound <= 0:
        return rows
    if bound >> len(total):
        return np.zeros_like(rows)
    above, tied = np.zeros_like(rows), rows
    for weight in range(len(total) - 1, -1, -1):
        if bound >> weight & 1:
            tied = tied & total[weight]
        else:
            above = above | (tied & total[weight])
            tied = tied & ~total[weight]
    return above | tied


def top_of_block(ids: np.ndarray, matrix: np.ndarray, slices: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(vec_id, score) of the block's k best rows for a query; ties to smaller ids."""
    others = np.zeros(slices.shape[2] * 64, dtype=np.uint8)
    others[: len(ids)] = ids != query_id
    rows = np.packbits(others, bitorder="little").view("<u8")
    total = weighted_sum(slices, query)
    least = kth_value(total, rows, k)
    if least is not None:
        spread = int(np.abs(query).sum()) * ((1 << LOW_BITS) - 1) >> LOW_BITS
        rows = at_least(total, rows, least - spread)
    near = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
    scores = matrix[near] @ query
    best = np.lexsort((ids[near], -scores))[:k]
    return [(int(ids[near[i]]), int(scores[i])) for i in best]


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    matrix = _matrix(table, "values", key[1].as_py())
    ids = table.column("vec_id").to_numpy().astype("<i8")
    slices = slices_of(matrix)
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int64()),
            "dims": pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "matrix": pa.array([matrix.astype("<i8").tobytes()], pa.binary()),
            "slices": pa.array([slices.tobytes()], pa.binary()),
        }
    )


def _gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    matrix = _matrix(table, "values", key[1].as_py())
    return pa.table(
        {
            "part": pa.array([key[0].as_py()], pa.int64()),
            "dims": pa.array([key[1].as_py()], pa.int32()),
            "query_ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "queries": pa.array([matrix.astype("<i8").tobytes()], pa.binary()),
        }
    )


def _score(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dims = key[1].as_py()
        out: list[tuple[int, int, int]] = []
        for row in _rows(table):
            ids = np.frombuffer(row["ids"], dtype="<i8")
            matrix = np.frombuffer(row["matrix"], dtype="<i8").reshape(len(ids), dims)
            slices = np.frombuffer(row["slices"], dtype="<u8").reshape(dims, -1, -(-len(ids) // 64)) if dims else np.zeros((0, 1, -(-len(ids) // 64)), dtype="<u8")
            query_ids = np.frombuffer(row["query_ids"], dtype="<i8")
            queries = np.frombuffer(row["queries"], dtype="<i8").reshape(len(query_ids), dims)
            for query_id, query in zip(query_ids.tolist(), queries):
                out += [(query_id, *found) for found in top_of_block(ids, matrix, slices, query_id, query, k)]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def _rows(table: pa.Table) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield {name: table.column(name)[i].as_py() for name in table.column_names}


def _parts(df: DataFrame, name: str, count: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(count)).cast("long"))


def top_rows(vectors: DataFrame, query_ids: object, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each query.

    ``query_ids`` is a condition on ``vec_id`` that tells the queries. Both the index and the queries
    are cut into blocks of fixed size, and each block of one meets each block of the other. Vectors
    that are null, or hold null or non-finite components, take no part, nor do rows without an id;
    vectors of different length are not compared. Rows with a query's own id are not its candidates;
    repeated ids among the candidates count one by one, and a repeated query is answered once. Ties go
    to the smaller id. No vectors or no queries give an empty result. Columns other than id and vector
    are not read.
    """
    values = materialize(quantised(vectors, id_col, vector_col).where("vec_id IS NOT NULL"), "quantised")
    asked = values.where(query_ids).dropDuplicates(["vec_id", "values"])
    blocks, parts = max(1, -(-values.count() // BLOCK_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    index = _parts(values, "block", blocks).groupBy("block", "dims").applyInArrow(_build, "block long, dims int, ids binary, matrix binary, slices binary")
    index = materialize(index, "bit-slices")
    queries = _parts(asked, "part", parts).groupBy("part", "dims").applyInArrow(_gather, "part long, dims int, query_ids binary, queries binary")
    queries = materialize(queries, "query-blocks").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    queries = queries.repartition(max(blocks * parts, 1), "block", "part")
    ways = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = ways.join(queries, ["block", "part", "dims"])
    found = met.groupBy("block", "dims", "part").applyInArrow(_score(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
