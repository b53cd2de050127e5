import math
import random

import numpy as np
from helpers import plain, table
from pyspark.sql import functions as F

from retailcast.llm import topk


def brute(rows, asks, k=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in kept if asks(i)}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def run(spark, rows, condition="vec_id % 3 = 0", **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).withColumn("dims", F.lit(2))
    return plain(topk.top_rows(df, F.expr(condition), **more))


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "embeddings").collect()]
    assert plain(topk.top_rows(table(spark, "embeddings"), F.col("vec_id") % 50 == 0)) == brute(rows, lambda i: i % 50 == 0)


def test_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 3.0]) for _ in range(3)]) for i in range(300)]
    assert run(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    assert run(spark, rows, k=1) == brute(rows, lambda i: i % 3 == 0, 1)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, [1.0]), (6, [0.0, 0.0]), (7, [0.5, -0.5]), (7, [0.5, -0.5]), (None, [1.0, 1.0]), (8, []), (9, [])]
    assert run(spark, rows, "true") == brute(rows, lambda i: True)
    assert run(spark, []) == [] and run(spark, rows, "false") == []


def test_slices_add_up():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-300, 300, size=(200, 9))
    slices = topk.slices_of(matrix)
    high = (matrix >> topk.LOW_BITS) - (matrix >> topk.LOW_BITS).min(axis=0)
    for _ in range(20):
        query = rng.integers(-200, 200, size=9)
        total = topk.weighted_sum(slices, query)
        got = sum(np.unpackbits(t.view(np.uint8), bitorder="little")[:200].astype(np.int64) << i for i, t in enumerate(total))
        full = (1 << slices.shape[1]) - 1
        want = (np.where(query < 0, full - high, high) * np.abs(query)).sum(axis=1)
        assert (got == want).all()
        rows = np.packbits(np.r_[np.ones(200, np.uint8), np.zeros(56, np.uint8)], bitorder="little").view("<u8")
        value = topk.kth_value(total, rows, 5)
        assert value == np.sort(want)[-5]
        kept = np.flatnonzero(np.unpackbits(topk.at_least(total, rows, value).view(np.uint8), bitorder="little"))
        assert kept.tolist() == np.flatnonzero(want >= value).tolist()
