import re
from collections import defaultdict

import pytest
from helpers import documents, empty, odd_rows, plain, table, with_clashing

from retailcast.llm.mixing import mix, mixed_documents, source_targets


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        left = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed.update({s: 3 * sizes[s] for s in above})


def test_targets_equal_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 300}, {"x": 1}, {"b": 7, "a": 7, "c": 7, "d": 100}, {"é": 50, "z": 3, "Z": 900, "a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_sources_take_their_targets(spark):
    docs = table(spark)
    source, words = {r.doc_id: r.source for r in docs.collect()}, {r.doc_id: size(r.text) for r in docs.collect()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for i, n in words.items():
        sizes[source[i]] += n
    got = mix(docs).collect()
    assert len(got) == len(words)
    partly = defaultdict(int)
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
        partly[source[r.doc_id]] += bool(r.size and r.taken % r.size)
    assert targets == pytest.approx(brute_targets(sizes))
    for s, target in targets.items():
        assert 0 <= target - taken[s] < 1 + 1e-6 and partly[s] <= 1
    for r in got:  # whole epochs come first
        epochs = int(r.target / r.source_size) if r.source_size else 0
        assert min(epochs, 3) * r.size <= r.taken <= (min(epochs, 3) + 1) * r.size


def test_reruns_and_partitions_agree(spark):
    docs = table(spark)
    assert plain(mix(docs)) == plain(mix(docs.repartition(7)))


def test_mixed_rows(spark):
    docs = with_clashing(table(spark))
    rows = mixed_documents(docs)
    assert rows.columns == docs.columns
    words, times = {r.doc_id: size(r.text) for r in docs.collect()}, defaultdict(int)
    for r in rows.collect():
        times[r.doc_id] += 1
    for r in mix(docs).collect():
        if r.size:
            low, high = r.taken // r.size, -(-r.taken // r.size)
            assert low <= times[r.doc_id] <= high <= 3 and times[r.doc_id] * words[r.doc_id] <= 3 * r.size


def test_weights_decide_what_comes_first(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, *["w " * 10] * 400, sources=["a"] * 200 + ["b"] * 200)
    heavy = F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(1.0)
    got = mix(docs, weights=(1, 7), weight=heavy).where("target < source_size").collect()
    even = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert even > 0.9 * sum(r.taken for r in got)


def test_odd_rows(spark):
    docs = with_clashing(odd_rows(spark))
    got = mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken == 0 for r in got if not r.size)
    assert mixed_documents(docs).columns == docs.columns and mixed_documents(docs).count() > 0
    assert mix(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0
    assert [r.target for r in mix(documents(spark, None, "")).collect()] == [0.0, 0.0]
