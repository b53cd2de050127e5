import itertools
import random
import re
from collections import defaultdict

from helpers import documents, empty, odd_rows, plain, table, with_clashing

from retailcast.llm.packing import bucket_bounds, pack


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in histogram.items())


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        histogram = {rng.randrange(1, 30): rng.randrange(1, 50) for _ in range(rng.randrange(1, 8))}
        for k in (1, 2, 3, 9):
            bounds = bucket_bounds(histogram, k)
            own = sorted(histogram)
            best = min(padding(histogram, c) for n in range(1, k + 1) for c in itertools.combinations(own, min(n, len(own))) if c[-1] == own[-1])
            assert len(bounds) <= k and padding(histogram, bounds) == best
    assert bucket_bounds({}) == []


def check(spark, docs, max_words, buckets, batch_words):
    got = pack(docs, max_words=max_words, buckets=buckets, batch_words=batch_words, with_text=True).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    rows, batches, histogram = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in got:
        rows[r.doc_id].append(r)
        batches[r.padded, r.batch].append(r.place)
        histogram[r.length] += 1
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.length <= min(r.padded, max_words)
    for i, own in texts.items():
        words = [w for r in sorted(rows[i], key=lambda r: r.chunk) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)]
        assert sorted(words) == sorted(w for t in own for w in t)
        if len(own) == 1:
            assert words == own[0]
    last = {p: max(b for q, b in batches if q == p) for p, _ in batches}
    for (padded, batch), places in batches.items():
        fits = max(1, batch_words // padded)
        assert sorted(places) == list(range(len(places))) and len(places) <= fits
        assert len(places) == fits or batch == last[padded]
    if histogram:
        bounds = bucket_bounds(dict(histogram), buckets)
        assert sum(r.padded - r.length for r in got) == padding(histogram, bounds)


def test_table(spark):
    check(spark, table(spark), 300, 6, 900)


def test_odd_rows(spark):
    check(spark, with_clashing(odd_rows(spark)), 1000, 4, 4000)
    assert pack(empty(spark)).count() == 0 and pack(documents(spark, None, " ")).count() == 0
    copies = documents(spark, *["a b c d e"] * 3, ids=[1, 1, 1])
    check(spark, copies, 2, 2, 4)


def test_order_of_input_is_no_matter(spark):
    docs = table(spark)
    assert plain(pack(docs)) == plain(pack(docs.repartition(5)))
