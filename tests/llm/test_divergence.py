import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, documents, empty, odd_rows, plain, table, with_clashing
from pyspark.sql import functions as F

from retailcast.llm.divergence import Settings, count_terms, radix_order, packed, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows, min_docs=30, top=50):
    held, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", terms_of(text)
        sources[lang].add(source)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, names in sources.items():
        kept = {t for t, n in held[lang].items() if n >= min_docs}
        whole = Counter()
        for s in names:
            whole.update(counts[lang, s])

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in names}, shares(whole)
        for s in names:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out, key=repr)


def rows_of(docs):
    return [(r.lang, r.source, r.text) for r in docs.collect()]


@pytest.mark.parametrize("settings", [Settings(min_docs=2), Settings(min_docs=3, top_terms=5, buffer_bytes=3000, block_terms=50, block_sources=4)])
def test_equals_brute_force(spark, settings):
    docs = table(spark)
    assert plain(source_divergence(docs, settings=settings)) == brute(rows_of(docs), settings.min_docs, settings.top_terms)


def test_terms_of_every_length_and_case(spark):
    words = ["É", "ÉA", "aÉ", "Straße", "x" * 8, "x" * 9, "X" * 16, "x" * 17, "y" * 5000, "ab\x00cd", "ab-cd", "日本語", "日本語日本語日本語"]
    docs = documents(spark, *[" ".join(words[i:]) for i in range(len(words))], sources=[f"s{i % 3}" for i in range(len(words))])
    assert plain(source_divergence(docs, settings=Settings(min_docs=2))) == brute(rows_of(docs), 2)


def test_a_source_with_most_rows_and_languages_without_terms(spark):
    rows = [(i, f"common word{i % 7}", "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(400)]
    rows += [(500 + i, "1 2 3", "xx", f"s{i}", 0) for i in range(4)] + [(600, "alone here", "yy", "only", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = source_divergence(docs)
    assert plain(got) == brute(rows_of(docs))
    assert [r.value for r in got.where("lang = 'xx'").collect()] == [0] * 12
    assert got.where("lang = 'yy'").count() == 0


def test_odd_rows(spark):
    docs = with_clashing(odd_rows(spark)).withColumns({c: F.lit("z") for c in ("item", "value", "rank", "term", "number", "tblock", "total")})
    docs = docs.union(docs)
    assert plain(source_divergence(docs, settings=Settings(min_docs=2))) == brute(rows_of(docs), 2)
    assert source_divergence(empty(spark)).count() == 0


def test_radix_order_is_a_stable_sort():
    draw = np.random.default_rng(0)
    for size in range(1, 17):
        data = draw.integers(97, 100, size * 500).astype(np.uint8)
        raw, words = packed(data, np.arange(500) * size, size)
        order = radix_order(words, size)
        assert order.tolist() == sorted(range(500), key=lambda i: (raw[i].tobytes(), i))


def test_runs_count_documents_once():
    texts = [b"aa aa bb", b"aa", b"bb bb", b"Aa verylongtermindeedtoo verylongtermindeedtoo"]
    found = {}
    for terms, groups, counts, holders in count_terms(texts, np.array([0, 0, 1, 1])):
        for t, g, n, d in zip(terms, groups, counts, holders):
            found[bytes(t), int(g)] = int(n), int(d)
    assert found == {(b"aa", 0): (3, 2), (b"bb", 0): (1, 1), (b"bb", 1): (2, 1), (b"aa", 1): (1, 1), (b"verylongtermindeedtoo", 1): (2, 1)}
