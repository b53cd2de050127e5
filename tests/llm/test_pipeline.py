"""The stages one after the other, and the registered queries against their SQL."""

import re
from collections import Counter, defaultdict

import pytest
from helpers import FOLDER, SCHEMA, odd_rows, plain, table, with_clashing
from pyspark.sql import functions as F
from test_jaccard_join import brute as near_groups

import corpus_pipeline
from __spark_entry__ import queries
from compare import compare, tables
from retailcast.llm import queries as own
from retailcast.llm.mixing import MAX_EPOCHS, WEIGHTS, _keys, quality_weight
from retailcast.llm.packing import BATCH_WORDS, MAX_WORDS, bucket_bounds


def test_stages(spark):
    docs = table(spark)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, FOLDER)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
            assert 0 < after.select("doc_id").distinct().count() <= docs.select("doc_id").distinct().count()
        docs = after
    assert docs.count() > 0


def test_stages_with_odd_rows(spark):
    docs = with_clashing(odd_rows(spark))
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, FOLDER).count() > 0, name


def test_run_is_the_stages(spark):
    assert set(corpus_pipeline.run(spark, FOLDER).columns) >= {"doc_id", "padded", "batch", "text"}


def deduped(rows):
    """Of equal texts the smallest id's row; of its repetitions one."""
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    return list(first.values())


def one_of_each_group(rows):
    """A row goes if its text belongs to a group that begins at a smaller id."""
    named = {k: (k, r.text) for k, r in enumerate(r for r in rows if r.doc_id is not None)}
    kept = [r for r in rows if r.doc_id is None]
    # Brute-force groups know ids alone, so texts get numbers in the order of their ids.
    order = sorted(named, key=lambda k: [r for r in rows if r.doc_id is not None][k].doc_id)
    numbered = [r for r in rows if r.doc_id is not None]
    number = {k: n for n, k in enumerate(order)}
    group = {i: c for i, _, c, _ in near_groups([(number[k], named[k][1]) for k in named])}
    least = defaultdict(lambda: None)
    for k in named:
        c, i = group[number[k]], numbered[k].doc_id
        least[c] = i if least[c] is None else min(least[c], i)
    return kept + [numbered[k] for k in named if numbered[k].doc_id == least[group[number[k]]]]


def mixed(spark, rows):
    """Documents in key order until half of the next one no longer fits, after whole epochs."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    sources = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = {s: sum(words(r.text) for r in by_source[s]) for s in sources}
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        left = sum(size.values()) - sum(MAX_EPOCHS * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[o] for o in sources if o not in full) for s in sources if s not in full}
        over = {s for s in share if share[s] >= MAX_EPOCHS * size[s] - 1e-9}
        if not over:
            break
        full |= over
    target = {s: MAX_EPOCHS * size[s] if s in full else share[s] for s in sources}
    table = spark.createDataFrame(rows, SCHEMA)
    keys = {(r.doc_id, r.source, r.size): r.key for r in _keys(table, "doc_id", "source", "text", quality_weight("text"), 20_011).collect()}
    out = []
    for s in sources:
        epochs = min(MAX_EPOCHS, int(target[s] // size[s])) if size[s] else 0
        budget = int(target[s] + 1e-6) - epochs * size[s]
        for r in sorted(by_source[s], key=lambda r: (keys[r.doc_id, s, words(r.text)], r.doc_id is None, r.doc_id or 0, words(r.text))):
            n = words(r.text)
            part, budget = max(0, min(n, budget)), budget - n
            out += [r] * (1 if not n else epochs + (2 * part >= n))
    return out


def sequences_of(rows):
    """(id, chunk, start, length, words) of every document's pieces."""
    for r in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        for chunk, start in enumerate(range(0, len(found), MAX_WORDS)):
            yield r.doc_id, chunk, start, len(found[start : start + MAX_WORDS]), tuple(found[start : start + MAX_WORDS])


def written(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_equals_a_plain_chain(spark, tmp_path):
    docs = table(spark)
    base = [f"w{i}" for i in range(120)]
    near, other = " ".join(base), " ".join(f"v{i}" for i in range(90))
    extra = [
        # An id on two texts, of which one is a near copy of another id's.
        (9003, near, "en", "a", 1), (9005, near + " z", "en", "a", 1), (9005, other, "en", "b", 1),
        (9006, None, "en", None, None), (9006, "", None, "a", 0), (None, "a text without any id", "en", None, 1), (None, near, None, "b", 1),
        (9007, other + " end", "de", None, 1), (9008, near, "en", "a", 1), (9003, near, "en", "a", 1), (9009, "long " * 5000, "en", "b", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    names = {"__bucket": F.lit(1), "__size": F.lit(2), "_kept": F.lit(3), "__fingerprint": F.lit("x"), "__may_repeat": F.lit(True), "__statistics": F.lit(4), "__times": F.lit(0), "__copy": F.lit(9)}
    folder = written(spark, tmp_path, docs.withColumns(names))
    good = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select(*docs.columns).collect()
    assert 0 < len(good) < docs.count()
    rows = one_of_each_group(deduped(good))
    assert {(9005, other)} <= {(r.doc_id, r.text) for r in rows} and (9005, near + " z") not in {(r.doc_id, r.text) for r in rows}
    want = Counter(sequences_of(mixed(spark, rows)))
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.chunk, r.start, r.length, tuple(r.text.split())) for r in got) == want
    # Which batch a sequence is in follows from lengths and order; each has the bucket's length and is full.
    bounds = bucket_bounds(Counter(r.length for r in got))
    assert all(r.padded == min(b for b in bounds if b >= r.length) for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.padded, r.batch].append(r.place)
    for (padded, batch), held in places.items():
        fits = max(1, BATCH_WORDS // padded)
        last = max(b for p, b in places if p == padded)
        assert sorted(held) == list(range(len(held))) and (len(held) == fits or (batch == last and len(held) < fits))


def test_run_over_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, table(spark).limit(0))).count() == 0


def test_near_copies_leave_other_texts_of_their_id(spark):
    near, other = " ".join(f"w{i}" for i in range(120)), "quite another text that is like nothing else"
    docs = spark.createDataFrame([(3, near, "en", "a", 0), (5, near + " z", "en", "a", 0), (5, other, "en", "a", 0)], SCHEMA)
    after = corpus_pipeline.jaccard_join(spark, docs, FOLDER)
    assert [r[:2] for r in plain(after)] == [(3, near), (5, other)]


def test_every_operator_has_a_query():
    names = [n for n in queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and "pipeline" in queries()


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_sql(spark, name):
    good, note = compare(spark, tables(FOLDER), FOLDER, name)
    assert good, note
