import hashlib
import re
from collections import defaultdict

from helpers import documents, empty, odd_rows, plain, table, with_clashing

from retailcast.llm.exact_dedup import Sizes, _ranges, drop_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min(i for i in ids if i is not None) if any(i is not None for i in ids) else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    docs = table(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = exact_dedup(docs)
    assert plain(got.drop("kept")) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_many_small_filters_give_the_same(spark):
    docs, small = table(spark), Sizes(bits_per_key=4, filter_bytes=64)
    assert len(_ranges(docs.count(), small)[0]) > 1
    assert plain(exact_dedup(docs, sizes=small)) == plain(exact_dedup(docs))
    assert plain(drop_copies(docs, sizes=small)) == plain(drop_copies(docs))


def test_a_group_with_most_rows(spark):
    docs = documents(spark, *["copy"] * 3000, *[f"text {i}" for i in range(1500)])
    got = exact_dedup(docs)
    assert got.where("group_size = 3000 AND keep_id = 0").count() == 3000
    assert got.where("kept").count() == 1501


def test_odd_rows(spark):
    docs = with_clashing(odd_rows(spark))
    assert plain(exact_dedup(docs).drop("kept")) == brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [0, 2, 3, 5, 6, None]
    assert exact_dedup(docs).where("kept").count() == 6
    assert exact_dedup(empty(spark)).count() == 0 and drop_copies(empty(spark)).count() == 0
