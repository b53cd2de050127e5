import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import documents, empty, odd_rows, plain, table, with_clashing

from retailcast.llm.jaccard_join import Settings, common_counts, components, drop_near_duplicates, near_duplicates


def brute(rows, least=0.8):
    texts = defaultdict(list)
    for i, text in rows:
        if i is not None:
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            texts[tuple(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower))].append(i)
    sets = {min(ids): {w[i : i + 5] for i in range(max(1, len(w) - 4))} for w, ids in texts.items() if w}
    holders, links, root = defaultdict(list), Counter(), {r: r for r in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r, s in sets.items():
        for x in s:
            holders[x].append(r)
    for r, s in sets.items():
        for y, n in Counter(y for x in s for y in holders[x] if y > r).items():
            if n >= least * (len(s) + len(sets[y]) - n):
                links[r] += 1
                links[y] += 1
                a, b = find(r), find(y)
                root[max(a, b)] = min(a, b)
    out = []
    for w, ids in texts.items():
        m = min(ids)
        out += [(i, m, find(m), links[m]) if w else (i, i, i, 0) for i in ids]
    return sorted(out + [(None, None, None, 0)] * sum(i is None for i, _ in rows), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def families(seed=5):
    """Groups of near copies of all degrees, exact copies, and texts with a common passage."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(60)]
    texts = []
    for n in (2, 3, 40):
        base = [word() for _ in range(rng.randrange(80, 200))]
        texts += [edited(rng, base, rng.randrange(0, 6)) for _ in range(n)]
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(60)]
    texts += texts[:5] + ["a b c", "a b c", "A, b; C!", "a b", ""]
    return texts


def test_equals_brute_force(spark):
    rows = list(enumerate(families()))
    want = brute(rows)
    docs = documents(spark, *[t for _, t in rows])
    assert sum(r[3] for r in want) > 100
    assert plain(near_duplicates(docs)) == want


def test_small_limits_split_buckets_and_blocks(spark):
    rows = list(enumerate(families(6)))
    docs = documents(spark, *[t for _, t in rows])
    assert plain(near_duplicates(docs, settings=Settings(limit=4, steps=2, recall=0.99999))) == brute(rows)


def test_table(spark):
    docs = table(spark)
    assert plain(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = with_clashing(odd_rows(spark))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain(near_duplicates(docs)) == brute(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 5, 6, 7, None}
    assert near_duplicates(empty(spark)).count() == 0 and drop_near_duplicates(empty(spark)).count() == 0


def test_one_id_on_several_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    near, other = [edited(rng, words, 1) for _ in range(3)], [f"v{i}" for i in range(200)]
    # Id 5 has two near copies of id 7's text, one of them twice, and a text that only id 9 comes near to.
    texts = [near[0], near[1], near[1], near[2], " ".join(other), edited(rng, other, 1), "alone"]
    got = plain(near_duplicates(documents(spark, *texts, ids=[5, 5, 5, 7, 5, 9, 1])))
    assert got == sorted([(5, 5, 5, 2)] * 3 + [(7, 7, 5, 2), (5, 5, 5, 1), (9, 9, 5, 1), (1, 1, 1, 0)], key=repr)


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, size=n).astype(np.uint64)) for n in (1, 50, 3000, 8000, 8000)]
    a, b = np.triu_indices(5, 1)
    assert common_counts(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(260, 200), (3, 3)]
    got = dict(plain(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 261)} == {7}


def test_runs_follow_from_the_recall():
    s = Settings()
    assert 1 - (1 - 0.8**s.steps) ** s.runs >= s.recall
