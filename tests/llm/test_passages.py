import hashlib
import random

import numpy as np
import pytest
from helpers import documents, empty, odd_rows, plain, table, with_clashing

from retailcast.llm import passages as p


def brute(rows):
    first, out = {}, []
    for i, text in rows:
        b = (text or "").encode()
        if i is not None:
            for s in range(len(b) - 49):
                first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        if i is not None:
            for s in range(len(b) - 49):
                if first[b[s : s + 50]] < i:
                    gone[s : s + 50] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def shared_texts(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choices("abcdé .\0", k=n))
    pool = [piece(rng.choice([30, 49, 50, 51, 80, 200])) for _ in range(12)] + ["a" * 300, "ab" * 90, "x" * 49]
    return ["".join(rng.choice(pool) if rng.random() < 0.6 else piece(rng.randrange(1, 90)) for _ in range(rng.randrange(1, 7))) for _ in range(150)]


@pytest.mark.parametrize("frequent", [16, 2, 10**9])
def test_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(p, "FREQUENT_DOCS", frequent)
    ids = list(range(150))
    random.Random(1).shuffle(ids)
    docs = documents(spark, *shared_texts(3), ids=ids)
    want = brute(of(docs))
    assert sum(r[2] for r in want) > 1000
    assert plain(p.repeated_passages(docs)) == want


def test_table(spark):
    docs = table(spark)
    assert plain(p.repeated_passages(docs)) == brute(of(docs))


def test_kept_bytes(spark):
    got = p.repeated_passages(documents(spark, "a" * 60, "b" + "a" * 60 + "c"), with_kept=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == {0: b"a" * 60, 1: b"bc"}


def test_odd_rows(spark):
    small = with_clashing(odd_rows(spark)).where("doc_id IS NULL OR doc_id <> 5")
    assert plain(p.repeated_passages(small)) == brute(of(small))
    assert p.repeated_passages(with_clashing(odd_rows(spark))).count() == 10
    assert p.repeated_passages(empty(spark)).count() == 0
    same = documents(spark, "q" * 70, "q" * 70, "q" * 70 + "r", ids=[4, 4, 9])
    assert plain(p.repeated_passages(same)) == brute(of(same))


def test_suffix_array_of_random_strings():
    rng = random.Random(4)
    for _ in range(200):
        strings = ["".join(rng.choices("aab\xff", k=rng.randrange(1, 70))).encode("latin-1") for _ in range(rng.randrange(1, 12))]
        symbols = np.concatenate([np.r_[np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 1, 0] for s in strings])
        ends = np.flatnonzero(symbols == 0)
        left = ends[np.searchsorted(ends, np.arange(len(symbols)))] - np.arange(len(symbols))
        order = p.suffix_array(symbols, left, p._keys(symbols, left))
        suffix = [tuple(symbols[i : i + left[i]]) for i in range(len(symbols))]
        assert sorted(order.tolist()) == list(range(len(symbols)))
        assert [suffix[i] for i in order] == sorted(suffix)


def test_pieces_keep_anchors_together(monkeypatch):
    monkeypatch.setattr(p, "PIECE", 100)
    heads = np.zeros(9, dtype=p._STRING)
    heads["anchor"], heads["size"] = [1, 1, 1, 2, 2, 3, 4, 4, 4], 60
    pieces = [heads["anchor"][o].tolist() for o in p._pieces(heads, np.arange(9))]
    assert [set(x) for x in pieces] == [{1}, {2}, {3}, {4}] and sum(map(len, pieces)) == 9
