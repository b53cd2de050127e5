import hashlib
from collections import defaultdict

import pytest
from helpers import SCHEMA, documents, empty, odd_rows, plain, table, with_clashing
from pyspark.sql import functions as F

from retailcast.llm.merkle import depth, fold, merkle_manifest, parent, sweep_down, sweep_up


def sha(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf_of(row, **changed):
    values = {c: row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")} | changed
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values.values()])


def climb(nodes):
    """Top of a tree, and per leaf the siblings [(before, after)] of every level."""
    proofs = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(k, min(k + 8, len(nodes)))) for k in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for leaf in below[k]:
                    proofs[leaf].append((nodes[run[0] : k], nodes[k + 1 : run[-1] + 1]))
        below = [[leaf for k in run for leaf in below[k]] for run in runs]
        nodes = [sha(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], proofs


def brute(rows, changed=lambda row: row["text"]):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {g: climb([leaf_of(r) for r in groups[g]]) for g in order}
    root, upper = climb([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, upper):
        for row, proof in zip(groups[g], trees[g][1]):
            folded = leaf_of(row, text=changed(row))
            for before, after in proof + top:
                folded = sha(*before, folded, *after)
            siblings = "".join("".join(b + a) for b, a in proof + top)
            out.append((row["doc_id"], leaf_of(row), trees[g][0], root, sha(siblings), folded, folded == root))
    return sorted(out, key=repr)


def test_equals_brute_force_with_a_changed_copy(spark):
    docs = table(spark)
    got = merkle_manifest(docs, presented={"text": F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))})
    want = brute(docs.collect(), lambda r: r.text.upper() if r.doc_id % 2 == 0 and r.text is not None else r.text)
    assert plain(got) == want
    assert 0 < got.where("verified").count() < docs.count()


@pytest.mark.parametrize("count", [1, 8, 9, 65, 4097])
def test_sizes_of_one_group(spark, count):
    # 4,097 leaves need two blocks; the second one has a single leaf.
    docs = documents(spark, *[f"text {i}" for i in range(count)])
    assert plain(merkle_manifest(docs)) == brute(docs.collect())


def test_many_groups_and_a_null_one(spark):
    rows = [(i, f"t{i}", None if i % 21 == 0 else f"l{i % 21}", "s", i) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert plain(merkle_manifest(docs)) == brute(docs.collect())


def test_odd_rows(spark):
    docs = with_clashing(odd_rows(spark)).withColumns({c: F.lit(1) for c in ("grp", "id", "digest", "changed", "i", "place", "root", "leaf")})
    docs = docs.union(docs)
    assert plain(merkle_manifest(docs)) == brute(docs.collect())
    assert merkle_manifest(empty(spark)).count() == 0


def test_written_proof_leads_to_the_root(spark):
    for row in merkle_manifest(table(spark), with_proof=True).collect():
        steps = [dict(zip(("before", "after"), (p.encode() for p in level.split(" ")))) for level in row.proof]
        assert fold(row.leaf.encode(), steps).decode() == row.root


def test_sweeps_deliver_every_node_once():
    for count in (1, 7, 64, 513):
        leaves = [sha(str(i)).encode() for i in range(count)]
        nodes = sweep_up(leaves, depth(count))
        assert [len(n) for n in nodes] == [-(-count // 8**k) for k in range(depth(count) + 1)]
        met = list(sweep_down(nodes, ()))
        assert [i for i, _ in met] == list(reversed(range(count)))
        for i, chain in met:
            cur = leaves[i]
            while chain:
                before, after, chain = chain
                cur = parent(before + cur + after)
            assert cur == nodes[-1][0]
