"""Merkle manifest of a table: one digest for all rows, and for every row the proof that it belongs.

Leaves are numbered within their group (by default the language) and every eight consecutive nodes become
one, until one is left; the groups' last nodes are the leaves of one more such tree. A tree is cut into
blocks of ``BRANCH ** LEVELS`` nodes and a block is one task's work, tier upon tier. Inside a block, nodes are
handled in the order of their labels: a priority queue delivers digests forward to the parents, and a
second sweep in reversed order delivers the upper part of every proof back to the children. Between tiers
Spark's sorted shuffle is the queue, so no task and no queue grows with the table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import sent_if_small, written

BRANCH = 8
# Levels of a tree that one block holds: 4,096 nodes below one.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_SUFFIX = "array<struct<before: binary, after: binary>>"
_BLOCKS = "grp string, block long, n long, ids array<long>, digests binary, changed array<binary>, root binary"


def digest(values: list[Column]) -> Column:
    """SHA-256, as lowercase hex, of the values one after the other: ``-`` for null, else the number of
    UTF-8 bytes, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*framed), 256)


def parent(children: bytes) -> bytes:
    """Digest of the children's hex digests one after the other, as hex itself."""
    return hashlib.sha256(children).hexdigest().encode()


def depth(count: int) -> int:
    """Levels above ``count`` leaves."""
    levels = 0
    while BRANCH**levels < count:
        levels += 1
    return levels


def _label(level: int, index: int, count: int) -> tuple[int, int]:
    """A node comes after the last leaf below it, and after the nodes of lower levels that end there."""
    return min((index + 1) * BRANCH**level, count) - 1, level


def sweep_up(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """Hex digests of all nodes by level, the leaves first."""
    nodes: list[list[bytes]] = [leaves] + [[] for _ in range(levels)]
    queue: list[tuple[tuple[int, int], int, bytes]] = []  # label of the receiver, sender, digest
    for i, leaf in enumerate(leaves if levels else []):
        heapq.heappush(queue, (_label(1, i // BRANCH, len(leaves)), i, leaf))
        while queue and queue[0][0][0] <= i:
            label, sender, first = heapq.heappop(queue)
            received = [first]
            while queue and queue[0][0] == label:
                received.append(heapq.heappop(queue)[2])
            level, index = label[1], sender // BRANCH
            made = parent(b"".join(received))
            nodes[level].append(made)
            if level < levels:
                heapq.heappush(queue, (_label(level + 1, index // BRANCH, len(leaves)), index, made))
    return nodes


def sweep_down(nodes: list[list[bytes]], suffix: tuple) -> Iterator[tuple[int, tuple]]:
    """(leaf, its proof) from the last leaf to the first. A proof is a chain (before, after, rest) of the
    siblings on either side, from the leaf's own run upwards; ``suffix`` is the top node's."""
    count, top = len(nodes[0]), len(nodes) - 1

    def key(level: int, index: int) -> tuple[int, int]:
        last, height = _label(level, index, count)
        return -last, -height

    queue = [(key(top, 0), 0, suffix)]
    while queue:
        (_, height), index, rest = heapq.heappop(queue)
        level = -height
        if level == 0:
            yield index, rest
            continue
        first = index * BRANCH
        run = nodes[level - 1][first : first + BRANCH]
        for k in range(len(run)):
            chain = (b"".join(run[:k]), b"".join(run[k + 1 :]), rest)
            heapq.heappush(queue, (key(level - 1, first + k), first + k, chain))


def _chain(steps: list) -> tuple:
    rest: tuple = ()
    for step in reversed(steps):
        rest = (step["before"], step["after"], rest)
    return rest


def _steps(chain: tuple) -> list[dict]:
    steps = []
    while chain:
        before, after, chain = chain
        steps.append({"before": before, "after": after})
    return steps


def fold(leaf: bytes, steps: list[dict]) -> bytes:
    """The root that a leaf and its proof give."""
    for step in steps:
        leaf = parent(step["before"] + leaf + step["after"])
    return leaf


# --- numbering ------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the row's place among its group's rows there; rows come in order."""
    part = TaskContext.get().partitionId()
    group, place = None, 0
    for batch in batches:
        places = []
        for name in batch.column("grp").to_pylist():
            if name != group:
                group, place = name, 0
            places.append(place)
            place += 1
        extra = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "place"])


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``i``, their place within ``grp``, and ``n``, the size of ``grp``."""
    keys = ["grp", *order]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranged.mapInArrow(_counted, f"{columns}, part int, place long"), "merkle-order")
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"))
    # One row per partition and group that meet: as few as there are partitions and groups.
    over = Window.partitionBy("grp")
    before = F.coalesce(F.sum("c").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("grp", "part", before.alias("start"), F.sum("c").over(over).alias("n")), "merkle-starts")
    joined = placed.join(sent_if_small(starts), ["grp", "part"])
    return joined.withColumn("i", F.col("start") + F.col("place")).drop("part", "place", "start")


# --- tiers ----------------------------------------------------------------------------------------


def _levels(count: int, tier: int) -> int:
    return max(0, min(LEVELS, depth(count) - LEVELS * tier))


def _block_maker(tier: int):
    """One row per block: its nodes in order and the digest above them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        raw = table.column("digest").to_pylist()
        count = table.column("n")[0].as_py()
        nodes = sweep_up([d.hex().encode() for d in raw], _levels(count, tier))
        row = {
            "grp": table.column("grp")[0].as_py(),
            "block": table.column("i")[0].as_py() // BRANCH**LEVELS,
            "n": count,
            "ids": table.column("id").to_pylist(),
            "digests": b"".join(raw),
            "changed": table.column("changed").to_pylist(),
            "root": bytes.fromhex(nodes[-1][0].decode()),
        }
        fields = [("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("digests", pa.binary())]
        return pa.Table.from_pylist([row], pa.schema([*fields, ("changed", pa.list_(pa.binary())), ("root", pa.binary())]))

    return run


def _tiers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every tier, and grp, root. ``nodes`` has grp, i, n, id, digest, changed."""
    tiers: list[DataFrame] = []
    while True:
        keyed = nodes.withColumn("block", F.floor(F.col("i") / BRANCH**LEVELS)).groupBy("grp", "block")
        tiers.append(written(keyed.applyInArrow(_block_maker(len(tiers)), _BLOCKS), "merkle-blocks"))
        if tiers[-1].where("block > 0").isEmpty():
            return tiers, tiers[-1].select("grp", "root")
        none = F.lit(None)
        nodes = tiers[-1].select(
            "grp", F.col("block").alias("i"), "n", F.col("block").alias("id"), F.col("root").alias("digest"), none.cast("binary").alias("changed")
        )


def _split(digests: bytes) -> list[bytes]:
    return [digests[k : k + 32].hex().encode() for k in range(0, len(digests), 32)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One block at a time as Python values; a batch may hold many."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _suffix_giver(tier: int):
    """(grp, block, suffix) of the blocks one tier below, from block rows with their own suffix."""
    kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                nodes = sweep_up(_split(row["digests"]), _levels(row["n"], tier))
                found = list(sweep_down(nodes, _chain(row["suffix"])))
                columns = [
                    pa.array([row["grp"]] * len(found), pa.string()),
                    pa.array([row["ids"][k] for k, _ in found], pa.int64()),
                    pa.array([_steps(chain) for _, chain in found], kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "block", "suffix"])

    return run


def _down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with ``suffix``, the proof of their top nodes. ``above`` has grp and suffix."""
    met = tiers[-1].join(sent_if_small(above), "grp")
    for tier in range(len(tiers) - 1, 0, -1):
        given = met.select("grp", "n", "ids", "digests", "suffix").mapInArrow(_suffix_giver(tier), f"grp string, block long, suffix {_SUFFIX}")
        met = tiers[tier - 1].join(written(given, "merkle-suffixes"), ["grp", "block"])
    return met


def _prover(with_proof: bool):
    names = ["id", "grp", "leaf", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                leaves = _split(row["digests"])
                nodes = sweep_up(leaves, _levels(row["n"], 0))
                out: list[list] = [[] for _ in range(6)]
                for k, chain in sweep_down(nodes, _chain(row["suffix"])):
                    steps = _steps(chain)
                    siblings = b"".join(part for s in steps for part in (s["before"], s["after"]))
                    other = row["changed"][k]
                    shown = leaves[k] if other is None else other.hex().encode()
                    values = row["ids"][k], row["grp"], leaves[k].decode(), hashlib.sha256(siblings).hexdigest(), fold(shown, steps).decode()
                    for column, value in zip(out, values):
                        column.append(value)
                    if with_proof:
                        out[5].append([(s["before"] + b" " + s["after"]).decode() for s in steps])
                arrays = [pa.array(out[0], pa.int64()), *[pa.array(c, pa.string()) for c in out[1:5]]]
                if with_proof:
                    arrays.append(pa.array(out[5], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "proof"][: len(arrays)])

    return run


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    presented: Mapping[str, Column] | None = None,
    with_proof: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``fields``. ``presented`` gives, for some fields, the value of the copy that
    is to be verified (by default the row itself): ``folded_root`` is recomputed from that copy's leaf and
    the stored siblings, and ``verified`` says whether it is the root. ``with_proof`` adds ``proof``: for
    each level the hex digests before and after, with a blank between.

    Null fields count as ``-``, unlike empty ones; texts of any length are hashed whole, in the JVM. Rows
    with a null group are a group of their own, which comes first. Within a group rows go by id, null
    ids first, and rows of one id by leaf, so equal rows have places next to each other and each has a
    proof of its own. A single row is its group's subroot, a single group's subroot the root; a row without
    any siblings has the digest of nothing as proof. An empty table gives an empty result. Other
    columns, whatever their names, are not read. Ids are whole numbers.
    """
    shown = [(presented or {}).get(c, F.col(c)) for c in fields]
    same = F.lit(True)
    for c in presented or {}:
        same = same & F.col(c).eqNullSafe(presented[c])
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        # Null first, then by bytes.
        F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("grp"),
        F.col(id_col).cast("long").alias("id"),
        F.unhex(digest([F.col(c) for c in fields])).alias("digest"),
        F.when(~same, F.unhex(digest(shown))).alias("changed"),
    )
    leaves = _numbered(written(leaves, "merkle-leaves"), "id", "digest")
    tiers, subroots = _tiers(leaves)
    none = F.lit(None).cast("binary").alias("changed")
    top = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.lit(0).cast("long").alias("id"), F.col("root").alias("digest"), none)
    top = written(_numbered(top, "name"), "merkle-top")
    upper, root = _tiers(top.withColumn("id", F.col("i")).drop("name"))
    whole = root.select(F.lower(F.hex("root"))).first()  # one row, none of an empty table
    starts = _down(upper, root.select("grp", F.array().cast(_SUFFIX).alias("suffix")))
    given = starts.select("grp", "n", "ids", "digests", "suffix").mapInArrow(_suffix_giver(0), f"grp string, block long, suffix {_SUFFIX}")
    # One row per group: its name, subroot and the proof of the subroot.
    groups = given.select(F.col("block").alias("i"), "suffix").join(top.select("i", F.col("name").alias("grp"), "digest"), "i")
    name = F.lit(whole[0] if whole else None).cast("string").alias("root")
    groups = written(groups.select("grp", "suffix", F.lower(F.hex("digest")).alias("subroot"), name), "merkle-groups")
    below = _down(tiers, groups.select("grp", "suffix")).select("grp", "n", "ids", "digests", "changed", "suffix")
    more = ", proof array<string>" if with_proof else ""
    rows = below.mapInArrow(_prover(with_proof), f"id long, grp string, leaf string, proof_sha256 string, folded_root string{more}")
    rows = rows.join(sent_if_small(groups.drop("suffix")), "grp")
    columns = [F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]
    return rows.select(*columns, *(["proof"] if with_proof else []))
