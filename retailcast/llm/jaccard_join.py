"""Similarity join of texts on word shingles by chosen paths.

Each run sends every text down a path: at each step the text is put into the bucket of one sampled
token of its shingle set (the shingle with the least value of a hash function, so that two texts
share it with a probability equal to their Jaccard similarity). Buckets above a limit are split again
by the next token; small ones, and those still large at the last step, are compared in blocks. Runs
are repeated as often as the target recall needs. Candidates are verified with the whole sets.

A pair is handled in the first run in which its paths end in one bucket, so links can be counted
where they are found, and no pair is ever written out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import join_by_group, maybe_among, text_or_empty
from retailcast.llm.words import SHINGLE, mixed, shingle_sets
from retailcast.session import materialize

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    """similarity: least Jaccard similarity of a link; words: words of a shingle; steps: longest path;
    recall: of pairs just at the threshold and on the longest path; limit: texts of a bucket that are
    compared without another split, and of a block."""

    similarity: float = 0.8
    words: int = SHINGLE
    steps: int = 4
    recall: float = 0.998
    limit: int = 256

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold is missed with a probability of 1 - recall."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity**self.steps))

    @property
    def tokens(self) -> int:
        return self.runs * self.steps

    @property
    def cut(self) -> float:
        """Share of equal tokens below which a pair is not verified: four standard deviations under
        the threshold."""
        return self.similarity - 4 * math.sqrt(self.similarity * (1 - self.similarity) / self.tokens)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def sampled_tokens(shingles: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` hash functions over a set, 32 bits each."""
    times, plus = _functions(count)
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        least = np.minimum(least, (part[None, :] * times[:, None] + plus[:, None]).min(axis=1))
    return (mixed(least) >> np.uint64(32)).astype("<u4")


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _key(text: bytes) -> bytes:
    """Digest of the word sequence."""
    return hashlib.blake2b(b" ".join(_WORDS.findall(text.lower())), digest_size=16).digest()


def _name(doc_id: int, key: bytes) -> bytes:
    """The name of a distinct text under an id: both, so that names are ordered by id first."""
    return (doc_id + (1 << 63)).to_bytes(8, "big") + key


def id_of(name: Column) -> Column:
    """The id in a name."""
    high = F.conv(F.hex(F.substring(name, 1, 4)), 16, 10).cast("long") - (1 << 31)
    return high * (1 << 32) + F.conv(F.hex(F.substring(name, 5, 4)), 16, 10).cast("long")


def _signed(settings: Settings):
    """doc_id, key of the word sequence (null without words), its name, digest of the text, sampled tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _bytes(batch.column(1))
            keys, tokens = [], []
            for text, shingles in zip(texts, shingle_sets(texts, settings.words)):
                if len(shingles):
                    keys.append(_key(text))
                    tokens.append(sampled_tokens(shingles, settings.tokens).tobytes())
                else:
                    keys.append(None)
                    tokens.append(None)
            names = pa.array([None if k is None else _name(i, k) for i, k in zip(ids, keys)], pa.binary())
            columns = [batch.column(0), pa.array(keys, pa.binary()), names, batch.column(2), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "rid", "digest", "tokens"])

    return run


def _token(tokens: Column, at: Column) -> Column:
    """The ``at``-th 32-bit token of a binary column, as a hex string."""
    return F.hex(F.substring(tokens, at * 4 + 1, F.lit(4)))


def _paths(texts: DataFrame, settings: Settings) -> DataFrame:
    """rid, run, path, size: the buckets of at least two texts in which the paths end."""
    run = F.explode(F.sequence(F.lit(0), F.lit(settings.runs - 1))).alias("run")
    total = texts.count() * settings.runs
    rows = texts.select("rid", run, "tokens")
    first = F.col("run") * settings.steps
    rest = F.substring(F.col("tokens"), (first + 1) * 4 + 1, F.lit((settings.steps - 1) * 4))
    rows = rows.select("rid", "run", F.xxhash64("run", _token(F.col("tokens"), first)).alias("path"), rest.alias("rest"))
    ended = []
    for step in range(1, settings.steps + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        # The path of a large group of near copies is not gathered into one task to learn its size.
        met = materialize(join_by_group(rows, materialize(sizes, "path-sizes"), "path", "size", total), "paths")
        large = F.col("size") > settings.limit
        ended.append((met if step == settings.steps else met.where(~large)).select("rid", "run", "path", "size"))
        if step == settings.steps or met.where(large).isEmpty():
            break
        again = F.xxhash64("path", _token(F.col("rest"), F.lit(step - 1)))
        rows = met.where(large).select("rid", "run", again.alias("path"), "rest")
    result = ended[0]
    for other in ended[1:]:
        result = result.unionByName(other)
    return result


def _blocks(members: DataFrame, settings: Settings, *carried: str) -> DataFrame:
    """A row for each block pair that a text takes part in. ``bucket`` names the block pair, ``side``
    is 0 or 1 between different blocks and 2 within one."""
    count = F.ceil(F.col("size") / settings.limit).cast("int")
    own = members.withColumn("count", count).withColumn("own", F.pmod(F.xxhash64("rid", "path"), F.col("count")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    bucket = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select(bucket.alias("bucket"), side.alias("side"), "run", "rid", *carried)


class _Group:
    """The texts of one block pair."""

    def __init__(self, rows: list[tuple], settings: Settings, runs: int) -> None:
        rows.sort(key=lambda r: (r[1], r[2]))
        self.side = np.array([r[1] for r in rows])
        self.rid = [r[2] for r in rows]
        self.run = rows[0][0]
        self.tokens = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u4").reshape(len(rows), -1)
        self.paths = np.frombuffer(b"".join(r[4] for r in rows), dtype="<i8").reshape(len(rows), runs)
        self.cut = settings.cut * settings.tokens

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row numbers, a < b, that are similar by their tokens and meet in no earlier run."""
        within = self.side[0] == 2
        left = np.arange(len(self.rid)) if within else np.flatnonzero(self.side == 0)
        right = left if within else np.flatnonzero(self.side == 1)
        a_parts, b_parts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(left), 128):
            part = left[i : i + 128]
            if len(right) <= 64:
                equal = (self.tokens[part][:, None, :] == self.tokens[right][None, :, :]).sum(axis=2)
            else:
                equal = np.zeros((len(part), len(right)), dtype=np.uint8)
                for t in range(self.tokens.shape[1]):
                    equal += self.tokens[part, t][:, None] == self.tokens[right, t][None, :]
            near = equal >= self.cut
            if within:
                near &= part[:, None] < right[None, :]
            a, b = np.nonzero(near)
            a, b = part[a], right[b]
            first = np.ones(len(a), dtype=bool)
            for r in range(self.run):
                first &= (self.paths[a, r] != self.paths[b, r]) | (self.paths[a, r] == 0)
            a_parts.append(a[first])
            b_parts.append(b[first])
        return np.concatenate(a_parts), np.concatenate(b_parts)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (run, side, rid, tokens, paths, ...) of one bucket after the other; sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for key, *row in zip(*columns):
            if key != bucket:
                if len(rows) > 1:
                    yield rows
                bucket, rows = key, []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield rows


def _active(settings: Settings):
    """Rows of the texts that have a candidate in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in _grouped((b.select(["bucket", "run", "side", "rid", "tokens", "paths"]) for b in batches)):
            keys = rows
            group = _Group(keys, settings, settings.runs)
            a, b = group.candidates()
            if len(a):
                # path and size are not needed again: bucket and side are kept by rid and run
                out += [(group.rid[i], group.run, int(group.side[i])) for i in np.unique(np.r_[a, b])]
            if len(out) >= 50_000:
                yield _batch(out, ("rid", "run", "side"), (pa.binary(), pa.int32(), pa.int32()))
                out = []
        if out:
            yield _batch(out, ("rid", "run", "side"), (pa.binary(), pa.int32(), pa.int32()))

    return run


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b), by products of blocks of the incidence matrix of
    those shingles that stand in at least two sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, row_of_a = np.unique(a, return_inverse=True)
    cols, col_of_b = np.unique(b, return_inverse=True)
    total = np.zeros((len(rows), len(cols)), dtype=np.float32)
    width = int(shared.sum())
    for low in range(0, width, 4096):
        high = min(low + 4096, width)
        i, j = np.searchsorted(column, [low, high])
        matrix = np.zeros((len(sets), high - low), dtype=np.float32)
        matrix[owner[i:j], column[i:j] - low] = 1
        total += matrix[rows] @ matrix[cols].T
    return total[row_of_a, col_of_b].astype(np.int64)


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row number of each row's component."""
    root = np.arange(size)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(settings: Settings):
    """rid of a text, links found here, least rid of its component here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("rid", "links", "root"), (pa.binary(), pa.int64(), pa.binary())
        out: list[tuple[bytes, int, bytes]] = []
        for rows in _grouped((b.select(["bucket", "run", "side", "rid", "tokens", "paths", "shingles"]) for b in batches)):
            group = _Group(rows, settings, settings.runs)
            sets = [np.frombuffer(r[5], dtype="<u8") for r in rows]  # _Group has put the rows in order
            a, b = group.candidates()
            if not len(a):
                continue
            sizes = np.array([len(s) for s in sets])
            shared = common_counts(sets, a, b)
            linked = shared >= settings.similarity * (sizes[a] + sizes[b] - shared) - 1e-9
            a, b = a[linked], b[linked]
            order = np.array(sorted(range(len(rows)), key=group.rid.__getitem__))
            place = np.argsort(order, kind="stable")
            root = order[local_roots(len(rows), place[a], place[b])][place]
            links = np.bincount(np.r_[a, b], minlength=len(rows))
            out += [(group.rid[i], int(links[i]), group.rid[root[i]]) for i in np.flatnonzero(links)]
            if len(out) >= 50_000:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)

    return run


def _shingled(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _bytes(batch.column(1))
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(texts, settings.words)]
            names = pa.array([_name(i, _key(t)) for i, t in zip(ids, texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.array(sets, pa.binary())], ["rid", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): the least node of its component.

    Small-star and large-star steps in turn: every node's neighbours are linked to the least of them
    until all edges lead to roots. Frames only; a node with very many edges is combined before the
    shuffle, and its edges are spread by the adaptive join.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "n")
        links = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(links.where("a <> b").distinct(), "large-star")
        least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        met = links.join(least, links["a"] == least["n"])
        links = met.select("b", "m").where("b <> m").unionByName(least.select(F.col("n").alias("b"), "m")).distinct()
        links = materialize(links.select(F.col("b").alias("a"), F.col("m").alias("b")), "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _links(texts: DataFrame, bodies: DataFrame, settings: Settings) -> DataFrame:
    """rid, links, root, possibly several rows per rid. ``texts`` has rid, id and tokens of every distinct
    text, ``bodies`` doc_id and text; several texts may have one id."""
    ends = _paths(texts, settings)
    own = ends.groupBy("rid").agg(F.collect_list(F.struct("run", "path", "size")).alias("ends"))
    members = materialize(own.join(texts, "rid"), "path-ends")
    in_run = F.map_from_entries(F.transform("ends", lambda e: F.struct(e["run"], e["path"])))
    as_bytes = lambda run: F.unhex(F.lpad(F.hex(F.coalesce(F.element_at("by_run", run), F.lit(0).cast("long"))), 16, "0"))
    paths = F.concat(*[as_bytes(F.lit(r)) for r in range(settings.runs)])
    members = members.withColumn("by_run", in_run).withColumn("paths", paths).drop("by_run")
    rows = members.select("rid", "tokens", "paths", F.explode("ends").alias("e")).select("rid", "tokens", "paths", "e.run", "e.path", "e.size")
    sized = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    blocks = _blocks(rows, settings, "tokens", "paths")
    active = sized(blocks).mapInArrow(_active(settings), "rid binary, run int, side int").select("rid", "run").distinct()
    active = materialize(active, "candidates")
    ids = texts.join(active.select("rid").distinct(), "rid", "left_semi").select("id").distinct()
    ids = materialize(ids, "candidate-ids")
    # Most texts have no candidate and stay where they are read.
    chosen = maybe_among(bodies, "doc_id", ids).join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    # Rows of one id and text give one set; other texts of a chosen id join with nothing.
    sets = chosen.select("doc_id", "text").mapInArrow(_shingled(settings), "rid binary, shingles binary").dropDuplicates(["rid"])
    again = rows.join(active, ["rid", "run"]).join(sets, "rid")
    return sized(_blocks(again, settings, "tokens", "paths", "shingles")).mapInArrow(_verified(settings), "rid binary, links long, root binary")


def _classes(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """doc_id, digest, copy_of, class_id, n_links for every row with an id; ``digest`` tells its text."""
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), digest.alias("digest"))
    narrow = narrow.where("doc_id IS NOT NULL")
    signed = materialize(narrow.mapInArrow(_signed(settings), "doc_id long, key binary, rid binary, digest binary, tokens binary"), "signed")
    groups = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups, "texts")
    total = signed.count()
    texts = signed.join(groups.select("rid"), "rid", "left_semi").dropDuplicates(["rid"]).select("rid", F.col("doc_id").alias("id"), "tokens")
    texts = materialize(texts, "tokens")
    found = materialize(_links(texts, narrow.select("doc_id", "text"), settings), "link-counts")
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("n_links")).withColumnRenamed("rid", "r")
    met = groups.join(counts, F.col("rid") == F.col("r"), "left").join(roots, F.col("rid") == F.col("node"), "left")
    reps = met.select(
        "key", "copies", id_of(F.col("rid")).alias("copy_of"), id_of(F.coalesce("root", "rid")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    reps = materialize(reps, "classes")
    columns = ["doc_id", "digest", "copy_of", "class_id", "n_links"]
    worded = join_by_group(signed.where("key IS NOT NULL").select("doc_id", "digest", "key"), reps, "key", "copies", total).select(*columns)
    none = F.lit(0).cast("long").alias("n_links")
    empty = signed.where("key IS NULL").select("doc_id", "digest", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), none)
    return worded.unionByName(empty)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_of, class_id, n_links.

    Texts with the same sequence of words are copies: ``copy_of`` is the smallest id among them, and
    only that one is compared. ``n_links`` counts the other different texts whose sets of shingles
    have a Jaccard similarity of at least the threshold; ``class_id`` is the smallest id of all texts
    that links connect. Words are runs of ASCII digits and letters (in lower case) and non-ASCII
    characters; a text with fewer words than a shingle is one shingle. Texts without words, null ones
    among them, link to nothing and are a class each, even if they are equal. A row without an id takes
    no part and has null classes and no links. An id on several rows stands for all their texts, and each
    row has its own text's links and class; classes that begin at texts of one id share its number.
    Texts of any length are read whole. An empty table gives an empty result. Other columns, whatever
    their names, are not read. Ids are whole numbers. Texts are told apart inside by 128 bits of a
    digest of their words.
    """
    columns = ["doc_id", "copy_of", "class_id", "n_links"]
    number = F.col(id_col).cast("long")
    nameless = docs.where(number.isNull()).select(number.alias("doc_id"), number.alias("copy_of"), number.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return _classes(docs, id_col, text_col, settings).select(*columns).unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their text's class, all their columns as they were.

    Each row is judged by its own text, also where an id stands on several: a row goes if its text is a
    copy, or a near copy, of one with a smaller id, and no other row of its id goes with it. Rows without
    an id, and texts without words, stay; so do repeated rows, and near copies that share the class's
    smallest id. Texts of any length are whole, an empty table stays empty, and columns of any
    name stay as they are.
    """
    classes = _classes(docs, id_col, text_col, settings)
    gone = classes.where("class_id <> doc_id").select("doc_id", "digest").distinct()
    # The names of the other side are free of the columns of docs.
    own = docs.alias("own")
    names = [f"own.`{c}`" for c in docs.columns]
    same = (F.col(f"own.`{id_col}`").cast("long") == F.col("gone.doc_id")) & (F.unhex(F.sha2(F.coalesce(F.col(f"own.`{text_col}`"), F.lit("")), 256)) == F.col("gone.digest"))
    return own.join(gone.alias("gone"), same, "left_anti").select(*names)
