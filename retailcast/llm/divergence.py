"""How the words of a source differ from those of the other sources of its language, in exact integers.

Terms are counted inside tasks by length-bucketed packing: a term of up to eight bytes becomes one 64-bit
word and one of up to sixteen two; each length is a bucket, which is radix-sorted by 16-bit digits and
counted by runs, numpy over whole buffers. Longer terms are sorted as bytes in a bucket of their own. Spark
adds the runs of all tasks up, keeps the terms that enough documents hold, and compares sources in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import sent_if_small, text_or_empty, written

# Fixed values of the measure.
SCALE = 1_000_000_000
PRIOR = 5

_COUNTED = "lang string, source string, term string, n long, docs long"


@dataclass(frozen=True)
class Settings:
    min_docs: int = 30  # documents of its language that hold a kept term, at least
    top_terms: int = 50  # ranks of part `term`
    buffer_bytes: int = 8 << 20  # text that is counted at once; a longer text is a buffer of its own
    block_terms: int = 2048  # terms, and sources, that are compared at once
    block_sources: int = 256


# --- counting in a buffer -------------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint8)
    upper = (codes >= 65) & (codes <= 90)
    lowered = np.where(upper, codes + 32, codes).astype(np.uint8)
    return lowered, upper | ((codes >= 97) & (codes <= 122)) | (codes >= 128)


_LOWERED, _IN_TERM = _tables()


def radix_order(words: np.ndarray, size: int) -> np.ndarray:
    """Stable order of packed terms of ``size`` bytes, one row of 64-bit words each, by passes over 16-bit
    digits from the last to the first."""
    order = np.arange(len(words))
    for digit in reversed(range((size + 1) // 2)):
        keys = words[:, digit // 4] >> np.uint64(48 - 16 * (digit % 4))
        # A stable argsort of 16-bit integers is numpy's radix sort.
        order = order[np.argsort(keys.astype(np.uint16)[order], kind="stable")]
    return order


def packed(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of ``size`` bytes, as bytes padded with zeros and as one or two big-endian 64-bit words."""
    wide = 8 if size <= 8 else 16
    raw = np.zeros((len(starts), wide), dtype=np.uint8)
    for k in range(size):
        raw[:, k] = data[starts + k]
    return raw, raw.view(">u8").astype(np.uint64)


def _runs(new_term: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and number of documents of each run of one term in one group; terms are in order,
    within a term documents, and documents are ordered by group."""
    new_run = new_term.copy()
    new_run[1:] |= groups[1:] != groups[:-1]
    new_doc = new_run.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    begins = np.flatnonzero(new_run)
    return begins, np.diff(np.r_[begins, len(docs)]), np.add.reduceat(new_doc.astype(np.int64), begins)


def _long_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Byte-sorted long terms, their order, and where a term differs from the one before."""
    terms = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    order = np.array(sorted(range(len(terms)), key=terms.__getitem__), dtype=np.int64)
    terms = [terms[i] for i in order]
    new = np.array([True] + [a != b for a, b in zip(terms, terms[1:])])
    return terms, order, new


def count_terms(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[list[bytes] | np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, documents) per bucket; ``groups`` ascends with the texts."""
    data = _LOWERED[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[1:] = _IN_TERM[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    sizes = ends - starts
    edges = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(edges, starts, side="right")
    for size in range(1, 17):
        of = np.flatnonzero(sizes == size)
        if not len(of):
            continue
        raw, words = packed(data, starts[of], size)
        order = radix_order(words, size)
        words, docs = words[order], owner[of][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        begins, counts, holders = _runs(new, docs, groups[docs])
        terms = np.ascontiguousarray(raw[order[begins], :size]).view(f"S{size}").ravel()
        yield terms, groups[docs[begins]], counts, holders
    of = np.flatnonzero(sizes > 16)
    if len(of):
        terms, order, new = _long_terms(data, starts[of], ends[of])
        docs = owner[of][order]
        begins, counts, holders = _runs(new, docs, groups[docs])
        yield [terms[b] for b in begins], groups[docs[begins]], counts, holders


def _counted(settings: Settings):
    """Occurrences and documents of each term per language and source, buffer by buffer."""

    def emit(rows: list[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[:2])
        names = sorted({r[:2] for r in rows})
        number = {name: i for i, name in enumerate(names)}
        groups = np.array([number[r[:2]] for r in rows], dtype=np.int64)
        langs, sources = (pa.array([n[k] for n in names], pa.string()) for k in (0, 1))
        for terms, group, counts, holders in count_terms([r[2] for r in rows], groups):
            at = pa.array(group)
            columns = [langs.take(at), sources.take(at), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(holders, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, bytes]] = []
        held = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                if rows and held + len(text) > settings.buffer_bytes:
                    yield from emit(rows)
                    rows, held = [], 0
                rows.append((lang, source, text))
                held += len(text) + 1
        if rows:
            yield from emit(rows)

    return run


# --- comparing ------------------------------------------------------------------------------------


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), by integer division; null without terms."""
    top = F.lit(SCALE).cast("decimal(20,0)") * (count + PRIOR).cast("decimal(18,0)")
    bottom = F.nullif(total + PRIOR * terms, F.lit(0)).cast("decimal(38,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), bottom) + 1


def _block_sums(settings: Settings):
    """Sums of |p - q| over the terms of one block, for the source pairs of two blocks of sources."""

    def run(sources: pa.Table, rows: pa.Table) -> pa.Table:
        number = np.array(sources.column("number").to_pylist(), dtype=np.int64)
        rest = np.array(sources.column("rest").to_pylist(), dtype=np.int64)
        side = np.array(sources.column("sblock").to_pylist(), dtype=np.int64)
        order = np.argsort(number)
        number, rest, side = number[order], rest[order], side[order]
        terms, column = np.unique(np.array(rows.column("term").to_pylist(), dtype=object), return_inverse=True)
        shares = np.repeat(rest[:, None], len(terms), axis=1)
        if len(terms):
            at = np.searchsorted(number, np.array(rows.column("number").to_pylist(), dtype=np.int64))
            shares[at, column] = np.array(rows.column("p").to_pylist(), dtype=np.int64)
        absent = sources.column("block_terms")[0].as_py() - len(terms)
        left, right = (np.flatnonzero(side == b) for b in (side.min(), side.max()))
        a, b, sums = [], [], []
        for i in left:
            others = right[right > i]
            sums.append(np.abs(shares[others] - shares[i]).sum(axis=1) + absent * np.abs(rest[others] - rest[i]))
            a.append(np.full(len(others), number[i]))
            b.append(number[others])
        lang = sources.column("lang")[0].as_py()
        columns = [np.concatenate(c).astype(np.int64) for c in (a, b, sums)]
        return pa.table({"lang": pa.array([lang] * len(columns[0]), pa.string()), "a": columns[0], "b": columns[1], "value": columns[2]})

    return run


def _pairs(groups: DataFrame, counts: DataFrame, kept: DataFrame, settings: Settings) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language."""
    # A term's block within its language; a language without kept terms has one empty block.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / settings.block_terms)).cast("long")
    langs = groups.select("lang", blocks.alias("blocks"), F.ceil(F.col("n_sources") / settings.block_sources).cast("long").alias("sblocks")).distinct()
    tblock = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("tblock")
    sizes = kept.join(sent_if_small(langs), "lang").groupBy("lang", tblock).agg(F.count(F.lit(1)).alias("block_terms"))
    sblock = F.floor(F.col("number") / settings.block_sources)

    def dealt(df: DataFrame) -> DataFrame:
        """Rows of a block of sources go to every pair of blocks that it belongs to."""
        other = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sblocks") - 1)))
        return other.withColumns({"lower": F.least("sblock", "other"), "upper": F.greatest("sblock", "other")})

    keys = ["lang", "tblock", "lower", "upper"]
    numbered = groups.select("lang", "source", "number", "rest", sblock.alias("sblock"))
    each = numbered.join(langs, "lang").withColumn("tblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sources = dealt(each.join(sent_if_small(sizes), ["lang", "tblock"], "left").fillna(0, ["block_terms"]))
    present = counts.select("lang", "source", "term", "p").join(sent_if_small(numbered.drop("rest")), ["lang", "source"])
    rows = dealt(present.join(sent_if_small(langs), "lang").withColumn("tblock", tblock))
    sums = (
        sources.select(*keys, "number", "rest", "sblock", "block_terms").groupBy(*keys)
        .cogroup(rows.select(*keys, "number", "term", "p").groupBy(*keys))
        .applyInArrow(_block_sums(settings), "lang string, a long, b long, value long")
    )
    sums = written(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "source-pairs")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = sent_if_small(numbered.select("lang", "number", "source"))
    first = both.join(names.select("lang", F.col("number").alias("a"), "source"), ["lang", "a"])
    return first.join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", "item", "value")


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", settings: Settings = Settings()
) -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every source of every language.

    Part ``pair`` gives each other source of the language with the summed difference of the shares of all
    kept terms; part ``term`` the kept terms by which the source stands out most from its language. Shares
    are scaled to whole numbers, and all sums are exact.

    Null texts, languages and sources count as empty. A text without terms still makes its source occur; a
    language without kept terms has pairs of value 0 and no terms; a single source has no pairs. Texts of
    any length are read whole. Repeated rows count each. Equal values are ranked by item in
    byte order. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    narrow = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    counted = written(narrow.mapInArrow(_counted(settings), _COUNTED), "term-runs")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = written(kept.where(F.col("docs") >= settings.min_docs).select("lang", "term", "lang_n"), "kept-terms")
    # Kept terms of a source; a term of a language has at most one row per source here.
    runs = counted.select("lang", "source", "term", "n").join(sent_if_small(kept.drop("lang_n")), ["lang", "term"])
    counts = runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = written(counts.join(sent_if_small(kept), ["lang", "term"]), "kept-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = narrow.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
    # One row per source of a language.
    within = Window.partitionBy("lang")
    groups = groups.withColumns({
        "number": (F.row_number().over(within.orderBy("source")) - 1).cast("long"),
        "n_sources": F.count(F.lit(1)).over(within),
        "rest": F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)),
    })
    groups = written(groups, "sources")
    measured = counts.join(sent_if_small(groups.select("lang", "source", "total", "terms", "lang_total")), ["lang", "source"])
    counts = measured.withColumns({
        "p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")),
    })
    pairs = _pairs(groups, counts, kept, settings).withColumn("part", F.lit("pair"))
    terms = counts.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= settings.top_terms)).select("lang", "source", "part", "item", "value", "rank")
