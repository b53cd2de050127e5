"""Repeated passages: bytes covered by a 50-byte string that also starts in an earlier document.

Every 50-byte window is assigned to an anchor, its least 20-byte gram by hash, so that equal windows
have equal anchors. Consecutive windows with one anchor make a stretch. Three steps find repeats:

1. All stretches (anchor, hash of the stretch) of all documents meet by anchor. Stretches that an
   earlier document holds as a whole are removed by this alone; anchors with several different
   stretches in several documents are open.
2. The documents give the bytes of the open stretches, one document for each stretch.
3. Open stretches that share an anchor stand in one suffix array, built in two stages: suffixes that
   are smaller than their successors are sorted directly, all others are induced from them bucket by
   bucket. Neighbours with a common prefix of 50 bytes are equal windows.

Anchors that very many documents hold would meet in one task. Those are known from a bounded sample.
Tasks reduce their stretches, and then their windows, to one document for each different one (all
later documents of the task lose them at once), and the windows meet by their own hashes. Which
anchors count as such never changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import partitions, text_or_empty, written
from retailcast.llm.words import BASE, INVERSE, buffers, mixed, powers

WINDOW = 50
GRAM = 20
REACH = WINDOW - GRAM + 1  # grams in a window
SAMPLE_DOCS = 16_384  # bound of the sample that tells frequent anchors
FREQUENT_DOCS = 16  # documents of the sample from which an anchor is frequent
PIECE = 1 << 20  # bytes that one suffix array holds, unless a single anchor has more
SENT_TEXT = 8 << 20  # bytes of text whose stretches are sent together
MIDDLE = 15  # bytes of a window before its anchor: at least so many, or at most

REMOVED, OPEN = 1, 2


@dataclass
class Stretches:
    """The stretches of some texts, and the texts themselves one after the other."""

    data: np.ndarray
    text: np.ndarray  # number of the text
    anchor: np.ndarray
    hash: np.ndarray
    start: np.ndarray  # first window in ``data``
    windows: np.ndarray
    edges: np.ndarray  # where each text begins in ``data``
    # One byte of a hash of what all windows with at least (left) or at most (right) MIDDLE bytes before
    # the anchor cover; 0 if the stretch has no such window. Two stretches of an anchor can share a
    # window only if they agree in one of them.
    left: np.ndarray
    right: np.ndarray


def _least_of_windows(keys: np.ndarray) -> np.ndarray:
    """The least of each REACH = 31 consecutive keys."""
    least = keys
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    return np.minimum(least[: -(REACH - 16)], least[REACH - 16 :])


def stretches(texts: list[bytes]) -> Stretches:
    """Texts that fit a buffer, cut into stretches of windows with one anchor."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    edges = np.cumsum([0] + [len(t) for t in texts])
    none = np.zeros(0, dtype=np.int64)
    if len(data) < WINDOW:
        unsigned, bytes_ = none.astype(np.uint64), none.astype(np.uint8)
        return Stretches(data, none, unsigned, unsigned, none, none, edges, bytes_, bytes_)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    back = powers(INVERSE, len(data) + 1)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: len(sums) - GRAM])
    places = np.arange(len(grams), dtype=np.uint64)
    least = _least_of_windows((grams & np.uint64(0xFFFFFFFF00000000)) | places)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(edges, np.arange(len(at)), side="right") - 1
    inside = np.arange(len(at)) + WINDOW <= edges[owner + 1]
    begins = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])] & inside
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True]) + 1
    anchor, end = at[start], stops + WINDOW - 1
    whole = mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))

    def side(begin: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
        begin = np.where(there, begin, 0)
        print_ = mixed((sums[np.minimum(begin + size, len(data))] - sums[begin]) * back[begin])
        return np.where(there, (print_ % np.uint64(255)).astype(np.uint8) + np.uint8(1), 0).astype(np.uint8)

    left = side(anchor - MIDDLE, MIDDLE + GRAM, start <= anchor - MIDDLE)
    right = side(anchor, WINDOW - MIDDLE, stops - 1 >= anchor - MIDDLE)
    return Stretches(data, owner[start], grams[anchor], whole, start, stops - start, edges, left, right)


def _window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of windows; they never equal those of stretches but by chance."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    low, high = int(starts.min()), int(starts.max()) + WINDOW
    part = data[low:high]
    sums = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
    at = starts - low
    return mixed(mixed((sums[at + WINDOW] - sums[at]) * powers(INVERSE, len(part) + 1)[at]) ^ np.uint64(0x5851F42D4C957F2D))


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal keys."""
    if len(sorted_keys):
        edges = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1], True])
        yield from zip(edges[:-1].tolist(), edges[1:].tolist())


# ---- Frequent anchors -------------------------------------------------------------------------------


def _sample_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in buffers(texts):
            found = stretches(texts[a:b])
            pairs = np.unique(np.stack([found.text.astype(np.uint64), found.anchor], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].astype(np.int64))], ["anchor"])


def frequent_anchors(docs: DataFrame, rows: int) -> np.ndarray:
    """Sorted anchors that at least FREQUENT_DOCS of about SAMPLE_DOCS documents hold; at most as many
    as the sample has stretches / FREQUENT_DOCS."""
    every = max(1, -(-rows // SAMPLE_DOCS))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0).limit(2 * SAMPLE_DOCS)
    counts = sample.select("doc_id", "text").mapInArrow(_sample_anchors, "anchor long").groupBy("anchor").count()
    found = counts.where(F.col("count") >= FREQUENT_DOCS).select("anchor").toPandas()["anchor"]
    return np.sort(found.to_numpy(dtype=np.int64).astype(np.uint64))


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


# ---- Step 1: stretches meet by anchor ---------------------------------------------------------------

# What is sent: documents of a batch with the number of their stretches, then the stretches in the same
# order. Six bytes of an anchor are enough (if two anchors look alike, more is open than need be).
_ENTRY = np.dtype([("anchor", "<u4"), ("more", "<u2"), ("hash", "<u8"), ("left", "u1"), ("right", "u1")])
_OWNER = np.dtype([("doc", "<i8"), ("count", "<u4")])


def _expanded(found: Stretches, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of the stretches ``which``, and the stretch of each."""
    counts = found.windows[which]
    starts = np.repeat(found.start[which] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(int(counts.sum()))
    return starts, np.repeat(which, counts)


def _later(doc: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether a smaller document stands beside the same hash."""
    order = np.lexsort((doc, whole))
    new = np.r_[True, whole[order][1:] != whole[order][:-1]] if len(order) else np.zeros(0, dtype=bool)
    least = np.empty_like(doc)
    least[order] = doc[order][new][np.cumsum(new) - 1] if len(order) else doc
    return doc > least


def _frequent_windows(found: Stretches, doc: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and hashes of the windows of frequent anchors, and what is already removed."""
    gone = _later(doc[often], found.hash[often])
    told = _records(_STATUS, doc[often][gone], found.hash[often][gone], REMOVED)
    starts, stretch = _expanded(found, often[~gone])
    return doc[stretch], _window_hashes(found.data, starts), told


def _sent_stretches(buckets: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in buffers(texts, SENT_TEXT):
                yield _payloads(_sent(docs[a:b], texts[a:b], buckets, frequent.value), ("bucket", "owners", "entries", "told"))

    return run


def _sent(docs: np.ndarray, texts: list[bytes], buckets: int, frequent: np.ndarray) -> list[tuple]:
    kept, windows, told = [], [], []
    for a, b in buffers(texts):
        found = stretches(texts[a:b])
        doc, often = docs[a + found.text], _is_in(found.anchor, frequent)
        kept.append([c[~often] for c in (doc, found.anchor, found.hash, found.left, found.right)])
        *own, known = _frequent_windows(found, doc, np.flatnonzero(often))
        windows.append(own)
        told.append(known)
    doc, whole = (np.concatenate(c) for c in zip(*windows))
    gone = _later(doc, whole)
    told.append(_records(_STATUS, doc[gone], whole[gone], REMOVED))
    # A window meets its like by its own hash, as if it were its anchor.
    none = np.zeros(int((~gone).sum()), dtype=np.uint8)
    kept.append([doc[~gone], mixed(whole[~gone]), whole[~gone], none, none])
    doc, anchor, whole, left, right = (np.concatenate(c) for c in zip(*kept))
    bucket = (anchor % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    doc, bucket, anchor = doc[order], bucket[order], anchor[order]
    more = (anchor >> np.uint64(16)) & np.uint64(0xFFFF)
    entries = _records(_ENTRY, anchor >> np.uint64(32), more, whole[order], left[order], right[order])
    rows = []
    for a, b in _cuts(bucket):
        owner, count = np.unique(doc[a:b], return_counts=True)
        rows.append((int(bucket[a]), _records(_OWNER, owner, count).tobytes(), entries[a:b].tobytes(), None))
    known = np.unique(np.concatenate(told))
    at = np.mod(known["doc"], buckets)
    order = np.argsort(at, kind="stable")
    return rows + [(int(at[order[a]]), None, None, known[order[a:b]].tobytes()) for a, b in _cuts(at[order])]


def _payloads(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def _joined(table: pa.Table, column: str, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).drop_null().to_pylist()), dtype=dtype)


_STATUS = np.dtype([("doc", "<i8"), ("hash", "<u8"), ("status", "u1")])


def _judged(blocks: int):
    """For every document with a shared anchor: which of its stretches are removed or open."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        owners, entries = _joined(table, "owners", _OWNER), _joined(table, "entries", _ENTRY)
        doc = np.repeat(owners["doc"], owners["count"])
        if not len(doc):
            return _by_block(np.unique(_joined(table, "told", _STATUS)), blocks)
        anchor = (entries["anchor"].astype(np.uint64) << np.uint64(16)) | entries["more"]
        order = np.lexsort((doc, entries["hash"], anchor))
        doc, anchor, whole = doc[order], anchor[order], entries["hash"][order]
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        new_whole = new_anchor | np.r_[True, whole[1:] != whole[:-1]]
        of_whole = np.cumsum(new_whole) - 1
        first_doc = doc[new_whole][of_whole]
        status = np.where(doc != first_doc, REMOVED, 0).astype(np.uint8)
        # Anchors with several stretches; of these, the stretches that may share a window with another.
        of_anchor = np.cumsum(new_anchor) - 1
        kinds = np.add.reduceat(new_whole.astype(np.int64), np.flatnonzero(new_anchor))
        near = np.flatnonzero((kinds > 1)[of_anchor])
        for side in ("left", "right"):
            value = entries[side][order[near]]
            own = near[value > 0]
            alike = _in_several(anchor[own], value[value > 0], whole[own], doc[own])
            status[own[alike & (status[own] == 0)]] = OPEN
        told = status > 0
        out = _records(_STATUS, doc[told], whole[told], status[told])
        return _by_block(np.unique(np.concatenate([out, _joined(table, "told", _STATUS)])), blocks)

    return run


def _in_several(anchor: np.ndarray, value: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether rows with the same anchor and value are of several stretches and several documents."""
    out = np.zeros(len(anchor), dtype=bool)
    if len(anchor):
        by = np.lexsort((value, anchor))
        starts = np.flatnonzero(np.r_[True, (anchor[by][1:] != anchor[by][:-1]) | (value[by][1:] != value[by][:-1])])
        differ = lambda c: np.minimum.reduceat(c[by], starts) != np.maximum.reduceat(c[by], starts)
        out[by] = np.repeat(differ(whole) & differ(doc), np.diff(np.r_[starts, len(by)]))
    return out


def _records(dtype: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), dtype=dtype)
    for name, values in zip(dtype.names, columns):
        out[name] = values  # a scalar stands for all rows
    return out


def _by_block(records: np.ndarray, blocks: int) -> pa.Table:
    block = np.mod(records["doc"], blocks)
    order = np.argsort(block, kind="stable")
    records, block = records[order], block[order]
    rows = [(int(block[a]), records[a:b].tobytes()) for a, b in _cuts(block)]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "told": pa.array([r[1] for r in rows], pa.binary())})


# ---- Step 2: documents apply what is told and give the bytes of open stretches ----------------------


class _Told:
    """Looks up what is told of (document, hash)."""

    def __init__(self, records: np.ndarray, value: str) -> None:
        keys = _pair_key(records["doc"], records["hash"])
        order = np.argsort(keys)
        self.keys, self.records, self.value = keys[order], records[order], value

    def of(self, doc: np.ndarray, whole: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(doc), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, _pair_key(doc, whole)), len(self.keys) - 1)
        found = self.records[at]
        same = (found["doc"] == doc) & (found["hash"] == whole)
        return np.where(same, found[self.value], 0).astype(np.int64)


def _pair_key(doc: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc.astype(np.int64).view(np.uint64).copy()) ^ whole)


_RANGE = np.dtype([("start", "<u4"), ("end", "<u4")])
_WAITING = np.dtype([("hash", "<u8"), ("start", "<u4")])
_STRING = np.dtype([("doc", "<i8"), ("hash", "<u8"), ("anchor", "<u8"), ("size", "<u4")])

_DONE = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
_PART = [*_DONE, ("text", pa.binary()), ("ranges", pa.binary()), ("waiting", pa.binary()), ("bucket", pa.int64()), ("strings", pa.binary()), ("bytes", pa.binary())]
_NAMES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(fields: list) -> str:
    return ", ".join(f"{n} {_NAMES[k]}" for n, k in fields)


def _table(rows: list[dict], fields: list) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], k) for n, k in fields})


def removed_of(text: bytes, ranges: np.ndarray, doc: int | None, with_kept: bool) -> dict:
    """The result for a text from its removed ranges, which may overlap."""
    marks = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(marks, ranges["start"], 1)
    np.add.at(marks, ranges["end"], -1)
    gone = np.cumsum(marks[:-1]) > 0
    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if gone.any() else text
    return {
        "doc_id": doc,
        "n_bytes": len(text),
        "n_removed": int(gone.sum()),
        "n_spans": int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0,
        "kept_sha256": hashlib.sha256(kept).hexdigest(),
        "kept": kept if with_kept else None,
    }


def _in_runs(windows: np.ndarray) -> np.ndarray:
    """Byte ranges of runs of consecutive window starts."""
    windows = np.unique(windows)
    if not len(windows):
        return np.zeros(0, dtype=_RANGE)
    first = np.r_[True, windows[1:] != windows[:-1] + 1]
    return _records(_RANGE, windows[first], windows[np.r_[first[1:], True]] + WINDOW)


class _Block:
    """Collects one block of documents: ranges that are removed, stretches and windows that wait."""

    def __init__(self, count: int) -> None:
        self.ranges: list[list[np.ndarray]] = [[] for _ in range(count)]
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(count)]
        self.strings: list[tuple[np.ndarray, np.ndarray]] = []

    def remove(self, row: int, start: np.ndarray, end: np.ndarray) -> None:
        self.ranges[row].append(_records(_RANGE, start, end))

    def wait(self, row: int, whole: np.ndarray, start: np.ndarray) -> None:
        self.waiting[row].append(_records(_WAITING, whole, start))

    def give(self, data: np.ndarray, doc, whole, anchor, start, size) -> None:
        """The bytes of strings that wait for step 3."""
        if len(start):
            taken = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            self.strings.append((_records(_STRING, doc, whole, anchor, size), data[taken]))


def _apply(buckets: int, frequent, with_kept: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, texts = left.column("doc_id").to_numpy(), left.column("text").to_pylist()
        told = _Told(_joined(right, "told", _STATUS), "status")
        block = _Block(len(texts))
        for a, b in buffers(texts):
            found = stretches(texts[a:b])
            row = a + found.text
            status = told.of(docs[row], found.hash)
            often = _is_in(found.anchor, frequent.value)
            begin = found.start - found.edges[found.text]
            end = begin + found.windows + WINDOW - 1
            for i, j in _cuts(row):
                gone, stays = status[i:j] == REMOVED, (status[i:j] == OPEN) & ~often[i:j]
                if gone.any():
                    block.remove(row[i], begin[i:j][gone], end[i:j][gone])
                if stays.any():
                    block.wait(row[i], found.hash[i:j][stays], begin[i:j][stays])
            first = np.flatnonzero((status == OPEN) & ~often)
            if len(first):
                _, unique = np.unique(_pair_key(docs[row[first]], found.hash[first]), return_index=True)
                first = first[unique]
                block.give(found.data, docs[row[first]], found.hash[first], found.anchor[first], found.start[first], found.windows[first] + WINDOW - 1)
            starts, stretch = _expanded(found, np.flatnonzero(often & (status != REMOVED)))
            gone = told.of(docs[row[stretch]], _window_hashes(found.data, starts)) == REMOVED
            place, own = (starts - found.edges[found.text[stretch]])[gone], row[stretch][gone]
            for i, j in _cuts(own):
                runs = _in_runs(place[i:j])
                block.remove(own[i], runs["start"], runs["end"])
        return _table(_finished(block, docs, texts, with_kept) + _given(block, buckets), _PART)

    return run


def _finished(block: _Block, docs: np.ndarray, texts: list[bytes], with_kept: bool) -> list[dict]:
    rows = []
    for i, text in enumerate(texts):
        ranges = np.concatenate([np.zeros(0, dtype=_RANGE), *block.ranges[i]])
        if block.waiting[i]:
            rows.append({"doc_id": int(docs[i]), "text": text, "ranges": ranges.tobytes(), "waiting": np.concatenate(block.waiting[i]).tobytes()})
        else:
            rows.append(removed_of(text, ranges, int(docs[i]), with_kept))
    return rows


def _given(block: _Block, buckets: int) -> list[dict]:
    if not block.strings:
        return []
    heads = np.concatenate([h for h, _ in block.strings])
    data = np.concatenate([d for _, d in block.strings])
    begin = np.r_[0, np.cumsum(heads["size"].astype(np.int64))]
    bucket = (heads["anchor"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows = []
    for a, b in _cuts(bucket[order]):
        own = order[a:b]
        body = b"".join(data[begin[i] : begin[i + 1]].tobytes() for i in own)
        rows.append({"bucket": int(bucket[own[0]]), "strings": heads[own].tobytes(), "bytes": body})
    return rows


# ---- Step 3: suffix arrays --------------------------------------------------------------------------

_SYMBOLS = 7  # of nine bits each in one key


def _keys(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next seven symbols of every suffix as one number; 0 after its string's end."""
    keys = np.zeros(len(symbols), dtype=np.uint64)
    padded = np.r_[symbols, np.zeros(_SYMBOLS, dtype=symbols.dtype)].astype(np.uint64)
    for i in range(_SYMBOLS):
        keys = (keys << np.uint64(9)) | np.where(left > i, padded[i : i + len(symbols)], np.uint64(0))
    return keys


def suffix_array(symbols: np.ndarray, left: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. ``symbols`` are byte values + 1, each string ends with a 0;
    ``left`` counts a suffix's symbols up to that 0. Suffixes end with their strings.

    Two stages: suffixes smaller than their successors are sorted directly. All others begin with a
    symbol at least as large as the next one; they are put, in the order of their successors, at the
    front of their first symbol's bucket while the buckets are scanned from the smallest up.
    """
    size = len(symbols)
    smaller = np.zeros(size, dtype=bool)
    ahead = np.r_[symbols[1:], 0]
    smaller[symbols < ahead] = True
    smaller[symbols == 0] = True
    equal = np.flatnonzero((symbols == ahead) & (symbols > 0))
    if len(equal):  # as the symbol after the run of equal ones says
        different = np.flatnonzero(symbols != ahead)
        smaller[equal] = smaller[different[np.searchsorted(different, equal)]]
    direct = np.flatnonzero(smaller)
    depth = int(left.max()) // _SYMBOLS + 1 if size else 0
    columns = [np.where(left[direct] > _SYMBOLS * i, keys[np.minimum(direct + _SYMBOLS * i, size - 1)], np.uint64(0)) for i in range(depth)]
    direct = direct[np.lexsort(columns[::-1])]
    direct_edges = np.searchsorted(symbols[direct], np.arange(258))
    waiting: dict[int, list[np.ndarray]] = {}
    out = []
    for symbol in range(257):
        induced = waiting.pop(symbol, [])
        newest = np.concatenate(induced) if induced else np.zeros(0, dtype=np.int64)
        parts = [newest]
        while len(newest):  # a run of equal symbols goes back one place at a time
            before = newest - 1
            before = before[before >= 0]
            newest = before[(symbols[before] == symbol) & ~smaller[before]]
            parts.append(newest)
        bucket = np.concatenate([*parts, direct[direct_edges[symbol] : direct_edges[symbol + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[symbols[before] > symbol]
        before = before[np.argsort(symbols[before], kind="stable")]
        for a, b in _cuts(symbols[before]):
            waiting.setdefault(int(symbols[before[a]]), []).append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def equal_neighbours(order: np.ndarray, symbols: np.ndarray, left: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each suffix shares its first WINDOW symbols with the one before it in ``order``."""
    a, b = order[1:], order[:-1]
    same = (left[a] >= WINDOW) & (left[b] >= WINDOW)
    at = np.flatnonzero(same)
    full = WINDOW // _SYMBOLS
    for i in range(full):
        at = at[keys[a[at] + _SYMBOLS * i] == keys[b[at] + _SYMBOLS * i]]
    for i in range(full * _SYMBOLS, WINDOW):
        at = at[symbols[a[at] + i] == symbols[b[at] + i]]
    out = np.zeros(len(order), dtype=bool)
    out[at + 1] = True
    return out


def repeated_windows(docs: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string number, window) of all windows of the strings that a smaller document holds too."""
    begin = np.r_[0, np.cumsum(sizes + 1)]
    symbols = np.zeros(int(begin[-1]), dtype=np.int64)
    string = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = begin[string + 1] - 1 - np.arange(len(symbols))
    symbols[left > 0] = data.astype(np.int64) + 1
    keys = _keys(symbols, left)
    order = suffix_array(symbols, left, keys)
    order = order[left[order] >= WINDOW]
    if not len(order):
        return order, order
    starts = np.flatnonzero(~equal_neighbours(order, symbols, left, keys))
    least = np.minimum.reduceat(docs[string[order]], starts)
    least = np.repeat(least, np.diff(np.r_[starts, len(order)]))
    found = order[docs[string[order]] > least]
    return string[found], found - begin[string[found]]


_MASK = np.dtype([("doc", "<i8"), ("hash", "<u8"), ("mask", "<u4")])


def _resolved(blocks: int):
    """For every open string: a bit for each of its windows that is removed."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        heads, data = _joined(table, "strings", _STRING), _joined(table, "bytes", np.dtype("u1"))
        begin = np.r_[0, np.cumsum(heads["size"].astype(np.int64))]
        order = np.argsort(heads["anchor"], kind="stable")
        out = [np.zeros(0, dtype=_MASK)]
        for own in _pieces(heads, order):
            sizes = heads["size"][own].astype(np.int64)
            taken = np.repeat(begin[own] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
            string, window = repeated_windows(heads["doc"][own], sizes, data[taken])
            masks = np.zeros(len(own), dtype=np.uint32)
            np.bitwise_or.at(masks, string, np.uint32(1) << window.astype(np.uint32))
            told = masks > 0
            out.append(_records(_MASK, heads["doc"][own][told], heads["hash"][own][told], masks[told]))
        return _by_block(np.concatenate(out), blocks)

    return run


def _pieces(heads: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """Strings in groups of about PIECE bytes; strings with one anchor stay together."""
    first, size = 0, 0
    for a, b in _cuts(heads["anchor"][order]):
        own = int(heads["size"][order[a:b]].sum())
        if size and size + own > PIECE:
            yield order[first:a]
            first, size = a, 0
        size += own
    if first < len(order):
        yield order[first:]


def _finish(with_kept: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = _Told(_joined(right, "told", _MASK), "mask")
        rows = []
        columns = [left.column(n).to_pylist() for n in ("doc_id", "text", "ranges", "waiting")]
        for doc, text, ranges, waiting in zip(*columns):
            waits = np.frombuffer(waiting, dtype=_WAITING)
            mask = told.of(np.full(len(waits), doc, dtype=np.int64), waits["hash"])
            bits = (mask[:, None] >> np.arange(REACH)[None, :]) & 1
            at, window = np.nonzero(bits)
            more = _in_runs(waits["start"][at].astype(np.int64) + window)
            rows.append(removed_of(text, np.concatenate([np.frombuffer(ranges, dtype=_RANGE), more]), doc, with_kept))
        return _table(rows, _DONE)

    return run


def _prime_from(number: int) -> int:
    while any(number % i == 0 for i in range(2, int(number**0.5) + 1)):
        number += 1
    return number


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes).

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; this is
    judged on the texts as they are. Matches never cross documents; texts are UTF-8 bytes of any length,
    null counts as empty. Rows that share an id count as one document, but have a row each; equal texts
    go from all but the smallest id. Rows without an id take no part and lose nothing. An empty table
    gives an empty result. Other columns, whatever their names, are not read. Ids are whole numbers.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    named = narrow.where("doc_id IS NOT NULL")
    frequent = spark.sparkContext.broadcast(frequent_anchors(named, named.count()))
    # Twice the partitions: smaller groups, which spread more evenly.
    buckets = blocks = _prime_from(max(7, 2 * partitions(docs)))
    sent = named.mapInArrow(_sent_stretches(buckets, frequent), "bucket long, owners binary, entries binary, told binary")
    told = sent.groupBy("bucket").applyInArrow(_judged(blocks), "block long, told binary")
    told = written(told, "stretches-told")
    placed = named.withColumn("block", F.pmod("doc_id", F.lit(blocks)))
    part = placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_apply(buckets, frequent, with_kept), _ddl(_PART))
    part = written(part, "passages-open")
    strings = part.where("bucket IS NOT NULL").select("bucket", "strings", "bytes")
    masks = strings.groupBy("bucket").applyInArrow(_resolved(blocks), "block long, told binary")
    waiting = part.where("waiting IS NOT NULL").select("doc_id", "text", "ranges", "waiting", F.pmod("doc_id", F.lit(blocks)).alias("block"))
    ended = waiting.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(_finish(with_kept), _ddl(_DONE))
    columns = [n for n, _ in _DONE]
    nameless = narrow.where("doc_id IS NULL").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        (F.col("text") if with_kept else F.lit(None).cast("binary")).alias("kept"),
    )
    result = part.where("n_bytes IS NOT NULL").select(*columns).unionByName(ended).unionByName(nameless)
    return result if with_kept else result.drop("kept")
