"""Exact quantiles of whole columns, over all rows or over growing parts of a table.

Spark's exact percentile aggregate ends in one task that holds every distinct value of a group.
That is right for groups of bounded size (the weeks of a store), not for a whole table. Here a rank is
selected: sketches bracket it, one pass counts what lies below the brackets and gathers what lies
inside, and the brackets are narrowed over those values until few are left. Sketches and counts are
kept per block of rows, so that one pass serves every prefix of blocks (the training parts of a
backtest). No task and no driver step holds more values as the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.session import materialize

# The sketch of a block gives POINTS + 1 evenly spaced quantiles, off by about a third of a percent of its
# ranks with this WIDTH; brackets reach MARGIN of all ranks to each side. A bracket that misses its rank is
# widened, so these numbers decide on speed alone.
POINTS, WIDTH, MARGIN = 200, 800, 0.01
# A bracket is split into so many parts at a time, until it holds so few rows of values.
SPLIT, FEW = 256, 256


@dataclass(frozen=True)
class _Cell:
    """A wanted rank and the bracket [low, high] it lies in; ``below`` counts the values under ``low``."""

    column: int
    upto: int
    probability: float
    n: int
    low: float
    high: float
    below: int = 0

    @property
    def ranks(self) -> tuple[int, int]:
        rank = self.probability * (self.n - 1)
        return int(np.floor(rank)), int(np.ceil(rank))


def _key(value: float) -> int:
    """Whole numbers in the order of the doubles."""
    bits = int(np.float64(value + 0.0).view(np.int64))
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def _value(key: int) -> float:
    bits = key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF
    return float(np.int64(bits).view(np.float64))


def _edges(cell: _Cell, split: int) -> np.ndarray:
    """Ascending lower bounds of the parts of a bracket; the first is its own."""
    low, high = _key(cell.low), _key(cell.high)
    parts = max(1, min(split, high - low + 1))
    return np.array([_value(low + (high - low + 1) * k // parts) for k in range(parts)])


# --- sketches -------------------------------------------------------------------------------------


def _sketched(data: DataFrame, columns: list[str]) -> dict[tuple[int, int], tuple[int, float, float, np.ndarray]]:
    """(column, block): number of values, least, greatest, points. As many entries as columns and blocks."""
    points = F.array(*[F.lit(k / POINTS) for k in range(POINTS + 1)])
    sketches = [
        F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.kll_sketch_agg_double(c, WIDTH).alias("s")).alias(c) for c in columns
    ]
    at = lambda c: F.when(F.col(f"{c}.n") > 0, F.kll_sketch_get_quantile_double(f"{c}.s", points))
    parts = [F.struct(f"{c}.n", f"{c}.lo", f"{c}.hi", at(c)).alias(c) for c in columns]
    found = {}
    for row in data.groupBy("__block").agg(*sketches).select("__block", *parts).collect():
        for i, c in enumerate(columns):
            n, low, high, at = row[c]
            if n:
                found[i, row["__block"]] = n, low + 0.0, high + 0.0, np.array(at)
    return found


def _bracket(sketches: list[tuple], column: int, upto: int, probability: float) -> _Cell:
    """Where the rank lies by the sketches of all blocks together."""
    n = sum(s[0] for s in sketches)
    least, greatest = min(s[1] for s in sketches), max(s[2] for s in sketches)
    values = np.concatenate([s[3] for s in sketches])
    weights = np.concatenate([np.full(len(s[3]), s[0] / len(s[3])) for s in sketches])
    order = np.argsort(values, kind="stable")
    values, share = values[order], np.cumsum(weights[order]) / n
    under, over = np.flatnonzero(share <= probability - MARGIN), np.flatnonzero(share >= probability + MARGIN)
    low = float(values[under[-1]]) if len(under) else least
    high = float(values[over[0]]) if len(over) else greatest
    return _Cell(column, upto, probability, n, low, high)


# --- passes ---------------------------------------------------------------------------------------


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def _out(kind: int, column: int, blocks: np.ndarray, values: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    size = len(values)
    columns = [pa.array(np.full(size, kind, dtype=np.int32)), pa.array(np.full(size, column, dtype=np.int32))]
    columns += [pa.array(blocks.astype(np.int32)), pa.array(values.astype(np.float64)), pa.array(copies.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "col", "block", "value", "copies"])


_FOUND = "kind int, col int, block int, value double, copies long"


def _gatherer(cells: list[_Cell], n_columns: int):
    """Over (block, columns...): kind 0 counts values by how many of the column's brackets begin at or below
    them, kind 1 gives every value that lies in a bracket."""
    lows = [np.unique([c.low for c in cells if c.column == i]) for i in range(n_columns)]
    spans = []
    for i in range(n_columns):
        starts, ends = [], []
        for low, high in sorted((c.low, c.high) for c in cells if c.column == i):
            if ends and low <= ends[-1]:
                ends[-1] = max(ends[-1], high)
            else:
                starts.append(low)
                ends.append(high)
        spans.append((np.array(starts), np.array(ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, *columns = _arrays(batch)
            size = int(blocks.max()) + 1 if len(blocks) else 0
            for i, values in enumerate(columns):
                if not len(lows[i]):
                    continue
                known = ~np.isnan(values)
                own, block = values[known] + 0.0, blocks[known].astype(np.int64)
                place = np.searchsorted(lows[i], own, side="right")
                width = len(lows[i]) + 1
                seen = np.bincount(block * width + place, minlength=size * width).reshape(-1, width)
                old = counts.get(i, np.zeros((0, width), dtype=np.int64))
                grown = np.zeros((max(len(old), len(seen)), width), dtype=np.int64)
                grown[: len(old)] += old
                grown[: len(seen)] += seen
                counts[i] = grown
                starts, ends = spans[i]
                at = np.searchsorted(starts, own, side="right") - 1
                inside = (at >= 0) & (own <= ends[at])
                own, block = own[inside], block[inside]
                order = np.lexsort((own, block))
                own, block = own[order], block[order]
                new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])][: len(own)])
                if len(new):
                    yield _out(1, i, block[new], own[new], np.diff(np.r_[new, len(own)]))
        for i, table in counts.items():
            block, place = np.nonzero(table)
            yield _out(0, i, block, place, table[block, place])

    return run


def _splitter(cells: list[_Cell], edges: list[np.ndarray]):
    """Over gathered values: how many copies (kind 0) and rows (kind 1) each part of each bracket holds; ``col`` is
    the cell here, ``block`` its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((2, len(e)), dtype=np.int64) for e in edges]
        for batch in batches:
            column, block, values, copies = _arrays(batch)
            order = np.argsort(column, kind="stable")
            bounds = np.searchsorted(column[order], np.arange(max((c.column for c in cells), default=-1) + 2))
            for k, cell in enumerate(cells):
                own = order[bounds[cell.column] : bounds[cell.column + 1]]
                own = own[(block[own] <= cell.upto) & (values[own] >= cell.low) & (values[own] <= cell.high)]
                part = np.searchsorted(edges[k], values[own], side="right") - 1
                totals[k][0] += np.bincount(part, weights=copies[own], minlength=len(edges[k])).astype(np.int64)
                totals[k][1] += np.bincount(part, minlength=len(edges[k]))
        for k, (weights, rows) in enumerate(totals):
            at = np.flatnonzero(rows)
            yield _out(0, k, at, np.zeros(len(at)), weights[at])
            yield _out(1, k, at, np.zeros(len(at)), rows[at])

    return run


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("kind", "col", "block", "value").agg(F.sum("copies").alias("copies"))


# --- selection ------------------------------------------------------------------------------------


def _gather(data: DataFrame, cells: list[_Cell], n_columns: int) -> tuple[DataFrame, list[_Cell]]:
    """The values inside the brackets, once per block, and the cells with their counts below."""
    table = materialize(_summed(data.mapInArrow(_gatherer(cells, n_columns), _FOUND)), "bracketed-values")
    # As many counts as brackets and blocks.
    counts = table.where("kind = 0").collect()
    placed = []
    for i in {c.column for c in cells}:
        lows = np.unique([c.low for c in cells if c.column == i])
        own = np.array([(r["block"], r["value"], r["copies"]) for r in counts if r["col"] == i], dtype=np.int64).reshape(-1, 3)
        for cell in (c for c in cells if c.column == i):
            # A value below the bracket has passed only the lows before the bracket's own.
            under = (own[:, 0] <= cell.upto) & (own[:, 1] <= np.searchsorted(lows, cell.low))
            placed.append(replace(cell, below=int(own[under, 2].sum())))
    return table.where("kind = 1").select("col", "block", "value", "copies"), placed


def _narrowed(values: DataFrame, cells: list[_Cell], split: int) -> list[tuple[_Cell, int]]:
    """Each cell with the part of its bracket that holds its ranks, and the rows of values there; a cell whose
    ranks lie outside gets -1."""
    edges = [_edges(c, split) for c in cells]
    copies = [np.zeros(len(e), dtype=np.int64) for e in edges]
    rows = [np.zeros(len(e), dtype=np.int64) for e in edges]
    for r in _summed(values.mapInArrow(_splitter(cells, edges), _FOUND)).collect():
        (rows if r["kind"] else copies)[r["col"]][r["block"]] += r["copies"]
    out = []
    for k, cell in enumerate(cells):
        upto = cell.below + np.cumsum(copies[k])
        first, last = (int(np.searchsorted(upto, r, side="right")) for r in cell.ranks)
        if cell.below > cell.ranks[0] or last >= len(upto):
            out.append((cell, -1))
            continue
        high = cell.high if last + 1 == len(upto) else _value(_key(float(edges[k][last + 1])) - 1)
        below = int(upto[first - 1]) if first else cell.below
        out.append((replace(cell, low=float(edges[k][first]), high=high, below=below), int(rows[k][first : last + 1].sum())))
    return out


def _picked(values: DataFrame, cells: list[_Cell]) -> list[float]:
    """The quantile of each cell, whose bracket holds few rows of values."""
    if not cells:
        return []
    # At most FEW rows per cell come to the driver.
    wanted = F.lit(False)
    for column, low, high in {(c.column, c.low, c.high) for c in cells}:
        wanted = wanted | ((F.col("col") == column) & F.col("value").between(low, high))
    rows = values.where(wanted).collect()
    out = []
    for cell in cells:
        own = sorted((r["value"], r["copies"]) for r in rows if r["col"] == cell.column and r["block"] <= cell.upto and cell.low <= r["value"] <= cell.high)
        upto = cell.below + np.cumsum([n for _, n in own])
        low, high = (own[int(np.searchsorted(upto, r, side="right"))][0] for r in cell.ranks)
        rank = cell.probability * (cell.n - 1)
        out.append(low + (high - low) * (rank - cell.ranks[0]))
    return out


def prefix_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], block: Column | None = None, upto: list[int] | None = None, split: int = SPLIT, few: int = FEW) -> dict[tuple[int, str, float], float]:
    """{(upto, column, probability): exact, linearly interpolated quantile} over the rows whose ``block`` (whole
    numbers from 0) is at most ``upto``; without a block, over all rows.

    NULLs and NaN are skipped, and so are rows without a block; a column without values gives no entry. The data is
    read twice, whatever the number of columns, probabilities and prefixes; the result has one number per
    wanted quantile.
    """
    names = [f"c{i}" for i in range(len(columns))]
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(n) for c, n in zip(columns, names)]
    data = df.select((F.lit(0) if block is None else block).cast("int").alias("__block"), *values).where("__block IS NOT NULL")
    sketches = _sketched(data, names)
    cells = []
    for last in [0] if upto is None else upto:
        for i in range(len(columns)):
            known = [s for (column, b), s in sketches.items() if column == i and b <= last]
            cells += [_bracket(known, i, last, p) for p in dict.fromkeys(probabilities) if known]
    found: dict[tuple[int, str, float], float] = {}
    while cells:
        gathered, cells = _gather(data, cells, len(columns))
        missed = []
        while cells:
            narrowed = _narrowed(gathered, cells, split)
            done = [c for c, rows in narrowed if 0 <= rows <= few]
            for cell, value in zip(done, _picked(gathered, done)):
                found[cell.upto, columns[cell.column], cell.probability] = value
            missed += [c for c, rows in narrowed if rows < 0]
            cells = [c for c, rows in narrowed if rows > few]
        # A rank outside its bracket is sought again among all values.
        for cell in missed:
            own = [s for (column, b), s in sketches.items() if column == cell.column and b <= cell.upto]
            cells.append(replace(cell, low=min(s[1] for s in own), high=max(s[2] for s in own), below=0))
    return found


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row per (column, probability) with its exact, linearly interpolated quantile over all rows.

    NULLs and NaN are skipped; a column without values gives no row.
    """
    found = prefix_quantiles(df, columns, probabilities)
    rows = [(c, p, v) for (_, c, p), v in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double")


def exact_median(df: DataFrame, column: str) -> Column:
    """The median of ``column`` over the whole table, for use in expressions; NULL without values."""
    return F.lit(prefix_quantiles(df, [column], [0.5]).get((0, column, 0.5))).cast("double")
