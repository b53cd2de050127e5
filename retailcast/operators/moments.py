"""Least squares with a mean per store, from sums that merge.

One pass over the rows gives the cross products of all inputs per block of rows, and their sums per block
and store. Sums of blocks add up, so the same pass serves every growing training part of a backtest; a
fill value, a level that stands for missing ones and a choice of features are linear in these inputs, so it
serves every feature scenario as well. Fitting is then algebra on matrices as wide as the inputs; stores
stay a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.session import materialize

# A deviation from store means below this share of the whole one is rounding.
CONSTANT = 1e-9
# Directions of standardized inputs below this share of the strongest one are collinear.
COLLINEAR = 1e-10
# Sums of so many stores are held in a task before they are passed on.
HELD = 20_000


@dataclass(frozen=True)
class Layout:
    """Places of the inputs: one; each number less its shift, 0 if missing; whether it is missing; each level of
    each category and whether it is missing; the target."""

    numeric: tuple[str, ...]
    shifts: tuple[float, ...]
    categories: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def size(self) -> int:
        return 2 + 2 * len(self.numeric) + sum(len(levels) + 1 for _, levels in self.categories)

    def number(self, name: str) -> tuple[int, int]:
        at = self.numeric.index(name)
        return 1 + at, 1 + len(self.numeric) + at

    def level(self, category: str) -> dict[str | None, int]:
        at = 1 + 2 * len(self.numeric)
        for name, levels in self.categories:
            if name == category:
                return {level: at + i for i, level in enumerate([*levels, None])}
            at += len(levels) + 1
        raise KeyError(category)

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows of (block, store, target, numbers..., categories...)."""
        d = len(self.numeric)
        out = np.zeros((batch.num_rows, self.size))
        out[:, 0] = 1
        out[:, -1] = batch.column(2).to_numpy(zero_copy_only=False)
        for i, shift in enumerate(self.shifts):
            values = batch.column(3 + i).to_numpy(zero_copy_only=False)
            missing = np.isnan(values)
            out[:, 1 + i] = np.where(missing, 0.0, values - shift)
            out[:, 1 + d + i] = missing
        at, every = 1 + 2 * d, np.arange(batch.num_rows)
        for i, (_, levels) in enumerate(self.categories):
            codes = pc.index_in(batch.column(3 + d + i), pa.array(levels, pa.string())).fill_null(len(levels))
            out[every, at + codes.to_numpy(zero_copy_only=False)] = 1
            at += len(levels) + 1
        return out


_SUMS = "kind int, block int, store string, sums array<double>"


def _batch(kind: int, blocks: list[int], stores: list[str | None], sums: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([kind] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(stores, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([s.ravel() for s in sums], pa.list_(pa.float64()))], ["kind", "block", "store", "sums"])


def _collected(layout: Layout) -> Callable:
    """Kind 0: cross products per block; kind 1: sums per block and store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        sums: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = layout.matrix(batch)
            blocks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            stores = batch.column(1).dictionary_encode()
            names = stores.dictionary.to_pylist()
            group = blocks * len(names) + stores.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
            for g, vector in zip(group[order][begins], np.add.reduceat(rows[order], begins, axis=0)):
                key = int(g) // len(names), names[int(g) % len(names)]
                sums[key] = sums[key] + vector if key in sums else vector
            for b in np.unique(blocks):
                own = rows[blocks == b]
                products[int(b)] = products.get(int(b), 0) + own.T @ own
            if len(sums) > HELD:
                yield _batch(1, [b for b, _ in sums], [s for _, s in sums], list(sums.values()))
                sums = {}
        yield _batch(1, [b for b, _ in sums], [s for _, s in sums], list(sums.values()))
        yield _batch(0, list(products), [None] * len(products), list(products.values()))

    return run


def _added(df: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Matrices summed by block; one matrix per block comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block, values = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                totals[block] = totals.get(block, 0) + values
        columns = [pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "sums"])

    schema = "block int, sums array<double>"
    narrow = df.select("block", "sums").mapInArrow(run, schema).repartition("block").mapInArrow(run, schema)
    return {r["block"]: np.array(r["sums"]).reshape(size, size) for r in narrow.collect()}


def _stores(batches: Iterator[pa.RecordBatch], uptos: list[int], size: int, at_once: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Stores, some at a time, with the sums of each prefix: (prefix, store, input). Rows come sorted by store."""
    names: list[str] = []
    held: list[np.ndarray] = []
    for batch in batches:
        stores, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, (store, block) in enumerate(zip(stores, blocks)):
            if not names or names[-1] != store:
                if len(names) == at_once:
                    yield names, np.stack(held, axis=1)
                    names, held = [], []
                names.append(store)
                held.append(np.zeros((len(uptos), size)))
            held[-1][[u >= block for u in uptos]] += batch.column(2)[k].values.to_numpy(zero_copy_only=False)
    if names:
        yield names, np.stack(held, axis=1)


def _by_store(sums: DataFrame) -> DataFrame:
    return sums.repartition("store").sortWithinPartitions("store").select("store", "block", "sums")


@dataclass
class Moments:
    """The sums of a table of rows: cross products per block, and per prefix the part of them between stores."""

    layout: Layout
    products: dict[int, np.ndarray]
    sums: DataFrame
    uptos: list[int]
    between: dict[int, np.ndarray]

    def total(self, upto: int) -> np.ndarray:
        size = self.layout.size
        return sum((m for b, m in self.products.items() if b <= upto), np.zeros((size, size)))

    def within(self, upto: int, by_store: bool) -> np.ndarray:
        """Cross products of deviations, from the means of stores or from the overall ones."""
        whole = self.total(upto)
        if by_store:
            return whole - self.between.get(upto, 0)
        return whole - np.outer(whole[0], whole[0]) / max(1.0, whole[0, 0])


def collect_moments(rows: DataFrame, layout: Layout, block: Column, store: Column, target: Column, uptos: list[int]) -> Moments:
    """One pass over ``rows``, whose ``block`` is a whole number from 0; rows without a target are left out.

    Numeric and categorical columns are read by the layout's names.
    """
    columns = [block.cast("int"), store.cast("string"), target.cast("double")]
    columns += [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in layout.numeric]
    columns += [F.col(c).cast("string") for c, _ in layout.categories]
    narrow = rows.select(*[c.alias(f"i{i}") for i, c in enumerate(columns)]).where("i0 IS NOT NULL AND i2 IS NOT NULL")
    table = materialize(narrow.mapInArrow(_collected(layout), _SUMS), "moments")
    products = _added(table.where("kind = 0"), layout.size)
    sums, size = table.where("kind = 1"), layout.size

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(uptos), size, size))
        for _, held in _stores(batches, uptos, size, 256):
            for p, own in enumerate(held):
                own = own[own[:, 0] > 0]
                totals[p] += (own / own[:, :1]).T @ own
        yield _batch(0, uptos, [None] * len(uptos), list(totals))

    parts = _added(_by_store(sums).mapInArrow(between, _SUMS), size)
    return Moments(layout, products, sums, uptos, parts)


# --- fits -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Case:
    """What a fit learns from: rows of blocks up to ``upto``, and which features. Fill values and levels are those
    of these rows."""

    name: str
    upto: int
    numeric: tuple[str, ...]
    levels: dict[str, list[str]]
    medians: dict[str, float]
    modes: dict[str, str]
    by_store: bool

    def inputs(self, layout: Layout) -> np.ndarray:
        """One row per feature: how it is made of the layout's inputs, numbers less their shift."""
        rows = []
        for name in self.numeric:
            value, missing = layout.number(name)
            row = np.zeros(layout.size)
            row[value] = 1
            row[missing] = self.medians.get(name, 0.0) - layout.shifts[layout.numeric.index(name)]
            rows.append(row)
        for category, levels in self.levels.items():
            places = layout.level(category)
            for level in levels:
                row = np.zeros(layout.size)
                row[places[level]] = 1
                row[places[None]] = level == self.modes.get(category)
                rows.append(row)
        return np.array(rows).reshape(-1, layout.size)


@dataclass(frozen=True)
class Line:
    """A fitted line: weights of the numbers and levels, and the base of rows of stores that training lacks."""

    numbers: dict[str, float]
    levels: dict[str, dict[str, float]]
    base: float


def solve(moments: Moments, case: Case) -> tuple[Line, np.ndarray]:
    """The least squares line of a case, and its weights by layout input (for the base of each store).

    Of collinear features, all share the weight of their common direction; one that is constant within
    stores gets none.
    """
    layout = moments.layout
    made = case.inputs(layout)
    deviations, whole = moments.within(case.upto, case.by_store), moments.within(case.upto, False)
    square = made @ deviations @ made.T
    spread, full = np.diag(square), np.diag(made @ whole @ made.T)
    used = np.flatnonzero((spread > CONSTANT * full) & (spread > 0))
    weights = np.zeros(len(made))
    if len(used):
        scale = np.sqrt(spread[used])
        values, vectors = np.linalg.eigh(square[np.ix_(used, used)] / np.outer(scale, scale))
        strong = values > COLLINEAR * values[-1]
        shares = vectors[:, strong].T @ ((made @ deviations[:, -1])[used] / scale)
        weights[used] = vectors[:, strong] @ (shares / values[strong]) / scale
    by_input = weights @ made
    total = moments.total(case.upto)
    mean = total[0] / max(1.0, total[0, 0])
    d = len(case.numeric)
    shift = sum(w * layout.shifts[layout.numeric.index(n)] for w, n in zip(weights[:d], case.numeric))
    base = float(mean[-1] - by_input @ mean - shift)
    levels, at = {}, d
    for category, names in case.levels.items():
        levels[category] = {n: float(weights[at + i]) for i, n in enumerate(names)}
        at += len(names)
    return Line(dict(zip(case.numeric, map(float, weights[:d]))), levels, base), np.r_[by_input, shift]


def store_table(moments: Moments, cases: list[tuple[Case, np.ndarray]]) -> DataFrame:
    """case, store, base (of its rows' predictions), mean (of its target): one row per case and store of its rows."""
    places = [moments.uptos.index(c.upto) for c, _ in cases]
    weights, names, size = [w for _, w in cases], [c.name for c, _ in cases], moments.layout.size
    uptos = moments.uptos

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stores, held in _stores(batches, uptos, size, 256):
            for name, place, own in zip(names, places, weights):
                seen = np.flatnonzero(held[place][:, 0] > 0)
                means = held[place][seen] / held[place][seen, :1]
                base = means[:, -1] - means @ own[:-1] - own[-1]
                columns = [pa.array([name] * len(seen), pa.string()), pa.array([stores[i] for i in seen], pa.string()), pa.array(base), pa.array(means[:, -1])]
                yield pa.RecordBatch.from_arrays(columns, ["case", "store", "base", "mean"])

    return materialize(_by_store(moments.sums).mapInArrow(run, "case string, store string, base double, mean double"), "store-means")
