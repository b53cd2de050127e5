"""A recurrent labeller of text blocks: which of them are a page's main text.

A block is its tag path (hashed tokens of the elements around it, nearer ones weighing more), its words
(hashed) and a few numbers; a bidirectional LSTM reads the page's blocks in their order, so that each is
judged by the whole document. Everything is numpy: training on generated layouts, and labelling in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from retailcast.llm.html_blocks import Block, Node, bucket
from retailcast.llm.words import word_hashes


@dataclass(frozen=True)
class Shape:
    path_buckets: int = 2048
    path_size: int = 16
    word_buckets: int = 1024
    word_size: int = 8
    hidden: int = 20
    decay: float = 0.8  # weight of an element's tokens per step outwards


NUMBERS = 5
# Cells of one padded group of pages, and steps whose gates are held at once.
CELLS = 8192
SEGMENT = 512

Weights = dict[str, np.ndarray]


def initial(shape: Shape, seed: int) -> Weights:
    draw = np.random.default_rng(seed)
    inputs = 2 * shape.path_size + shape.word_size + NUMBERS
    weights = {
        # Unseen tokens and words add nothing, so their vectors begin at zero.
        "own": np.zeros((shape.path_buckets, shape.path_size)),
        "path": np.zeros((shape.path_buckets, shape.path_size)),
        "word": np.zeros((shape.word_buckets, shape.word_size)),
        "out_x": np.zeros(inputs),
        "bias": np.zeros(1),
    }
    for side in ("f", "b"):
        weights[f"{side}_x"] = draw.normal(0, inputs**-0.5, (inputs, 4 * shape.hidden))
        weights[f"{side}_h"] = draw.normal(0, shape.hidden**-0.5, (shape.hidden, 4 * shape.hidden))
        weights[f"{side}_c"] = np.r_[np.ones(shape.hidden), np.zeros(3 * shape.hidden)]  # gates: forget, in, out, new
        weights[f"{side}_out"] = draw.normal(0, shape.hidden**-0.5, shape.hidden)
    return {name: value.astype(np.float32) for name, value in weights.items()}


# --- inputs ---------------------------------------------------------------------------------------


def _own_buckets(node: Node, shape: Shape) -> list[int]:
    return [bucket(t, shape.path_buckets) for t in node.tokens]


def _path_vector(node: Node, weights: Weights, shape: Shape) -> np.ndarray:
    """The sum of its tokens' vectors and of the decayed path around it, kept with the element."""
    todo = []
    while node is not None and "path" not in node.memo:
        todo.append(node)
        node = node.parent
    vector = node.memo["path"] if node is not None else np.zeros(shape.path_size, dtype=np.float32)
    for inner in reversed(todo):
        buckets = _own_buckets(inner, shape)
        inner.memo["own"] = weights["own"][buckets].sum(axis=0)
        vector = vector * np.float32(shape.decay) + weights["path"][buckets].sum(axis=0)
        inner.memo["path"] = vector
    return vector


def _numbers(blocks: list[Block]) -> np.ndarray:
    chars = np.array([len(b.text) for b in blocks], dtype=np.float32)
    words = np.array([b.text.count(" ") + 1 for b in blocks], dtype=np.float32)
    links = np.array([b.links for b in blocks], dtype=np.float32)
    ends = np.array([b.text[-1] in ".!?:…。" for b in blocks], dtype=np.float32)
    return np.stack([np.log1p(chars) / 5, np.log1p(words) / 4, links, ends, np.ones(len(blocks), dtype=np.float32)], axis=1)


def _words(blocks: list[Block], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after the other, and where each block's begin."""
    hashes, edges = word_hashes([b.text.encode("utf-8", "surrogatepass") for b in blocks])
    return (hashes % np.uint64(shape.word_buckets)).astype(np.int64), edges


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    totals = np.zeros((len(edges) - 1, values.shape[1]), dtype=np.float32)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        totals[some] = np.add.reduceat(values, edges[some], axis=0)
    return totals


def inputs_of(blocks: list[Block], weights: Weights, shape: Shape) -> np.ndarray:
    """One row per block."""
    words, edges = _words(blocks, shape)
    mean = _sums(weights["word"][words], edges) / np.maximum(1, np.diff(edges))[:, None]
    path = np.stack([_path_vector(b.node, weights, shape) for b in blocks])
    own = np.stack([b.node.memo["own"] for b in blocks])
    return np.concatenate([own, path, mean, _numbers(blocks)], axis=1).astype(np.float32)


# --- the network ----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _step(gates: np.ndarray, cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New hidden state and cell, and the opened gates."""
    opened = np.empty_like(gates)
    opened[:, : 3 * size] = _sigmoid(gates[:, : 3 * size])
    opened[:, 3 * size :] = np.tanh(gates[:, 3 * size :])
    cell = opened[:, :size] * cell + opened[:, size : 2 * size] * opened[:, 3 * size :]
    return opened[:, 2 * size : 3 * size] * np.tanh(cell), cell, opened


def _reversed(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Places of a padded group read backwards, the padding still last."""
    at = np.arange(steps)[None, :]
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


def _outputs(x: np.ndarray, weights: Weights, side: str, size: int) -> np.ndarray:
    """What one direction adds to every block's score. Steps are taken in segments, so that a long page
    needs no memory beyond its inputs."""
    pages, steps = x.shape[:2]
    hidden = np.zeros((pages, size), dtype=np.float32)
    cell, out = hidden.copy(), np.zeros((pages, steps), dtype=np.float32)
    for first in range(0, steps, SEGMENT):
        gates = x[:, first : first + SEGMENT] @ weights[f"{side}_x"] + weights[f"{side}_c"]
        for t in range(gates.shape[1]):
            hidden, cell, _ = _step(gates[:, t] + hidden @ weights[f"{side}_h"], cell, size)
            out[:, first + t] = hidden @ weights[f"{side}_out"]
    return out


def _scores(x: np.ndarray, lengths: np.ndarray, weights: Weights, shape: Shape) -> np.ndarray:
    back = _reversed(lengths, x.shape[1])
    forward = _outputs(x, weights, "f", shape.hidden)
    backward = _outputs(np.take_along_axis(x, back[:, :, None], axis=1), weights, "b", shape.hidden)
    return x @ weights["out_x"] + weights["bias"] + forward + np.take_along_axis(backward, back, axis=1)


def _groups(lengths: list[int]) -> Iterator[list[int]]:
    """Pages of similar length together, at most CELLS padded cells unless one page alone has more."""
    group: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i]):
        if group and lengths[i] * (len(group) + 1) > CELLS:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def label_pages(pages: list[list[Block]], weights: Weights, shape: Shape = Shape()) -> list[np.ndarray]:
    """For each page, whether each of its blocks is main text."""
    found = [np.zeros(len(p), dtype=bool) for p in pages]
    for group in _groups([len(p) for p in pages]):
        lengths = np.array([len(pages[i]) for i in group])
        rows = inputs_of([b for i in group for b in pages[i]], weights, shape)
        x = np.zeros((len(group), lengths.max(), rows.shape[1]), dtype=np.float32)
        x[np.arange(lengths.max())[None, :] < lengths[:, None]] = rows
        for i, n, scores in zip(group, lengths, _scores(x, lengths, weights, shape)):
            found[i] = scores[:n] > 0
    return found


# --- training -------------------------------------------------------------------------------------


@dataclass
class _Bags:
    """What the blocks of one page are made of: (row, bucket) of own tokens, (row, bucket, weight) of path
    tokens, (row, bucket) of words, and the numbers."""

    own: np.ndarray
    path: np.ndarray
    weight: np.ndarray
    word: np.ndarray
    numbers: np.ndarray


def _bags(blocks: list[Block], shape: Shape) -> _Bags:
    own, path, weights = [], [], []
    for row, block in enumerate(blocks):
        node, weight = block.node, 1.0
        own += [(row, b) for b in _own_buckets(node, shape)]
        while node is not None:
            for b in _own_buckets(node, shape):
                path.append((row, b))
                weights.append(weight)
            node, weight = node.parent, weight * shape.decay
    words, edges = _words(blocks, shape)
    word = np.stack([np.repeat(np.arange(len(blocks)), np.diff(edges)), words])
    return _Bags(np.array(own, dtype=np.int64).T, np.array(path, dtype=np.int64).T, np.array(weights, dtype=np.float32), word, _numbers(blocks))


def _together(pages: list[_Bags]) -> _Bags:
    """Rows of several pages one after the other."""
    starts = np.cumsum([0] + [len(p.numbers) for p in pages])
    moved = lambda name: np.concatenate([getattr(p, name) + np.array([[s], [0]]) for p, s in zip(pages, starts)], axis=1)
    return _Bags(moved("own"), moved("path"), np.concatenate([p.weight for p in pages]), moved("word"), np.concatenate([p.numbers for p in pages]))


def _add(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values`` by ``at``."""
    out = np.zeros((size, values.shape[1]), dtype=values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        out[at[order][begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


def _through(x: np.ndarray, weights: Weights, side: str, size: int):
    """Hidden states of all steps, and what the way back needs."""
    pages, steps = x.shape[:2]
    gates = x @ weights[f"{side}_x"] + weights[f"{side}_c"]
    hidden = np.zeros((pages, size), dtype=np.float32)
    cell = hidden.copy()
    states, kept = np.zeros((pages, steps, size), dtype=np.float32), []
    for t in range(steps):
        before = hidden, cell
        hidden, cell, opened = _step(gates[:, t] + hidden @ weights[f"{side}_h"], cell, size)
        kept.append((*before, cell, opened))
        states[:, t] = hidden
    return states, kept


def _back_through(x, d_states, kept, weights: Weights, side: str, size: int, grads: Weights) -> np.ndarray:
    pages, steps = x.shape[:2]
    d_gates = np.zeros((pages, steps, 4 * size), dtype=np.float32)
    d_hidden = np.zeros((pages, size), dtype=np.float32)
    d_cell = d_hidden.copy()
    for t in reversed(range(steps)):
        hidden, old, cell, opened = kept[t]
        forget, enter, leave, new = (opened[:, k * size : (k + 1) * size] for k in range(4))
        d = d_states[:, t] + d_hidden
        squashed = np.tanh(cell)
        d_cell = d_cell + d * leave * (1 - squashed**2)
        parts = (d_cell * old * forget * (1 - forget), d_cell * new * enter * (1 - enter), d * squashed * leave * (1 - leave), d_cell * enter * (1 - new**2))
        d_gates[:, t] = np.concatenate(parts, axis=1)
        grads[f"{side}_h"] += hidden.T @ d_gates[:, t]
        d_hidden = d_gates[:, t] @ weights[f"{side}_h"].T
        d_cell = d_cell * forget
    flat = d_gates.reshape(-1, 4 * size)
    grads[f"{side}_x"] += x.reshape(-1, x.shape[2]).T @ flat
    grads[f"{side}_c"] += flat.sum(axis=0)
    return d_gates @ weights[f"{side}_x"].T


def _gradients(pages: list[_Bags], labels: list[np.ndarray], weights: Weights, shape: Shape, draw: np.random.Generator, hide: float) -> Weights:
    """Of the logistic loss over all blocks. A share ``hide`` of tokens and words is left out, so that no
    single one decides."""
    bags = _together(pages)
    lengths = np.array([len(p.numbers) for p in pages])
    count = lengths.sum()
    seen = lambda size: (draw.random(size) >= hide).astype(np.float32)[:, None]
    own, path, word = seen(bags.own.shape[1]), seen(bags.path.shape[1]) * bags.weight[:, None], seen(bags.word.shape[1])
    word /= np.bincount(bags.word[0], minlength=count)[bags.word[0]][:, None].astype(np.float32)
    parts = [_add(count, rows, weights[name][buckets] * share) for name, (rows, buckets), share in (("own", bags.own, own), ("path", bags.path, path), ("word", bags.word, word))]
    rows = np.concatenate([*parts, bags.numbers], axis=1)
    mask = np.arange(lengths.max())[None, :] < lengths[:, None]
    x = np.zeros((*mask.shape, rows.shape[1]), dtype=np.float32)
    x[mask] = rows
    back = _reversed(lengths, mask.shape[1])
    x_back = np.take_along_axis(x, back[:, :, None], axis=1)
    size = shape.hidden
    f_states, f_kept = _through(x, weights, "f", size)
    b_states, b_kept = _through(x_back, weights, "b", size)
    b_turned = np.take_along_axis(b_states, back[:, :, None], axis=1)
    scores = x @ weights["out_x"] + weights["bias"] + f_states @ weights["f_out"] + b_turned @ weights["b_out"]
    truth = np.zeros(mask.shape, dtype=np.float32)
    truth[mask] = np.concatenate(labels)
    d = np.where(mask, _sigmoid(scores) - truth, 0).astype(np.float32) / count
    grads = {name: np.zeros_like(value) for name, value in weights.items()}
    grads["bias"] += d.sum()
    grads["out_x"] += np.einsum("pt,ptk->k", d, x)
    grads["f_out"] += np.einsum("pt,ptk->k", d, f_states)
    grads["b_out"] += np.einsum("pt,ptk->k", d, b_turned)
    d_x = d[:, :, None] * weights["out_x"] + _back_through(x, d[:, :, None] * weights["f_out"], f_kept, weights, "f", size, grads)
    d_back = np.take_along_axis(d, back, axis=1)[:, :, None] * weights["b_out"]
    d_x += np.take_along_axis(_back_through(x_back, d_back, b_kept, weights, "b", size, grads), back[:, :, None], axis=1)
    d_rows, k = d_x[mask], shape.path_size
    grads["own"] += _add(shape.path_buckets, bags.own[1], d_rows[bags.own[0], :k] * own)
    grads["path"] += _add(shape.path_buckets, bags.path[1], d_rows[bags.path[0], k : 2 * k] * path)
    grads["word"] += _add(shape.word_buckets, bags.word[1], d_rows[bags.word[0], 2 * k : 2 * k + shape.word_size] * word)
    return grads


def fit(
    pages: list[list[Block]], labels: list[np.ndarray], shape: Shape = Shape(), epochs: int = 8, pages_at_once: int = 32, rate: float = 0.015, hide: float = 0.15, seed: int = 13
) -> Weights:
    """Weights by Adam over pages with known labels; the same pages give the same weights."""
    draw = np.random.default_rng(seed)
    weights = initial(shape, seed)
    first, second = ({n: np.zeros_like(v) for n, v in weights.items()} for _ in range(2))
    some = [i for i, p in enumerate(pages) if p]
    bags = {i: _bags(pages[i], shape) for i in some}
    # Pages of similar length train together, in any order.
    by_length = sorted(some, key=lambda i: (len(pages[i]), i))
    chunks = [by_length[k : k + pages_at_once] for k in range(0, len(by_length), pages_at_once)]
    total, done = epochs * len(chunks), 0
    for _ in range(epochs):
        for at in draw.permutation(len(chunks)):
            grads = _gradients([bags[i] for i in chunks[at]], [labels[i] for i in chunks[at]], weights, shape, draw, hide)
            done += 1
            step = rate * (1 - done / (total + 1)) * np.sqrt(1 - 0.999**done) / (1 - 0.9**done)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for name, grad in grads.items():
                grad = grad / max(1.0, norm)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                weights[name] -= (step * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return weights
