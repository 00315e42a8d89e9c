"""Training of many additive models from shared scans of one binned table.

A scan returns, for every model, term and bin, the sums of gradients, hessians
and rows, and the loss on the rows that the model holds out.  Each model then
grows one small tree a term on these sums.  Tasks add up their rows in arrays, so
a scan moves a few numbers a task however many rows or models there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = "fit int, term int, bin int, g double, h double, n long"
#: The term number under which a model's loss on held-out rows comes back.
HELD_OUT = -1
#: A split must gain more than this, relative to what the leaf has.
LEAST_GAIN = 1e-12


@dataclass
class Fit:
    """One model in training: its terms, their scores by bin, and how a round changes them.

    ``terms`` are positions of one or two features; ``sizes`` are bins a feature, the
    last one for missing values.
    """

    terms: list[tuple[int, ...]]
    sizes: list[int]
    intercept: float
    lr: float = 0.3
    rounds: int = 20
    max_leaves: int | None = None
    min_samples_leaf: int = 1
    min_hessian: float = 1e-6
    cyclic: bool = False
    hold: int | None = None
    patience: int | None = None
    tolerance: float = 1e-4
    scores: list[np.ndarray] = field(default_factory=list)
    done: int = 0
    running: bool = True
    losses: list[float] = field(default_factory=list)
    best: tuple[float, int, list[np.ndarray]] | None = None

    def __post_init__(self):
        if not self.scores:
            self.scores = [np.zeros(self.bins(t)) for t in range(len(self.terms))]

    def bins(self, term: int) -> int:
        return math.prod(self.sizes[f] for f in self.terms[term])

    def cells(self, columns: Sequence[np.ndarray], term: int) -> np.ndarray:
        """Each row's bin of a term; a pair's runs through the second feature first."""
        out = columns[self.terms[term][0]]
        for f in self.terms[term][1:]:
            out = out * self.sizes[f] + columns[f]
        return out

    def raw(self, columns: Sequence[np.ndarray], rows: int) -> np.ndarray:
        out = np.full(rows, self.intercept)
        for t in range(len(self.terms)):
            out += self.scores[t][self.cells(columns, t)]
        return out

    def turn(self) -> list[int]:
        """The terms of the next scan: all, or one after another."""
        return [self.done % len(self.terms)] if self.cyclic else list(range(len(self.terms)))

    def scans(self) -> int:
        return self.rounds * (len(self.terms) if self.cyclic else 1)


def columns_of(batch: pa.RecordBatch, features: int) -> list[np.ndarray]:
    return [batch.column(f"b{f}").to_numpy(zero_copy_only=False).astype(np.int64) for f in range(features)]


def sum_batches(batches: Iterator[pa.RecordBatch], fits: list[tuple[int, Fit]], features: int) -> Iterator[pa.RecordBatch]:
    """The sums of one task."""
    sums = {(i, t): np.zeros((3, fit.bins(t))) for i, fit in fits for t in fit.turn()}
    held = {i: np.zeros(3) for i, _ in fits}
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        columns = columns_of(batch, features)
        for i, fit in fits:
            raw = fit.raw(columns, len(y))
            p = 1.0 / (1.0 + np.exp(-raw))
            learns = fold != fit.hold if fit.hold is not None else np.ones(len(y), dtype=bool)
            out = ~learns
            if out.any():
                # log(1 + exp(raw)) - y * raw, without overflow
                held[i] += (float((np.logaddexp(0.0, raw[out]) - y[out] * raw[out]).sum()), 0.0, int(out.sum()))
            g, h = (y - p)[learns], (p * (1 - p))[learns]
            for t in fit.turn():
                cell, size = fit.cells(columns, t)[learns], fit.bins(t)
                sums[i, t] += (np.bincount(cell, g, size), np.bincount(cell, h, size), np.bincount(cell, minlength=size))
    rows = [(i, t, b, *found[:, b]) for (i, t), found in sums.items() for b in np.flatnonzero(found[2])]
    rows += [(i, HELD_OUT, 0, *found) for i, found in held.items() if found[2]]
    yield table_of(rows)


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array([kind.to_pandas_dtype()(v) for v in c], kind) for c, kind in zip(columns, kinds)], names=["fit", "term", "bin", "g", "h", "n"])


def collected(rows: DataFrame, function) -> list:
    """Sums by model, term and bin over all tasks: as many rows as the models have bins."""
    return rows.mapInArrow(function, SUMS).groupBy("fit", "term", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()


# -- trees on sums -----------------------------------------------------------------


def gain_of(g, h, floor: float):
    return np.where(h > floor, g * g / np.maximum(h, floor), 0.0)


def best_cut(sums: np.ndarray, least: int, floor: float) -> tuple[float, int, int] | None:
    """``(gain, axis, position)`` of the best cut of a block of sums; of equal gains the first.

    ``sums`` is (3, bins) or (3, bins, bins); a cut lies after the position.
    """
    whole = sums.reshape(3, -1).sum(axis=1)
    best = None
    for axis in range(1, sums.ndim):
        other = tuple(a for a in range(1, sums.ndim) if a != axis)
        left = np.cumsum(sums.sum(axis=other), axis=1)[:, :-1]
        right = whole[:, None] - left
        gain = gain_of(left[0], left[1], floor) + gain_of(right[0], right[1], floor) - gain_of(whole[0], whole[1], floor)
        gain = np.where((left[2] >= least) & (right[2] >= least), gain, -np.inf)
        if gain.size:
            top = float(gain.max())
            at = int(np.flatnonzero(gain >= top - 1e-9 * abs(top))[0])
            if top > LEAST_GAIN and (best is None or top > best[0] * (1 + 1e-9)):
                best = (top, axis - 1, at)
    return best


def tree_values(sums: np.ndarray, max_leaves: int, least: int, floor: float) -> np.ndarray:
    """The Newton step of each cell's leaf in a tree grown best cut first.

    Leaves have at least ``least`` rows; a cell without rows has its leaf's step.
    """
    blocks = [tuple(slice(0, n) for n in sums.shape[1:])]
    cuts = [best_cut(sums, least, floor)]
    while len(blocks) < max_leaves:
        k = max(range(len(blocks)), key=lambda i: (cuts[i][0] if cuts[i] else -1.0, -i))
        if cuts[k] is None:
            break
        _, axis, at = cuts[k]
        block = list(blocks[k])
        middle = block[axis].start + at + 1
        for half in (slice(block[axis].start, middle), slice(middle, block[axis].stop)):
            block[axis] = half
            blocks.append(tuple(block))
            cuts.append(best_cut(sums[(slice(None), *block)], least, floor))
        del blocks[k], cuts[k]
    out = np.zeros(sums.shape[1:])
    for block in blocks:
        g, h, n = sums[(slice(None), *block)].reshape(3, -1).sum(axis=1)
        if h > floor and n >= least:
            out[block] = g / h
    return out


def term_step(fit: Fit, term: int, sums: np.ndarray) -> np.ndarray:
    """What a round adds to a term's scores, before the learning rate."""
    floor, least = fit.min_hessian, fit.min_samples_leaf
    if fit.max_leaves is None:
        return np.where((sums[1] > floor) & (sums[2] >= least), sums[0] / np.maximum(sums[1], floor), 0.0)
    if len(fit.terms[term]) > 1:
        shape = [fit.sizes[f] for f in fit.terms[term]]
        return tree_values(sums.reshape(3, *shape), fit.max_leaves, least, floor).ravel()
    # missing values are a leaf of their own besides the tree
    out = np.zeros(sums.shape[1])
    out[:-1] = tree_values(sums[:, :-1], fit.max_leaves, least, floor)
    g, h, n = sums[:, -1]
    out[-1] = g / h if h > floor and n >= least else 0.0
    return out


def advance(rows: DataFrame, fits: list[Fit], features: int, until: int | None = None) -> None:
    """Runs the models to their ends, or ``until`` so many scans: one scan a round for all of them.

    The loss that comes with a scan is that of the scores before its update.  With
    ``patience`` a model ends where the loss has not fallen by ``tolerance`` for so
    many scans, and keeps its best scores.
    """
    while True:
        active = [(i, fit) for i, fit in enumerate(fits) if fit.running and fit.done < fit.scans() and (until is None or fit.done < until)]
        if not active:
            return
        sums = {(i, t): np.zeros((3, fit.bins(t))) for i, fit in active for t in fit.turn()}
        losses: dict[int, float] = {}
        for r in collected(rows, partial(sum_batches, fits=active, features=features)):
            if r["term"] == HELD_OUT:
                losses[r["fit"]] = r["g"] / r["n"]
            else:
                sums[r["fit"], r["term"]][:, r["bin"]] = r["g"], r["h"], r["n"]
        for i, fit in active:
            if i in losses:
                fit.losses.append(losses[i])
                if fit.best is None or losses[i] < fit.best[0] - fit.tolerance:
                    fit.best = (losses[i], fit.done, [s.copy() for s in fit.scores])
                elif fit.patience is not None and fit.done - fit.best[1] >= fit.patience:
                    fit.scores, fit.running = fit.best[2], False
                    continue
            turn = fit.turn()
            lr = fit.lr if fit.cyclic else fit.lr / max(1, len(turn)) ** 0.5
            for t in turn:
                fit.scores[t] = fit.scores[t] + lr * term_step(fit, t, sums[i, t])
            fit.done += 1


# -- pairs of features ---------------------------------------------------------------


def pair_batches(batches: Iterator[pa.RecordBatch], fit: Fit, pairs: list[tuple[int, int]], features: int) -> Iterator[pa.RecordBatch]:
    """Sums of one task over the cells of every pair."""
    sums = [np.zeros((3, fit.sizes[a] * fit.sizes[b])) for a, b in pairs]
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        learns = fold != fit.hold if fit.hold is not None else np.ones(len(y), dtype=bool)
        columns = columns_of(batch, features)
        p = 1.0 / (1.0 + np.exp(-fit.raw(columns, len(y))))
        g, h = (y - p)[learns], (p * (1 - p))[learns]
        for found, (a, b) in zip(sums, pairs):
            cell, size = (columns[a] * fit.sizes[b] + columns[b])[learns], found.shape[1]
            found += (np.bincount(cell, g, size), np.bincount(cell, h, size), np.bincount(cell, minlength=size))
    yield table_of([(0, k, c, *found[:, c]) for k, found in enumerate(sums) for c in np.flatnonzero(found[2])])


def quadrant_gain(sums: np.ndarray, least: int, floor: float) -> float:
    """What the best cut of both features into four blocks gains over the best cut of one alone."""
    total = sums.reshape(3, -1).sum(axis=1)
    corner = np.cumsum(np.cumsum(sums, axis=1), axis=2)
    a, b = corner[:, :-1, -1:], corner[:, -1:, :-1]
    first = corner[:, :-1, :-1]
    blocks = [first, a - first, b - first, total[:, None, None] - a - b + first]
    if not first[0].size:
        return 0.0
    enough = np.all([x[2] >= least for x in blocks], axis=0)
    four = sum(gain_of(x[0], x[1], floor) for x in blocks)

    def two(x):
        y = total[:, None, None] - x
        return gain_of(x[0], x[1], floor) + gain_of(y[0], y[1], floor)

    return float(np.where(enough, four - np.maximum(two(a), two(b)), 0.0).max(initial=0.0))


def strongest_pairs(rows: DataFrame, fit: Fit, features: int, most: int, among: int = 32) -> list[tuple[int, int]]:
    """The pairs of features that explain most of what the model leaves, from one scan.

    Pairs of the ``among`` features of the largest spread of scores are tried.
    """
    spread = [(-float(np.ptp(fit.scores[t])), f) for t, (f, *rest) in enumerate(fit.terms) if not rest]
    pairs = list(combinations(sorted(f for _, f in sorted(spread)[:among]), 2))
    sums = [np.zeros((3, fit.sizes[a] * fit.sizes[b])) for a, b in pairs]
    if not pairs:
        return []
    for r in collected(rows, partial(pair_batches, fit=fit, pairs=pairs, features=features)):
        sums[r["term"]][:, r["bin"]] = r["g"], r["h"], r["n"]
    least = max(fit.min_samples_leaf, 1)
    gains = [(-quadrant_gain(s.reshape(3, fit.sizes[a], fit.sizes[b]), least, fit.min_hessian), a, b) for s, (a, b) in zip(sums, pairs)]
    return [(a, b) for gain, a, b in sorted(gains)[:most] if gain < 0]
