"""A generalised additive model with pairwise interactions, boosted in cycles.

Each feature has a lookup table over its bins, each chosen pair of features one
over a grid of coarser bins.  Training goes round the features again and again,
each time adding a small step of a shallow tree fitted to what the others leave
unexplained; then the same over the pairs that explain most of the rest.  A
row's score is the sum of its table entries, one addition a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

BINS, GRID, PAIRS = 48, 8, 10
RATE, CYCLES, PAIR_CYCLES = 0.08, 250, 80
_LEAST_WEIGHT, _PRIOR = 4.0, 1.0


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """The model's logit for each row of x (rows, features)."""
        out = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            out += values[np.searchsorted(edges, x[:, j], "right")]
        cells = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for j in {k for p in self.pairs for k in p}}
        for (a, b), grid in zip(self.pairs, self.grids):
            out += grid[cells[a], cells[b]]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin on the right) of the best cut of the bins; gain 0: none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + _PRIOR) + gr**2 / (hr + _PRIOR) - g.sum() ** 2 / (h.sum() + _PRIOR)
    gain[(hl < _LEAST_WEIGHT) | (hr < _LEAST_WEIGHT)] = 0
    best = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[best]), best + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step for each bin by a tree of up to three leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        found = [(*_split(g[a:b], h[a:b]), a, b) for a, b in leaves]
        gain, cut, a, b = max(found)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + _PRIOR)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step for each cell: one cut along one axis, then one on each side along the other."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        gain, cut = _split(a.sum(axis=1), b.sum(axis=1))
        if gain <= 0:
            continue
        out = np.zeros_like(a)
        for side in (slice(0, cut), slice(cut, len(a))):
            gs, hs = a[side].sum(axis=0), b[side].sum(axis=0)
            more, at = _split(gs, hs)
            parts = [slice(0, at), slice(at, len(gs))] if more > 0 else [slice(0, len(gs))]
            gain += more
            for part in parts:
                out[side, part] = gs[part].sum() / (hs[part].sum() + _PRIOR)
        if gain > best[0]:
            best = (gain, out.T if flip else out)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Gam:
    """Fit to labels y (0 or 1).  The rows `held` only say after how many cycles to stop;
    then all rows are used for as many.  One class alone: its share is the score."""
    cycles = pair_cycles = None
    if held.any() and (~held).any() and 0 < y[~held].sum() < (~held).sum():
        cycles, pair_cycles = _boost(x[~held], y[~held], CYCLES, PAIR_CYCLES, (x[held], y[held]))[1:]
    return _boost(x, y, cycles or CYCLES // 4, PAIR_CYCLES // 4 if pair_cycles is None else pair_cycles)[0]


def _loss(f: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -f, f)).mean())


def _boost(x, y, cycles, pair_cycles, judge=None) -> tuple[Gam, int, int]:
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))), [_edges(x[:, j], BINS) for j in range(x.shape[1])], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_edges(x[:, j], GRID) for j in range(x.shape[1])]
    if not 0 < y.sum() < len(y):
        return model, 0, 0
    f = np.full(len(y), model.base)
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    def rounds(n: int, step) -> int:
        least, best = np.inf, 0
        for cycle in range(n):
            step()
            if judge is not None:
                loss = _loss(model.logits(judge[0]), judge[1])
                if loss < least - 1e-6:
                    least, best = loss, cycle + 1
                elif cycle - best > 20:
                    break
        return best if judge is not None else n

    def features() -> None:
        for j, at in enumerate(bins):
            g, h = gradients()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(at, g, n), np.bincount(at, h, n))
            model.tables[j] += step
            f[:] += step[at]

    done = rounds(cycles, features)
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    g, h = gradients()
    gains = []
    for a, b in combinations(range(x.shape[1]), 2):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        at = cells[a] * shape[1] + cells[b]
        sums, weights = np.bincount(at, g, shape[0] * shape[1]), np.bincount(at, h, shape[0] * shape[1])
        gains.append((float((sums**2 / (weights + _PRIOR)).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.grids = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]

    def interactions() -> None:
        for k, (a, b) in enumerate(model.pairs):
            g, h = gradients()
            shape = model.grids[k].shape
            at = cells[a] * shape[1] + cells[b]
            step = RATE * _grid_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))
            model.grids[k] += step
            f[:] += step[cells[a], cells[b]]

    return model, done, rounds(pair_cycles, interactions)
