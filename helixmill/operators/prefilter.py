"""Which components of a batch of reads have no solution, or one of a single edit, found for all of them at once.

A search tries hundreds of edits one by one, and mostly in vain.  Up to two edits
can be tried for a whole batch in a few array operations: an edit that leaves one
window untrusted is out, and few are left after some windows.  Where one edit
solves a component and no two are likely enough to matter, the search would come
to this edit, too.  It runs only where something else is left, so what is found is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import search, windows
from .windows import ranges

#: Pairs of edits that are tried at a time, and those of a component from which on the search decides.
_PAIRS, _MOST_PAIRS = 300_000, 100_000
#: Bounds on likelihoods leave some room for rounding.
_ROOM = 1 - 1e-9


@dataclass
class Batch:
    """Reads one behind the other, as codes, quality and probability of each base; read i begins at offset[i] and counts up to length[i].

    model: which of the models (models, quality, actual, observed) read i has.
    """

    codes: np.ndarray
    quality: np.ndarray
    right: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    model: np.ndarray

    def prepared(self, k: int) -> Batch:
        self.ahead, self.back = windows.forward(self.codes, k), windows.backward(self.codes, k)
        self.unknown = np.append(0, np.cumsum(self.codes > 3))
        return self


def _by_component(flags: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[flags], minlength=n)


def _tops(best: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The three largest values of each owner; 0 where there are fewer."""
    order = np.lexsort((-best, owner))
    sizes = np.bincount(owner, minlength=n)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((n, 3))
    head = rank < 3
    out[owner[order][head], rank[head]] = best[order][head]
    return out


class _Trial:
    """Sets of edits, a row each: all windows that they touch, and all untrusted ones, have to be trusted."""

    def __init__(self, batch: Batch, trusted: search.TrustedSet, comp: np.ndarray, edits: list[tuple[np.ndarray, np.ndarray]], read: np.ndarray):
        self.batch, self.trusted, self.comp, self.edits, self.read = batch, trusted, comp, edits, read
        self.row = np.arange(len(comp))

    def keep(self, which: np.ndarray) -> None:
        self.comp, self.read, self.row = self.comp[which], self.read[which], self.row[which]
        self.edits = [(p[which], b[which]) for p, b in self.edits]

    def test(self, window: np.ndarray, must: bool) -> None:
        """Drop the rows whose window stays untrusted; one that is touched by no edit counts only if it `must`."""
        batch, k = self.batch, self.trusted.k
        base = batch.offset[self.read]
        real = (window >= 0) & (window + k <= batch.length[self.read])
        at = base + np.where(real, window, 0)
        ahead, back, unknown = batch.ahead[at], batch.back[at], batch.unknown[at + k] - batch.unknown[at]
        touched = np.zeros(len(at), dtype=bool)
        for place, new in self.edits:
            off = place - window
            # A window beyond the read has the first one's number in its place, which no edit may take out of range.
            inside = real & (off >= 0) & (off < k)
            old = batch.codes[base + place].astype(np.int64)
            change = np.where(inside, new - np.where(old > 3, 0, old), 0)
            off = np.clip(off, 0, k - 1)
            ahead = ahead + (change << (2 * (k - 1 - off)))
            back = back - (change << (2 * off))
            unknown = unknown - (inside & (old > 3))
            touched |= inside
        good = self.trusted.holds(np.minimum(ahead, back), unknown == 0)
        self.keep((touched & good) if must else ~real | ~touched | good)

    def solvers(self, starts: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The rows that are left after all windows."""
        k = self.trusted.k
        turn, most = 0, int(count[self.comp].max(initial=0))
        # From both ends inwards.
        while turn < most and len(self.comp):
            n = count[self.comp]
            nth = np.where(turn % 2 == 0, turn // 2, n - 1 - turn // 2)
            self.test(starts[first[self.comp] + np.clip(nth, 0, n - 1)], True)
            turn += 1
        for e in range(len(self.edits)):
            for back in range(k):
                if not len(self.comp):
                    return self.row
                self.test(self.edits[e][0] - back, False)
        return self.row


@dataclass
class Judged:
    """hopeless: search.solve() can't solve the component, whatever the components before it took; False may be wrong.

    code: SOLVED by one edit (base[i] at place[i], of this likelihood), AMBIGUOUS, or OPEN if the search decides.
    The likelihood of the components before may still rule a solution out.
    """

    hopeless: np.ndarray
    code: np.ndarray
    place: np.ndarray
    base: np.ndarray
    like: np.ndarray

    def outcomes(self) -> list[tuple | None]:
        """What search.correct() is told of each component."""
        out: list[tuple | None] = [None] * len(self.code)
        for i in np.flatnonzero(self.hopeless).tolist():
            out[i] = (search.EXHAUSTED, {}, 0.0)
        for i in np.flatnonzero(self.code == search.AMBIGUOUS).tolist():
            out[i] = (search.AMBIGUOUS, {}, 0.0)
        one = np.flatnonzero(self.code == search.SOLVED)
        for i, p, b, w in zip(one.tolist(), self.place[one].tolist(), self.base[one].tolist(), self.like[one].tolist()):
            out[i] = (search.SOLVED, {p: b}, w)
        return out


OPEN = -1
#: Places of a region at most whose pairs fit in the queue of a search.
_SHORT = 128


def hopeless(*args) -> np.ndarray:
    """For each component whether judged() finds it hopeless."""
    return judged(*args).hopeless


def judged(
    batch: Batch, trusted: search.TrustedSet, models: np.ndarray, priors: list[float], learning: bool,
    read: np.ndarray, starts: np.ndarray, starts_at: np.ndarray, region: np.ndarray, region_at: np.ndarray,
) -> Judged:
    """What can be said of each component without a search.

    Component i is of read[i], with starts[starts_at[i]:starts_at[i + 1]] and likewise its region.
    """
    n, k = len(read), trusted.k
    sizes, count = np.diff(region_at), np.diff(starts_at)
    owner = np.repeat(np.arange(n), sizes)
    at = batch.offset[read[owner]] + region
    seen, right = batch.codes[at].astype(np.int64), batch.right[at]
    p = np.asarray(priors, dtype=float)
    known = np.minimum(seen, 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = ((1 - right) / (right * p[known]))[:, None] * models[batch.model[read[owner]], batch.quality[at], :, known] * p
    weight[np.arange(len(at)), known] = 0.0
    weight[seen > 3] = 3.0 * p
    weight = np.nan_to_num(weight, nan=2.0, posinf=2.0)
    best = weight.max(axis=1, initial=0.0)
    # An edit that makes a set likelier: the search decides, as it does in all components of that read.
    odd = np.zeros(len(batch.offset), dtype=bool)
    odd[read[owner[best > 1]]] = True
    doubtful = _by_component(right < search.DOUBTFUL, owner, n)
    unknown = _by_component(seen > 3, owner, n)
    own = np.full(n, search.LEAST_LEARNING if learning else search.LEAST)
    if not learning:
        for least, likely in (search.CAREFUL, search.VERY_CAREFUL):
            own[doubtful >= least] = likely
    exact, own = own, own * _ROOM
    none = (sizes == 0) | (doubtful >= (search.QUIT_LEARNING if learning else search.QUIT)) | (unknown > (search.MOST_UNKNOWN_LEARNING if learning else search.MOST_UNKNOWN))
    top = np.cumprod(_tops(best, owner, n), axis=1)
    edits = (top >= own[:, None]).sum(axis=1)
    open_ = ~none & (odd[read] | (edits > 2))
    none |= ~open_ & (count > k * edits)
    ask = ~none & ~open_
    possible = np.zeros(n, dtype=bool)
    first, last = starts[starts_at[:-1]], starts[starts_at[1:] - 1]

    def tried(comp: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        rows = _Trial(batch, trusted, comp, sets, read[comp]).solvers(starts, starts_at[:-1], count)
        possible[comp[rows]] = True
        return rows

    row, new = np.nonzero((weight >= own[owner][:, None]) & ask[owner][:, None] & ((region >= last[owner]) & (region < first[owner] + k))[:, None])
    rows = tried(owner[row], [(region[row], new)])
    row, new = row[rows], new[rows]
    out = Judged(possible, np.full(n, OPEN), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n))
    if len(row):
        # In the order of the search: likelihood, rank by doubt and place, base.
        order = np.lexsort((new, region[row], right[row], -weight[row, new], owner[row]))
        row, new = row[order], new[order]
        comp, like = owner[row], weight[row, new]
        head = np.append(True, comp[1:] != comp[:-1])
        which, place, base, one = comp[head], region[row[head]], new[head], like[head]
        bound = one * (search.SPREAD / 2 if learning else search.SPREAD)
        # Edits down to the bound have all been tried, and no two places are as likely together.
        sure = (bound >= exact[which]) & (top[which, 1] < bound * _ROOM) & (sizes[which] <= _SHORT)
        near = np.bincount(np.cumsum(head) - 1, weights=like >= np.repeat(bound, np.diff(np.append(np.flatnonzero(head), len(head)))))
        out.code[which[sure]] = np.where(near > 1, search.AMBIGUOUS, search.SOLVED)[sure]
        out.place[which], out.base[which], out.like[which] = place, base, one
    # Pairs: one of both is likelier than the root of the bound.
    ask &= ~possible & (edits == 2)
    row, new = np.nonzero((weight * top[owner, :1] >= own[owner][:, None]) & ask[owner][:, None] & (weight > 0))
    mine = owner[row]
    likely = weight[row, new]
    sizes = np.bincount(mine, minlength=n)
    begin = np.cumsum(sizes) - sizes
    strong = np.flatnonzero(likely**2 >= own[mine] * _ROOM)
    pairs = sizes * np.bincount(mine[strong], minlength=n)
    possible |= pairs > _MOST_PAIRS
    strong = strong[pairs[mine[strong]] <= _MOST_PAIRS]
    turn = np.cumsum(sizes[mine[strong]]) // _PAIRS
    for part in np.split(strong, np.flatnonzero(np.diff(turn)) + 1) if len(strong) else []:
        one = np.repeat(part, sizes[mine[part]])
        two = ranges(begin[mine[part]], sizes[mine[part]])
        comp, p1, p2 = mine[one], region[row[one]], region[row[two]]
        fit = (p1 != p2) & (likely[one] * likely[two] >= own[comp])
        for edge in (first[comp], last[comp]):
            fit &= ((p1 >= edge) & (p1 < edge + k)) | ((p2 >= edge) & (p2 < edge + k))
        one, two, comp = one[fit], two[fit], comp[fit]
        tried(comp, [(region[row[one]], new[one]), (region[row[two]], new[two])])
    out.hopeless = ~possible & ~open_
    return out
