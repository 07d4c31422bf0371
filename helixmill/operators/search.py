"""Best-first search for the likeliest edits that make a read's windows trusted.

Pure functions over one read; correct.py runs them in Arrow batches.  Where two
edits are equally likely the one with the lower place, then the lower base,
comes first, so results do not depend on partitions.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from . import windows

#: Thresholds on likelihoods, and gates on the number of doubtful bases.
SPREAD, LEAST, LEAST_LEARNING = 0.1, 1e-6, 1e-5
DOUBTFUL, QUIT, VERY_CAREFUL, CAREFUL, QUIT_LEARNING = 0.99, 13, (11, 0.05), (9, 0.001), 8
MOST_UNKNOWN, MOST_UNKNOWN_LEARNING = 2, 1
QUEUE = 400_000
#: Entries of a queue whose windows are looked up together.
AHEAD = 48
SOLVED, AMBIGUOUS, GAVE_UP, EXHAUSTED = 0, 1, 2, 3


class TrustedSet:
    """Sorted packed canonical k-mers, an array in memory or in a mapped file."""

    def __init__(self, packed: np.ndarray, k: int):
        self.packed, self.k = packed, k

    def holds(self, kmers: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether each canonical k-mer is trusted; those that are not `known` have an unknown base and are not."""
        if not len(self.packed):
            return np.zeros(kmers.shape, dtype=bool)
        at = np.minimum(np.searchsorted(self.packed, kmers), len(self.packed) - 1)
        return known & (self.packed[at] == kmers)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """For each window of the codes whether it is trusted; one with an unknown base is not."""
        own = Windows(codes, self.k)
        return self.holds(np.minimum(own.ahead, own.back), own.unknown == 0)


class TrustedBits(TrustedSet):
    """The same as a bit for each k-mer, 8 a byte, the lowest first."""

    def holds(self, kmers: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known & ((self.packed[kmers >> 3] >> (kmers & 7).astype(np.uint8)) & 1).astype(bool)


class Pending(Exception):
    """Windows were asked for that are not known yet; `state` is where the search goes on when they are."""

    def __init__(self, state: tuple):
        super().__init__()
        self.state = state


class AskedSet(TrustedSet):
    """The part of a trusted set that is known so far; what else is asked for is noted in `missing`."""

    def __init__(self, kmers: np.ndarray, trusted: np.ndarray, k: int):
        order = np.argsort(kmers)
        super().__init__(kmers[order], k)
        self.trusted = trusted[order]
        self.missing: set[int] = set()

    def holds(self, kmers: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.packed, kmers), max(0, len(self.packed) - 1))
        told = self.packed[at] == kmers if len(self.packed) else np.zeros(kmers.shape, dtype=bool)
        self.missing.update(kmers[known & ~told].tolist())
        return known & told & self.trusted[at] if len(self.packed) else told


class Windows:
    """The packed windows of a read on both strands, unknown bases as A, and how many unknown ones each has."""

    def __init__(self, codes: np.ndarray, k: int):
        codes = np.asarray(codes)
        self.codes, self.k = codes, k
        own = np.where(codes > 3, 0, codes).astype(np.uint8)
        self.ahead, self.back = windows.forward(own, k), windows.backward(own, k)
        total = np.append(0, np.cumsum(codes > 3))
        self.unknown = total[k:] - total[:-k] if len(codes) >= k else total[:0]

    def edited(self, entries: list[tuple], trusted: TrustedSet) -> list[int]:
        """For each queue entry the untrusted windows, as bits, after testing again those around its last edit."""
        k, n = self.k, len(self.ahead)
        deepest = max(len(e[2]) for e in entries)
        place = np.array([[p for p, _ in e[2]] + [-2 * k] * (deepest - len(e[2])) for e in entries])
        base = np.array([[b for _, b in e[2]] + [0] * (deepest - len(e[2])) for e in entries])
        old = self.codes[np.maximum(place, 0)]
        last = np.array([e[2][-1][0] for e in entries])
        window = last[:, None] + np.arange(1 - k, 1)
        real = (window >= 0) & (window < n)
        window = np.clip(window, 0, n - 1)
        ahead, back, unknown = self.ahead[window], self.back[window], self.unknown[window]
        for d in range(deepest):
            off = place[:, d, None] - window
            inside = (off >= 0) & (off < k)
            change = np.where(inside, (base[:, d] - np.where(old[:, d] > 3, 0, old[:, d]))[:, None], 0)
            off = np.clip(off, 0, k - 1)
            ahead = ahead + (change << (2 * (k - 1 - off)))
            back = back - (change << (2 * off))
            unknown = unknown - (inside & (old[:, d] > 3)[:, None])
        bad = real & ~trusted.holds(np.minimum(ahead, back), real & (unknown == 0))
        powers = 1 << np.arange(k, dtype=np.int64)
        out = []
        for e, low, tested, found in zip(entries, (last - k + 1).tolist(), (real @ powers).tolist(), (bad @ powers).tolist()):
            out.append(e[3] & ~(tested << low) | found << low if low >= 0 else e[3] & ~(tested >> -low) | found >> -low)
        return out


@dataclass
class Read:
    """codes: 0..3, 4 unknown; quality and right: phred value and probability of each base; all up to the trim."""

    codes: np.ndarray
    quality: np.ndarray
    right: np.ndarray


def edit_weights(read: Read, place: int, model: np.ndarray, priors: list[float]) -> list[tuple[int, float]]:
    """(base, factor of the likelihood) for each base that may stand at a place instead."""
    seen = int(read.codes[place])
    if seen > 3:
        return [(b, priors[b] * 3.0) for b in range(4)]
    odds = (1 - read.right[place]) / (read.right[place] * priors[seen])
    return [(b, odds * model[read.quality[place], b, seen] * priors[b]) for b in range(4) if b != seen]


def solve(
    read: Read, region: list[int], starts: list[int], trusted: TrustedSet, model: np.ndarray, priors: list[float], learning: bool, so_far: float, state: tuple | None = None, ahead: int = AHEAD
) -> tuple[int, dict[int, int], float]:
    """(outcome, edits by place, their likelihood) for one component.

    `so_far` is the likelihood of the components before.  Raises Pending with
    a state (queue, best) if the trusted set has to be asked first; with that
    state the search goes on.
    """
    if not region:
        return EXHAUSTED, {}, 0.0
    k = trusted.k
    order = sorted(region, key=lambda i: (read.right[i], i))
    doubtful = sum(read.right[i] < DOUBTFUL for i in region)
    unknown = sum(read.codes[i] > 3 for i in region)
    spread, least = (SPREAD / 2, LEAST_LEARNING) if learning else (SPREAD, LEAST)
    if doubtful >= (QUIT_LEARNING if learning else QUIT) or unknown > (MOST_UNKNOWN_LEARNING if learning else MOST_UNKNOWN):
        return GAVE_UP, {}, 0.0
    own = least
    if not learning:
        own = next((t for n, t in (VERY_CAREFUL, CAREFUL) if doubtful >= n), least)
    if len(starts) > k * _most_edits(read, region, model, priors, max(own, least / so_far)):
        return EXHAUSTED, {}, 0.0
    weights = [edit_weights(read, i, model, priors) for i in order]
    untrusted = sum(1 << s for s in starts)

    # An entry: likelihood, rank in the order from which edits may be added, edits, windows untrusted before the last one.
    if state is None:
        heap = [(-w, rank + 1, ((order[rank], b),), untrusted) for rank in range(len(order)) for b, w in weights[rank]]
        heapq.heapify(heap)
        best: tuple[float, tuple] | None = None
    else:
        heap, best = state
    own_windows, tested = Windows(read.codes, k), {}
    while heap:
        if len(heap) > QUEUE:
            return GAVE_UP, {}, 0.0
        negative, rank, edits, before = heap[0]
        like = -negative
        if like < best[0] * spread if best else like < own or so_far * like < least:
            break
        if edits not in tested:
            # Those at the head of the queue come next, more or less.
            near = [e for e in heap[:ahead] if e[2] not in tested]
            tested.update(zip((e[2] for e in near), own_windows.edited(near, trusted)))
            if getattr(trusted, "missing", None):
                raise Pending((heap, best))
        after = tested.pop(edits)
        heapq.heappop(heap)
        if not after:
            if best:
                return AMBIGUOUS, {}, 0.0
            best = (like, edits)
        if (after.bit_count() - before.bit_count()) * 3 >= k:
            continue
        for r in range(rank, len(order)):
            added = False
            for b, w in weights[r]:
                next_like = like * w
                if next_like < best[0] * spread if best else next_like < own * spread or so_far * next_like < least * spread:
                    continue
                heapq.heappush(heap, (-next_like, r + 1, (*edits, (order[r], b)), after))
                added = True
            if not added:
                break
    return (SOLVED, dict(best[1]), best[0]) if best else (EXHAUSTED, {}, 0.0)


def _most_edits(read: Read, region: list[int], model: np.ndarray, priors: list[float], least: float) -> int:
    """How many edits at different places can be likelier than `least` together.

    An edit touches k windows, so a component with more windows than these
    edits can touch has no solution, and needs no search.
    """
    codes, right = read.codes[region], read.right[region]
    p = np.asarray(priors)
    known = np.minimum(codes, 3)
    likeliest = model[read.quality[region], :, known] * p
    likeliest[np.arange(len(codes)), known] = 0.0
    best = np.where(codes > 3, 3.0 * p.max(), likeliest.max(axis=1) * (1 - right) / (right * p[known]))
    together = np.cumprod(np.sort(best)[::-1])
    # With some room for rounding: the bound may only be too high.
    return int(np.max(np.flatnonzero(together >= least * (1 - 1e-9)), initial=-1)) + 1


def correct(
    read: Read, comps: list[tuple[list[int], list[int], list[int]]], trusted: TrustedSet, model: np.ndarray, priors: list[float], learning: bool = False, state: tuple | None = None, ahead: int = AHEAD, told: tuple | None = None
) -> tuple[dict[int, int], int, bool, float]:
    """(edits, length to keep, whether all components were solved, likelihood).

    comps: (starts, chopped region, whole region) in order.  A component that
    can't be solved ends the read: before the region if it was ambiguous, else
    before its first untrusted window.  Edits of earlier components stay.
    Raises Pending like solve(); its state (to be given back, may be pickled)
    holds the components done, the outcome of the chopped region, and the queue.
    told: for the chopped and for the whole regions a list of what solve() would
    say of each component if none came before it, None where that is not known.
    """
    at, edits, so_far, first, inner = state or (0, {}, 1.0, None, None)

    least = LEAST_LEARNING if learning else LEAST

    def solved(region: list[int], known: tuple | None) -> tuple[int, dict[int, int], float]:
        nonlocal inner
        if known:
            return known if known[0] != SOLVED or so_far * known[2] >= least else (EXHAUSTED, {}, 0.0)
        try:
            out = solve(read, region, starts, trusted, model, priors, learning, so_far, inner, ahead)
        except Pending as waits:
            raise Pending((at, edits, so_far, first, waits.state)) from None
        inner = None
        return out

    while at < len(comps):
        starts, chopped, whole = comps[at]
        if first is None:
            code, found, like = solved(chopped, told and told[0][at])
            if code != SOLVED and len(chopped) == len(whole):
                return edits, chopped[0] if code == AMBIGUOUS else starts[0], False, so_far
            first = code
        if first != SOLVED:
            code, found, like = solved(whole, told and told[1][at])
            if code != SOLVED:
                cut = (chopped[0] if first == AMBIGUOUS else whole[0]) if code == AMBIGUOUS else starts[0]
                return edits, cut, False, so_far
        edits = edits | found
        so_far *= like
        at, first = at + 1, None
    return edits, len(read.codes), True, so_far
