"""Mixture models of coverage: errors against genuine k-mers of one to thirty copies.

The fit runs on the driver over a histogram, which is small whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from helixmill.functions import dna

from .coverage import stratified_sample

COPIES = 30
#: An extreme is a coverage from this many times the peak on.
EXTREME = 1.25 * COPIES
MOST_INT, MOST_Q, GRID = 40, 25.0, 0.01


def zeta(s: float, terms: int = 40) -> float:
    """Riemann's zeta for s > 1, by Euler-Maclaurin summation."""
    head = sum(i**-s for i in range(1, terms))
    tail = terms ** (1 - s) / (s - 1) + 0.5 * terms**-s + s * terms ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * terms ** (-s - 3) / 720
    return head + tail


def copy_shares(p: float) -> np.ndarray:
    """The zeta distribution with exponent p + 1 over 1..COPIES, not renormalised."""
    return np.arange(1, COPIES + 1) ** -(p + 1.0) / zeta(p + 1)


def gamma_cdf(x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    """The regularised lower incomplete gamma function of x / scale."""
    return np.array([_lower_gamma(shape, v / scale) for v in np.atleast_1d(x)])


def _lower_gamma(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(500):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return min(1.0, total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def gamma_density(x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    with np.errstate(divide="ignore"):
        out = np.exp((shape - 1) * np.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale))
    at_zero = np.inf if shape < 1 else 1 / scale if shape == 1 else 0.0
    return np.where(x == 0, at_zero, out)


def _genuine(cov: np.ndarray, p_error: float, copies: float, mean: float, variance: float) -> np.ndarray:
    j = np.arange(1, COPIES + 1)[:, None]
    density = np.exp(-((cov[None, :] - j * mean) ** 2) / (2 * j * variance)) / np.sqrt(2 * np.pi * j * variance)
    return (1 - p_error) * (copy_shares(copies)[:, None] * density).sum(axis=0)


@dataclass(frozen=True)
class IntModel:
    copies: float
    p_error: float
    shape: float
    mean: float
    variance: float

    def error(self, cov: np.ndarray) -> np.ndarray:
        """Pareto mass of [cov, cov + 1)."""
        cov = np.asarray(cov, dtype=float)
        return self.p_error * (cov**-self.shape - (cov + 1) ** -self.shape)

    def genuine(self, cov: np.ndarray) -> np.ndarray:
        return _genuine(np.asarray(cov, dtype=float), self.p_error, self.copies, self.mean, self.variance)

    def ratios(self, most: int = MOST_INT) -> np.ndarray:
        cov = np.arange(1, most + 1)
        with np.errstate(divide="ignore"):
            return self.error(cov) / self.genuine(cov)

    def cutoff(self, goal: float) -> int:
        """The least coverage at which errors are less than `goal` times as likely as genuine k-mers."""
        below = np.flatnonzero(self.ratios() < goal)
        if not len(below):
            raise ValueError("no coverage up to 40 reaches the ratio: choose the cutoff by hand")
        return int(below[0]) + 1


@dataclass(frozen=True)
class QModel:
    copies: float
    p_error: float
    shape: float
    scale: float
    mean: float
    variance: float

    def error_mass(self, cov: np.ndarray) -> np.ndarray:
        top = np.ceil(cov).astype(int)
        cdf = gamma_cdf(np.arange(0, top.max() + 1), self.shape, self.scale)
        return self.p_error * (cdf[top] - cdf[top - 1])

    def genuine(self, cov: np.ndarray) -> np.ndarray:
        return _genuine(np.asarray(cov, dtype=float), self.p_error, self.copies, self.mean, self.variance)

    def ratios(self, cov: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", over="ignore"):
            return self.p_error * gamma_density(cov, self.shape, self.scale) / self.genuine(cov)

    def cutoff(self, goal: float) -> float:
        """The coverage whose ratio is closest to `goal`, on a grid from the error density's peak to 25."""
        grid = np.round(np.arange(0, 30 + GRID / 2, GRID), 2)
        start = grid[int(np.argmax(gamma_density(grid, self.shape, self.scale)))]
        tried = np.concatenate([[0.0], grid[(grid >= start) & (grid <= MOST_Q)]])
        with np.errstate(invalid="ignore"):
            off = np.abs(self.ratios(tried) - goal)
        best = float(tried[int(np.argmin(np.where(np.isnan(off), np.inf, off)))])
        if best <= 0:
            raise ValueError("the model gives a cutoff of 0: choose the cutoff by hand")
        return best


def peak(cov: np.ndarray, num: np.ndarray, least_rise: float = 0.0) -> int:
    """The first coverage with the most k-mers behind the first valley of a histogram.

    Bins from 1 on that are not among the ascending `cov` are empty; only their
    neighbours are looked at, so a coverage may be as high as it likes.
    """
    cov, num = np.asarray(cov)[np.asarray(num) > 0], np.asarray(num)[np.asarray(num) > 0]
    before, under = np.append(0, cov[:-1]), np.append(0, num[:-1])
    # Behind an empty bin the descent has ended: at the second place of a gap, or at bin 2 if bin 1 is empty.
    gap = cov > before + 1
    turns = np.where(gap, np.maximum(before + 2, 2), cov)[gap | ((num >= under) & (cov > 1))]
    if not len(turns):
        raise ValueError("no coverage peak: the histogram only falls")
    turn = turns.min()
    behind = np.flatnonzero(cov >= turn)
    top = behind[np.argmax(num[behind])]
    valley = num[cov == turn - 1]
    if len(valley) and num[top] / valley[0] < least_rise:
        raise ValueError("no reliable coverage peak: choose the cutoff by hand")
    return int(cov[top])


def minimise(f, x: np.ndarray, rounds: int, step: float = 1e-3, tolerance: float = 1e-8) -> np.ndarray:
    """Quasi-Newton descent with central differences; points where f is not finite are refused."""
    x = np.array(x, dtype=float)
    value, n = f(x), len(x)
    if not np.isfinite(value):
        raise ValueError("the start is not feasible")

    def gradient(at: np.ndarray) -> np.ndarray:
        g = np.zeros(n)
        for i in range(n):
            e = np.zeros(n)
            e[i] = step
            up, down = f(at + e), f(at - e)
            g[i] = (up - down) / (2 * step) if np.isfinite(up) and np.isfinite(down) else 0.0
        return g

    inverse, g = np.eye(n), gradient(x)
    for _ in range(rounds):
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(n), -g
        length, slope = 1.0, d @ g
        while length > 1e-12 and not (np.isfinite(new := f(x + length * d)) and new <= value + 1e-4 * length * slope):
            length *= 0.2
        if length <= 1e-12:
            if np.array_equal(inverse, np.eye(n)):
                break
            inverse = np.eye(n)
            continue
        s = length * d
        next_g = gradient(x + s)
        y = next_g - g
        done = abs(value - new) <= tolerance * (abs(value) + tolerance)
        x, value, g = x + s, new, next_g
        if done:
            break
        if (sy := s @ y) > 1e-12:
            left = np.eye(n) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
    return x


def int_likelihood(model: IntModel, cov: np.ndarray, num: np.ndarray) -> float:
    """Minus the log-likelihood of a histogram; infinite for invalid parameters."""
    if min(model.copies, model.shape, model.variance) <= 0:
        return math.inf
    with np.errstate(all="ignore"):
        out = -float((np.log(model.error(cov) + model.genuine(cov)) * num).sum())
    return out if math.isfinite(out) else math.inf


def fit_int(cov: np.ndarray, num: np.ndarray, rounds: int = 5000) -> IntModel:
    """Fit to a histogram (coverage, number of k-mers)."""
    order = np.argsort(cov)
    cov, num = np.asarray(cov)[order], np.asarray(num, dtype=float)[order]
    top = peak(cov, num)
    keep = cov < EXTREME * top
    cov, num = cov[keep].astype(float), num[keep]
    return IntModel(*map(float, minimise(lambda x: int_likelihood(IntModel(*x), cov, num), np.array([3, 0.9, 3, top, 5 * top]), rounds)))


def q_likelihood(model: QModel, cov: np.ndarray, num: np.ndarray) -> float:
    if min(model.copies, model.shape, model.scale, model.variance) <= 0 or not 0 < model.p_error < 1:
        return math.inf
    with np.errstate(all="ignore"):
        out = -float((np.log(model.error_mass(cov) + model.genuine(cov)) * num).sum())
    return out if math.isfinite(out) else math.inf


def fit_q(values: np.ndarray, rounds: int = 1000, least_rise: float = 1.5) -> QModel:
    """Fit to a sample of real-valued coverages; equal ones are counted once."""
    values = np.asarray(values, dtype=float)
    top = peak(*np.unique(np.maximum(np.ceil(values), 1).astype(np.int64), return_counts=True), least_rise)
    values = values[values < EXTREME * top]
    cov, num = np.unique(np.where(values == 0, 1e-12, values), return_counts=True)
    return QModel(*map(float, minimise(lambda x: q_likelihood(QModel(*x), cov, num), np.array([2, 0.9, 0.8, 0.5, top, 3 * top]), rounds)))


def cutoffs_by_at(counts: DataFrame, k: int, goal: float = 200, sample: int = 15_000, value: str = "q") -> DataFrame:
    """(at, cutoff) for AT counts 0..k, each fitted on its own sample of k-mers.

    Counts of 0 and k, and those whose k-mers have no clear peak, take the
    cutoff of their nearest neighbour.  One group holds at most `sample` rows.
    """
    import pandas as pd

    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            found = fit_q(pdf["cov"].to_numpy()).cutoff(goal)
        except ValueError:
            found = float("nan")
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "cutoff": [found]})

    if "packed" in counts.columns:
        counts = counts.withColumn("at", dna.packed_at_count("packed", k))
    rows = stratified_sample(counts, sample).selectExpr("at", f"CAST({value} AS DOUBLE) AS cov")
    found = {r["at"]: r["cutoff"] for r in rows.groupBy("at").applyInPandas(fit_group, "at int, cutoff double").collect()}
    good = sorted(a for a, c in found.items() if c is not None and c == c and 0 < a < k)
    if not good:
        raise ValueError("no AT count has a clear coverage peak")
    cutoffs = [(a, float(found[min(good, key=lambda g: (abs(g - a), g))])) for a in range(k + 1)]
    return counts.sparkSession.createDataFrame(cutoffs, "at int, cutoff double")


