"""Class-conditional Kneser-Ney models of the expressions of a text.

An expression is a whole word, A-Z in lower case; in scripts written without
blanks it is a character with the next one, so that every character is read.
Counts are continuation counts: in how many documents an expression occurs,
however often in each.  Each class gives an expression the absolutely
discounted share that it has among the class's own counts, and the mass so
freed goes to one lower-order model which both classes share, the counts of
both together.  Words' beginnings, their first PREFIX bytes, are counted and
shared out likewise.  A word is judged by its own ratio as far as its counts
can't be chance, and by that of its beginning for the rest (so inflected forms
help each other); for a beginning the rest is 0, where both classes agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tokens import LOWER, hashes, words

PREFIX = 4
DISCOUNT = 0.75
#: Counts so many deviations from an even share are half trusted, and how soon the trust grows.
DEVIATIONS, STEEPNESS = 4.0, 4.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True

#: Characters of scripts without blanks by the first two bytes of their UTF-8:
#: Thai, Lao, Burmese, Khmer, kana, Chinese (the rarer ones have four bytes).
_UNSPACED = np.zeros(65536, dtype=bool)
for _a, _b in ((0xE0B8, 0xE0BC), (0xE180, 0xE183), (0xE19E, 0xE1A0), (0xE380, 0xEA00), (0xEFA4, 0xEFAC), (0xF0A0, 0xF0C0)):
    _UNSPACED[_a:_b] = True


def expressions(data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, its text) of each expression: its beginning in the key's high half, 32 bits of its hash in the low one."""
    data = LOWER[data]
    start, end, doc = _spans(data, offset)
    key, last = np.zeros(len(start), dtype=np.uint64), max(len(data) - 1, 0)
    for k in range(PREFIX):
        at = start + k
        key = (key << np.uint64(8)) | np.where(at < end, data[np.minimum(at, last)] if len(data) else 0, 0).astype(np.uint64)
    return ((key << np.uint64(32)) | (hashes(data, start, end) >> np.uint64(32))).view(np.int64), doc


def _spans(data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the expressions."""
    w = words(data, offset, _LETTER, hashed=False)
    if not len(data) or data.max() < 0xE0:
        return w.start, w.end, w.doc
    # Characters of unspaced scripts, where each begins and ends.
    two = (data[:-1].astype(np.int64) << 8) | data[1:]
    at = np.flatnonzero(_UNSPACED[two] & (data[:-1] >= 0xE0))
    if not len(at):
        return w.start, w.end, w.doc
    to = at + 3 + (data[at] >= 0xF0)
    dense = np.zeros(len(data) + 4, dtype=bool)
    for k in range(4):
        dense[(at + k)[at + k < to]] = True
    # What is left of each run around them stays a word.
    rest = words(np.where(dense[: len(data)], np.uint8(32), data), offset, _LETTER, hashed=False)
    text = np.searchsorted(offset, at, "right") - 1
    pair = np.append((to[:-1] == at[1:]) & (text[:-1] == text[1:]), False)
    alone = ~pair & ~np.append(False, pair[:-1])
    first = pair | alone
    upto = np.where(pair, np.append(to[1:], 0), to)
    start, end, doc = np.append(rest.start, at[first]), np.append(rest.end, upto[first]), np.append(rest.doc, text[first])
    order = np.argsort(start)
    return start[order], end[order], doc[order]


def once(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct expressions of each text, sorted by text and key."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def _beginnings(key: np.ndarray) -> np.ndarray:
    return (key >> 32) & 0xFFFFFFFF


@dataclass
class Ratios:
    """Sorted expressions, each with log P(it | toxic) - log P(it | ordinary).

    `ratio` is that of `key`; `lower_ratio` is that of any other word that
    begins as `lower` says.
    """

    key: np.ndarray
    ratio: np.ndarray
    lower: np.ndarray
    lower_ratio: np.ndarray

    def means(self, data: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """For each text the difference of the length-normalised log-likelihoods.

        Words whose beginning neither class has seen cost both the same; a text
        without words has 0.
        """
        n = len(offset) - 1
        key, doc = expressions(data, offset)
        if not len(key) or not len(self.key):
            return np.zeros(n)
        ratio = _found(self.key, self.ratio, key, _found(self.lower, self.lower_ratio, _beginnings(key), 0.0))
        return np.bincount(doc, ratio, n) / np.maximum(np.bincount(doc, minlength=n), 1)


def _found(keys: np.ndarray, values: np.ndarray, key: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
    """The value of each key, where it is among the sorted keys."""
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, values[at], otherwise)


def shares(ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each expression in either class, from its counts; each sums to 1.

    Counts lose an absolute discount, and what a class loses goes to the shared
    lower order, the counts of both.  Both classes lose the same share of their
    mass: the smaller one DISCOUNT of a count, the larger one proportionally
    more.  Else the class with fewer texts would be the likelier source of
    everything rare.
    """
    totals, out = (ordinary.sum(), toxic.sum()), []
    for count, total in zip((ordinary, toxic), totals):
        own = np.maximum(count / total - DISCOUNT / min(totals), 0)
        out.append(own + (1 - own.sum()) * (ordinary + toxic) / sum(totals))
    return out[0], out[1]


def _log_ratio(ordinary: np.ndarray, toxic: np.ndarray, lower: np.ndarray | float = 0.0) -> np.ndarray:
    """log P(it | toxic) - log P(it | ordinary) as far as the counts can't be chance, else `lower`."""
    p = shares(ordinary, toxic)
    even = (ordinary + toxic) * (toxic.sum() / (ordinary.sum() + toxic.sum()))
    trust = 1 / (1 + np.exp(STEEPNESS * (DEVIATIONS - np.abs(toxic - even) / np.sqrt(even + 1))))
    return trust * (np.log(p[1]) - np.log(p[0])) + (1 - trust) * lower


def fit(key: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Ratios:
    """The ratios from the counts of each expression (sorted) in either class.

    Without counts in both classes there is nothing to compare.
    """
    if min(ordinary.sum(), toxic.sum()) == 0:
        return Ratios(key[:0], np.zeros(0), key[:0], np.zeros(0))
    lower, of = np.unique(_beginnings(key), return_inverse=True)
    lower_ratio = _log_ratio(*(np.bincount(of, count, len(lower)) for count in (ordinary, toxic)))
    return Ratios(key, _log_ratio(ordinary, toxic, lower_ratio[of]), lower, lower_ratio)
