"""Words of whole Arrow columns at once: spans and hashes by numpy, no Python strings.

All texts of a slice lie in one UTF-8 buffer.  A byte table says what belongs
to a word; that is exact for classes that treat all non-ASCII characters alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in slices of about so many bytes (a longer text is one slice),
#: so that the numpy arrays over them stay small.
SLICE_BYTES = 500_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False

ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(_BYTE)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Texts:
    """The rows of a slice: data[offset[i]:offset[i + 1]] is text i in UTF-8."""

    batch: pa.RecordBatch
    data: np.ndarray
    offset: np.ndarray


@dataclass
class Words:
    """Word w covers data[start[w]:end[w]] of text doc[w]; text i has words first[i]..first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches, column: str = "text", most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of Arrow batches, in slices of at most `most` bytes of text or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield Texts(batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to
    trim_memory()


def trim_memory() -> None:
    """Give back what the allocators keep for later: the worker lives on, and it would add up over stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def words(data: np.ndarray, offset: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    """Maximal runs of bytes in `table`, in order; a run ends where its text does."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = offset[:-1][offset[:-1] < offset[1:]]
    starts[edge] = inside[1:-1][edge]
    last = offset[1:][offset[:-1] < offset[1:]] - 1
    ends[last] = inside[1:-1][last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offset)
    doc = np.repeat(np.arange(len(offset) - 1), np.diff(first))
    return Words(start, end, doc, first, hashes(data, start, end) if hashed else np.zeros(0, dtype=np.uint64))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from one prefix sum of a rolling polynomial."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers_of(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _powers_of(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def combined(hash: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive hashes, in order."""
    m = len(hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = (out ^ hash[k : k + m]) * _MIX1
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the n-word shingles; a shorter text is one shingle."""
    count = np.diff(w.first)
    whole = combined(w.hash, n)
    place = np.arange(len(whole))
    ok = np.ones(len(whole), dtype=bool) if n == 1 else w.doc[: len(whole)] == w.doc[n - 1 :]
    hash, doc, at = whole[ok], w.doc[: len(whole)][ok], place[ok]
    for i in np.flatnonzero((count > 0) & (count < n)):
        h = np.uint64(count[i])
        for x in w.hash[w.first[i] : w.first[i + 1]]:
            h = mix(np.array([(int(h) * 3 + int(x)) % 2**64], dtype=np.uint64))[0]
        hash, doc, at = np.append(hash, h), np.append(doc, i), np.append(at, w.first[i])
    return hash, doc, at


def code_points(data: np.ndarray) -> np.ndarray:
    """before[i]: the characters that begin in data[:i]."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
