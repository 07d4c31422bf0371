"""All k-mers of a batch of reads at once, as numbers: two bits a base, A C G T as 0 to 3.

The order of the numbers is that of the strings.  Reads lie in one row of codes,
one behind the other; a window is valid if it lies in one read and has no
unknown base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNKNOWN = 4
_CODES = np.full(256, UNKNOWN, dtype=np.uint8)
_CODES[[ord(c) for c in "ACGT"]] = range(4)
_LETTERS = np.frombuffer(b"ACGT", dtype=np.uint8)


@dataclass
class Reads:
    """codes[offset[i]:offset[i + 1]] is read i."""

    codes: np.ndarray
    offset: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The number of the read that each code belongs to."""
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; characters beyond ASCII become one ? each."""
    column = column.cast(pa.large_string())
    data, offset = _buffers(column)
    if len(data) and data.max() >= 128:
        data, offset = _buffers(pa.array([s.encode("ascii", "replace").decode() for s in column.to_pylist()], pa.large_string()))
    return data, offset


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def parsed(column: pa.Array) -> Reads:
    """Null reads are empty."""
    data, offset = flat(pc.fill_null(column, ""))
    return Reads(_CODES[data], offset)


def _rolled(one: np.ndarray, k: int, join: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """From values of single places those of k places, by doubling: join(left, right, places left, places right)."""
    out, have, power, size = None, 0, one, 1
    while True:
        if k & size:
            n = len(one) - (have + size) + 1
            if n <= 0:
                return one[:0]
            out = power[: len(one) - size + 1] if out is None else join(out[:n], power[have : have + n], have, size)
            have += size
        if have == k:
            return out
        n = len(one) - 2 * size + 1
        if n <= 0:
            return one[:0]
        power, size = join(power[:n], power[size : size + n], size, size), 2 * size


def _ahead(codes: np.ndarray, k: int) -> np.ndarray:
    return _rolled((codes & 3).astype(_kind(k)), k, lambda a, b, _, n: (a << (2 * n)) | b)


def _back(codes: np.ndarray, k: int) -> np.ndarray:
    return _rolled((3 - (codes & 3)).astype(_kind(k)), k, lambda a, b, n, _: (b << (2 * n)) | a)


def _kind(k: int) -> type:
    """The smallest integers that hold k bases: half the bytes to move up to k = 15."""
    return np.int32 if k <= 15 else np.int64


def forward(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mer from each place on, as an int64; of no use where a base is unknown."""
    return _ahead(codes, k).astype(np.int64, copy=False)


def backward(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complement of the k-mer from each place on."""
    return _back(codes, k).astype(np.int64, copy=False)


def canonical(codes: np.ndarray, k: int, both_strands: bool = True) -> np.ndarray:
    found = np.minimum(_ahead(codes, k), _back(codes, k)) if both_strands else _ahead(codes, k)
    return found.astype(np.int64, copy=False)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def inside(reads: Reads, k: int) -> np.ndarray:
    """Whether the window from each place on lies in one read."""
    n = len(reads.codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    owner = reads.owner
    return owner[:n] == owner[k - 1 :]


def known(reads: Reads, k: int) -> np.ndarray:
    """Whether the window from each place on has known bases only; of no use where it leaves its read."""
    n = len(reads.codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    unknown = np.zeros(len(reads.codes) + 1, dtype=np.int64)
    np.cumsum(reads.codes == UNKNOWN, out=unknown[1:])
    return unknown[k:] == unknown[:n]


def products(p: np.ndarray, k: int) -> np.ndarray:
    """The product of each k consecutive numbers, base by base from the left, so that all engines round alike."""
    n = len(p) - k + 1
    if n <= 0:
        return p[:0]
    out = p[:n].copy()
    for j in range(1, k):
        out *= p[j : j + n]
    return out


def spelt(packed: np.ndarray, k: int) -> pa.Array:
    """The strings of packed k-mers."""
    letters = np.empty((len(packed), k), dtype=np.uint8)
    for i in range(k):
        letters[:, i] = _LETTERS[(packed >> (2 * (k - 1 - i))) & 3]
    ends = pa.py_buffer(np.arange(0, len(packed) * k + 1, k, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(packed), [None, ends, pa.py_buffer(letters)]).cast(pa.string())


def slices(reads: Reads, k: int, most: int) -> Iterator[tuple[int, Reads]]:
    """(first code, its reads) in pieces of at most `most` windows, so that a read of any length takes bounded memory.

    Pieces overlap by k - 1 codes: each window is in exactly one.
    """
    n = len(reads.codes)
    for at in range(0, max(n - k + 1, 0), most):
        to = min(at + most + k - 1, n)
        yield at, Reads(reads.codes[at:to], np.clip(reads.offset, at, to) - at)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then those of the next range."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others, as uint64."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))
