"""Untrusted windows and components of reads, found in the tasks that have the reads.

Every task looks into the shared file of trusted k-mers, so nothing is joined and
no window becomes a row that is not asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from helixmill.functions import dna

from . import trim, windows
from .windows import ranges

#: Windows that a task looks at at a time.
_WINDOWS = 1_000_000


def _places(seq: pa.Array, length: np.ndarray | None, known, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(read, place in it) of each untrusted window, in order; with `length` only of those within it."""
    own = windows.parsed(seq)
    owner, reads, places = own.owner, [], []
    for at, part in windows.slices(own, k, _WINDOWS):
        kmer, ok = windows.canonical(part.codes, k), windows.known(part, k)
        place = at + np.flatnonzero(windows.inside(part, k) & ~known.holds(kmer, ok))
        reads.append(owner[place])
        places.append(place - own.offset[owner[place]])
    read, place = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (reads, places))
    if length is not None:
        kept = place + k <= length[read]
        read, place = read[kept], place[kept]
    return read, place


def _begins(read: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Where a component begins: another read, or a window behind the end of the last one."""
    new = np.ones(len(read), dtype=bool)
    new[1:] = (read[1:] != read[:-1]) | (place[1:] > place[:-1] + (k - 1))
    return np.flatnonzero(new)


def _numbered(read: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal numbers."""
    at = np.arange(len(read))
    new = np.ones(len(read), dtype=bool)
    new[1:] = read[1:] != read[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(read) else at


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values.astype(np.int32)))


def untrusted_positions(reads: DataFrame, shared, k: int) -> DataFrame:
    """(read_id, pos) as trusted.untrusted_positions() has them."""
    id_type = reads.schema["read_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.opened(k)
        for batch in batches:
            read, place = _places(batch.column(1), None, known, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(read)), pa.array(place.astype(np.int32))], names=["read_id", "pos"])

    return reads.select("read_id", "seq").mapInArrow(run, f"read_id {id_type}, pos int")


def components(reads: DataFrame, shared, k: int) -> DataFrame:
    """reads (read_id, seq, ...) with component and starts, a row a component, as regions.components() has them."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema), "component int, starts array<int>"])
    at = reads.columns.index("seq")

    def run(batches):
        known = shared.opened(k)
        for batch in batches:
            read, place = _places(batch.column(at), None, known, k)
            first = _begins(read, place, k)
            rows = batch.take(pa.array(read[first]))
            columns = [*rows.columns, pa.array(_numbered(read[first]).astype(np.int32)), _lists(np.append(first, len(read))[1:], place)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "component", "starts"])

    return reads.mapInArrow(run, schema)


def _pieces(*pieces: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values): for each row the ranges (start, length, step) one behind the other."""
    n = len(pieces[0][0])
    start, length = (np.stack([np.maximum(p[i], 0) if i else p[i] for p in pieces], axis=1).ravel() for i in (0, 1))
    step = np.tile([p[2] for p in pieces], n)
    values = np.repeat(start, length) + ranges(np.zeros(len(length), dtype=np.int64), length) * np.repeat(step, length)
    return np.cumsum(length.reshape(n, len(pieces)).sum(axis=1)), values


def _regions(first: np.ndarray, last: np.ndarray, upto: np.ndarray, probability, k: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """The chopped and the whole regions of components, as regions.error_region_chop() and error_region() have them.

    Windows of a component overlap, so their union is one range.  probability(place) is that of each component's read.
    """
    meets = last <= first + k - 1
    front, back = np.where(meets, last, first), np.where(meets, first + k - 1, last + k - 1)
    whole = _pieces((front, back - front + 1, 1), (front - 1, np.where(front <= k - 1, front, 0), -1), (back + 1, np.where(upto - k <= back, upto - 1 - back, 0), 1))
    cut = np.where(first > 0, np.maximum(front, first + k - 1), front)
    empty = cut > back
    p = probability(np.where(empty, 0, cut))
    before = probability(np.where(empty, 0, np.maximum(cut - 1, 0)))
    doubtful = (first > 0) & (cut > 0) & ((before < 0.99) | (before <= p))
    main = np.where(doubtful, cut - 1, cut)
    # The places before the core come one by one, from the core to the end.
    down, low = np.where(first == 0, cut, 0), cut - 1
    ends = last + k < upto
    to = np.where(ends, np.minimum(back, last), back)
    low_kept = np.where(ends, np.minimum(low, last), low)
    down = np.maximum(down - (low - low_kept), 0)
    up = np.where(ends, 0, upto - 1 - back)
    chopped = _pieces(*((a, np.where(empty, 0, np.maximum(n, 0)), step) for a, n, step in ((main, to - main + 1, 1), (low_kept, down, -1), (back + 1, up, 1))))
    return chopped, whole


_COMPS = "comps array<struct<component:int,starts:array<int>,chopped:array<int>,region:array<int>>>"


def suspects(reads: DataFrame, shared, k: int, offset: int, trim_threshold: int) -> DataFrame:
    """reads (read_id, seq, qual, ...) with trim_len and comps, as correct.suspects() has them."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema), "trim_len int", _COMPS])
    at = [reads.columns.index(c) for c in ("seq", "qual")]
    right = np.append(np.array(dna.quality_probabilities()), 0.0)

    def run(batches):
        known = shared.opened(k)
        for batch in batches:
            seq, qual = (batch.column(i) for i in at)
            size = trim.trim_lengths(pc.fill_null(qual, ""), trim_threshold, offset)
            short = pc.fill_null(pc.less(pc.utf8_length(seq), trim.LEAST_LENGTH), False).to_numpy(zero_copy_only=False)
            upto = np.where(short, 0, size)
            cut = pa.array(upto.astype(np.int32), mask=qual.is_null().to_numpy(zero_copy_only=False) & ~short)
            read, place = _places(seq, upto, known, k)
            first = _begins(read, place, k)
            ends = np.append(first, len(read))[1:]
            owner = read[first]
            marks, begin = windows.flat(pc.fill_null(qual, ""))
            phred = marks.astype(np.int64) - offset
            bad = (phred < 0) | (phred >= dna.MAX_QUALITY)
            if bad.any():
                own = np.repeat(np.arange(len(upto)), np.diff(begin))
                if len(wrong := np.flatnonzero(bad & np.isin(own, owner))):
                    raise ValueError(f"quality out of range: {chr(marks[wrong[0]])}")
            chopped, whole = _regions(place[first], place[ends - 1], upto[owner], lambda i: right[phred[begin[owner] + i]], k) if len(first) else ((first, first),) * 2
            rows = pa.StructArray.from_arrays([pa.array(_numbered(owner).astype(np.int32)), _lists(ends, place), _lists(*chopped), _lists(*whole)], names=["component", "starts", "chopped", "region"])
            sizes = np.bincount(owner, minlength=len(upto))
            comps = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), rows, mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, cut, comps], names=[*batch.schema.names, "trim_len", "comps"])

    return reads.mapInArrow(run, schema)
