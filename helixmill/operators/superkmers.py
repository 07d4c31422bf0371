"""Counting k-mers by minimizers.

Consecutive windows mostly have the same least m-mer in them, their minimizer.
A run of such windows, a super-k-mer, holds them all in a few more bases than
one.  A task cuts its reads into super-k-mers, sums up those that are alike,
and sends them, two bits a base, to the bucket of their minimizer; all windows
of a k-mer have the same one, so each bucket counts its k-mers by itself.

Equal super-k-mers are summed up before they are sent, so that copies of a read
or of a repeat cost no more than one.  Minimizers that repeat themselves, or nearly
(AAAAAAAAA, ACACACACA), which are the frequent ones besides, are chosen last,
and windows that have nothing better are dealt by the hash of their k-mer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import dna

from . import windows
from .windows import Reads

#: Windows that a task sums up at a time.
WINDOWS = 2_000_000
#: Buckets for each shuffle partition: a bucket is counted in memory, so it is a small part of a partition.
BUCKETS_A_PARTITION = 64
#: Bases of a bucket that are spelt out at a time.
PIECE = 1_000_000
#: Bits of a k-mer and of a sum that fit in one number.
_KMER_BITS, _SUM_BITS = 30, 33
_LONGEST_MINIMIZER, _LEAST_K = 11, 12
#: Minimizers up to this length have a table of their ranks (3 MB).
_RANKED = 9
#: A minimizer repeats itself if so many of its bases at most differ from the one so many places before.
_PERIODS = {1: 2, 2: 1, 3: 1}
_LOW_BITS = 0x5555555555555555
_SENT = "bucket int, lengths binary, sums binary, bases binary"


def minimizer_length(k: int) -> int:
    """0: too few k-mers to need any."""
    return min(_LONGEST_MINIMIZER, k - 6) if k >= _LEAST_K else 0


def _keys(mer: np.ndarray, m: int) -> np.ndarray:
    """The number of each m-mer, of which a window takes the least."""
    repeats = np.zeros(len(mer), dtype=bool)
    for p, most in _PERIODS.items():
        change = (mer ^ (mer >> (2 * p))) & (4 ** (m - p) - 1)
        repeats |= np.bitwise_count((change | (change >> 1)) & _LOW_BITS) <= most
    return (windows.mixed(mer) >> np.uint64(1)) | (repeats.astype(np.uint64) << np.uint64(63))


@lru_cache(maxsize=1)
def _ranked(m: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each m-mer by its number, these numbers in order)."""
    keys = _keys(np.arange(4**m), m)
    order = np.argsort(keys)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank, keys[order]


def minimizers(codes: np.ndarray, k: int, both_strands: bool) -> np.ndarray:
    """A number for the minimizer of each window; those from 2^63 on repeat themselves."""
    m = minimizer_length(k)
    mer = windows.canonical(codes, m, both_strands)
    if m > _RANKED:
        return windows.least(_keys(mer, m), k - m + 1)
    rank, keys = _ranked(m)
    return keys[windows.least(rank[mer], k - m + 1)]


def _runs(reads: Reads, valid: np.ndarray, k: int, buckets: int, both_strands: bool) -> tuple[np.ndarray, ...]:
    """(first window, windows, first and last k-mer, bucket) of each super-k-mer."""
    n = len(valid)
    at = np.arange(n)
    if minimizer_length(k):
        key = minimizers(reads.codes, k, both_strands)
        alone = key >= np.uint64(2**63)
    else:
        key, alone = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (key[1:] != key[:-1]) | alone[1:]
    # Up to k + 1 windows the first and the last k-mer tell all bases.
    begun = np.maximum.accumulate(np.where(begins, at, 0))
    begins |= valid & ((at - begun) % (k + 1) == 0)
    start = np.flatnonzero(begins)
    length = np.bincount(np.cumsum(begins)[valid] - 1, minlength=len(start)) if len(start) else np.zeros(0, dtype=np.int64)
    alone = alone[start]
    ahead = windows.forward(reads.codes, k)
    first, last = ahead[start], ahead[start + length - 1]
    single = np.flatnonzero(alone)
    if both_strands and len(single):
        pieces = reads.codes[windows.ranges(start[single], np.full(len(single), k))]
        first[single] = last[single] = windows.canonical(pieces, k)[::k]
    shared = key[start]
    shared[single] = windows.mixed(first[single])
    return start, length, first, last, (shared % np.uint64(buckets)).astype(np.int64)


def _packed(codes: np.ndarray) -> np.ndarray:
    """Four codes a byte."""
    four = np.zeros((-(-len(codes) // 4), 4), dtype=np.uint8)
    four.ravel()[: len(codes)] = codes
    return (four << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return ((np.frombuffer(data, dtype=np.uint8)[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3).ravel()[:n]


def sent(reads: Reads, valid: np.ndarray, weights: np.ndarray | None, k: int, buckets: int, both_strands: bool) -> pa.RecordBatch:
    """The super-k-mers of the valid windows: a row a bucket, with one sum each, or one for each window if these have weights."""
    start, length, first, last, bucket = _runs(reads, valid, k, buckets, both_strands)
    # Equal ones stand together by a hash; should another one stand between them, they are sent as two.
    mark = windows.mixed(windows.mixed(first) ^ (last.astype(np.uint64) << np.uint64(1)) ^ (length.astype(np.uint64) << np.uint64(57)))
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(40)) | (mark >> np.uint64(24)), kind=None if weights is None else "stable")
    start, length, first, last, bucket = (v[order] for v in (start, length, first, last, bucket))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (length[1:] != length[:-1])
    group, kept = np.cumsum(new) - 1, np.flatnonzero(new)
    if weights is None:
        sums, places = np.diff(np.append(kept, len(start))).astype(np.int64), np.arange(len(kept) + 1)
    else:
        places = np.append(0, np.cumsum(length[kept]))
        sums = np.zeros(places[-1], dtype=weights.dtype)
        np.add.at(sums, windows.ranges(places[:-1][group], length), weights[windows.ranges(start, length)])
    start, length, bucket = start[kept], length[kept], bucket[kept]
    ends = np.append(np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(bucket) else [], []).astype(np.int64)
    out: tuple[list, ...] = ([], [], [], [])
    codes, bases = reads.codes[windows.ranges(start, length + k - 1)], np.append(0, np.cumsum(length + k - 1))
    for a, b in zip(np.append(0, ends[:-1]), ends):
        for column, value in zip(out, (int(bucket[a]), length[a:b].astype(np.uint8).tobytes(), sums[places[a] : places[b]].tobytes(), _packed(codes[bases[a] : bases[b]]).tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "lengths", "sums", "bases"])


def _taken(lengths: list[np.ndarray], sums: list[np.ndarray], codes: list[np.ndarray], k: int, weighted: bool, both_strands: bool) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer, sum) of each window of super-k-mers, in their order."""
    length, total = np.concatenate(lengths), np.concatenate(sums)
    pieces = Reads(np.concatenate(codes), np.append(0, np.cumsum(length + k - 1)))
    kmer = windows.canonical(pieces.codes, k, both_strands)[windows.ranges(pieces.offset[:-1], length)]
    return kmer, total if weighted else np.repeat(total, length)


def _summed(kmer: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers in order, their sums)."""
    if total.dtype == np.int64 and len(kmer) and kmer.max() < 2**_KMER_BITS and 0 <= total.min() and total.max() < 2**_SUM_BITS:
        # Both in one number, which sorts several times as fast.
        both = np.sort((kmer << _SUM_BITS) | total)
        kmer, total = both >> _SUM_BITS, both & (2**_SUM_BITS - 1)
    else:
        order = np.argsort(kmer, kind="stable")
        kmer, total = kmer[order], total[order]
    first = np.flatnonzero(np.append(True, kmer[1:] != kmer[:-1]))
    return kmer[first], np.add.reduceat(total, first)


def received(table: pa.Table, k: int, weighted: bool, both_strands: bool, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers in order, their sums) of what was sent to one bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    lengths, own, codes, bases = [], [], [], 0
    for length, sums, packed in zip(*(table[c] for c in ("lengths", "sums", "bases"))):
        length = np.frombuffer(length.as_buffer(), dtype=np.uint8).astype(np.int64)
        lengths.append(length)
        own.append(np.frombuffer(sums.as_buffer(), dtype=kind))
        codes.append(_unpacked(packed.as_buffer(), int((length + k - 1).sum())))
        bases += len(codes[-1])
        if bases >= PIECE:
            held.append(_summed(*_taken(lengths, own, codes, k, weighted, both_strands)))
            lengths, own, codes, bases = [], [], [], 0
    if lengths:
        held.append(_taken(lengths, own, codes, k, weighted, both_strands))
    kmer, total = held[0] if len(held) == 1 else (np.concatenate([h[i] for h in held]) for i in (0, 1))
    held.clear()
    return _summed(kmer, total)


def _batched(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have `most` bytes or more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counted(reads: DataFrame, k: int, both_strands: bool, value: str, spell: bool, weights: Callable[[pa.RecordBatch, Reads], np.ndarray] | None, scale: int | None, floor: float) -> DataFrame:
    buckets = BUCKETS_A_PARTITION * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        for batch in _batched(batches, WINDOWS):
            whole = windows.parsed(batch.column(0))
            weight = weights(batch, whole) if weights else None
            for at, part in windows.slices(whole, k, WINDOWS):
                valid = windows.inside(part, k) & windows.known(part, k)
                own = None
                if weight is not None:
                    product = windows.products(weight[at : at + len(part.codes)], k)
                    valid &= product > floor
                    own = product if scale is None else np.floor(product * scale).astype(np.int64)
                if valid.any():
                    yield sent(part, valid, own, k, buckets, both_strands)

    def count(table):
        kmer, total = received(table, k, weights is not None, both_strands, np.int64 if scale else np.float64)
        return pa.table({"kmer": windows.spelt(kmer, k), value: total} if spell else {"packed": kmer, value: total})

    return reads.mapInArrow(cut, _SENT).groupBy("bucket").applyInArrow(count, f"{'kmer string' if spell else 'packed bigint'}, {value} {'bigint' if scale else 'double'}")


def counts(reads: DataFrame, k: int, both_strands: bool = True, spell: bool = True) -> DataFrame:
    """(kmer, n), or (packed, n) unless they are to be spelt: occurrences of each k-mer without an unknown base."""
    return _counted(reads.select("seq"), k, both_strands, "n", spell, None, 1, 0.0)


def sums(reads: DataFrame, k: int, offset: int, floor: float, spell: bool = True) -> DataFrame:
    """(kmer, q), or (packed, q): sums of the weights as doubles; else as fixed_sums()."""
    return fixed_sums(reads, k, offset, None, floor, spell)


def fixed_sums(reads: DataFrame, k: int, offset: int, scale: int | None, floor: float, spell: bool = True) -> DataFrame:
    """(kmer, q), or (packed, q): sums of floor(scale * weight) of the windows whose weight is above `floor`.

    A window's weight is the product of its bases' probabilities.  Qualities
    outside the range, or not one for each base, are errors; a null quality
    string counts nothing.
    """
    right = np.array(dna.quality_probabilities())

    def weights(batch: pa.RecordBatch, reads: Reads) -> np.ndarray:
        marks, ends = windows.flat(batch.column(1))
        if not np.array_equal(ends, reads.offset):
            raise ValueError("a read and its qualities differ in length")
        phred = marks.astype(np.int64) - offset
        if len(phred) and not (0 <= phred.min() and phred.max() < dna.MAX_QUALITY):
            raise ValueError(f"quality out of range: {chr(marks[(phred < 0) | (phred >= dna.MAX_QUALITY)][0])}")
        return right[phred]

    long = reads.where((F.length("seq") >= k) & F.col("qual").isNotNull()).select("seq", "qual")
    return _counted(long, k, True, "q", spell, weights, scale, floor)
