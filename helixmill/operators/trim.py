"""Trimming of low-quality 3' ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions import dna

from . import windows

#: Reads shorter than this after trimming are given up.
LEAST_LENGTH = 30


def trim_length(phred: str, threshold: int) -> Column:
    """Where to cut: the place with the largest positive sum of (threshold - phred) from there on.

    Of equal sums the rightmost place wins; without a positive one nothing is
    cut; an empty read has 0.
    """
    step = f"named_struct('sum', s.sum + {threshold} - {phred}[i], 'best', greatest(s.best, s.sum + {threshold} - {phred}[i]), 'cut', IF(s.sum + {threshold} - {phred}[i] > s.best, i, s.cut))"
    places = f"IF(size({phred}) > 0, sequence(size({phred}) - 1, 0), CAST(array() AS ARRAY<INT>))"
    return F.expr(f"aggregate({places}, named_struct('sum', 0, 'best', 0, 'cut', size({phred})), (s, i) -> {step}, s -> s.cut)")


def trim_lengths(qual: pa.Array, threshold: int, offset: int) -> np.ndarray:
    """trim_length() of each quality string of an array without nulls, by raw phred values."""
    marks, begin = windows.flat(qual)
    if not pc.all(pc.string_is_ascii(qual)).as_py():
        marks = np.frombuffer("".join(qual.to_pylist()).encode("utf-32-le"), dtype="<u4")
    step = threshold + offset - marks.astype(np.int64)
    size = np.diff(begin)
    # Without a value below the threshold nothing is cut.
    rows = np.flatnonzero(np.diff(np.append(0, np.cumsum(step > 0))[begin]))
    if len(rows):
        at = windows.ranges(begin[rows], size[rows])
        own, first = step[at], np.cumsum(size[rows]) - size[rows]
        ends = np.cumsum(own)
        rest = np.repeat(ends[first + size[rows] - 1], size[rows]) - ends + own
        best = np.maximum.reduceat(rest, first)
        cut = np.maximum.reduceat(np.where(rest == np.repeat(best, size[rows]), at, -1), first) - begin[rows]
        size[rows] = np.where(best > 0, cut, size[rows])
    return size


def quick_trim(reads: DataFrame, threshold: int, offset: int | str, clamped: bool = False) -> DataFrame:
    """reads with trim_len, by raw phred values or (clamped) by those of the probabilities."""
    rows = reads.withColumn("__q", dna.phreds("qual", offset))
    if clamped:
        rows = rows.withColumn("__q", dna.clamped_phreds("__q"))
    cut = trim_length("__q", threshold)
    if not isinstance(offset, str) and 0 < offset + threshold <= 128:
        # Without a value below the threshold nothing is cut.
        cut = F.when(F.expr(rf"qual RLIKE r'[\x00-\x{offset + threshold - 1:02x}]'"), cut).otherwise(F.length("qual"))
    # The one-element explode keeps the optimizer from repeating the scan inside later expressions.
    return rows.withColumn("trim_len", F.explode(F.array(cut))).drop("__q")


def trim_reads(reads: DataFrame, threshold: int, offset: int | str, keep_short: bool = False, least: int = LEAST_LENGTH) -> DataFrame:
    """The trimmed reads with status `trimmed`, `kept` or (keep_short) `error`.

    Reads below `least` are dropped, or kept as `error` where mates must stay in
    step.  Quality strings are cut like the sequences.
    """
    rows = quick_trim(reads, threshold, offset, clamped=True)
    status = F.when(F.col("trim_len") < least, "error").when(F.col("trim_len") < F.length("seq"), "trimmed").otherwise("kept")
    rows = rows.withColumn("status", status).withColumns({c: F.expr(f"substring({c}, 1, trim_len)") for c in ("seq", "qual")})
    return rows if keep_short else rows.where("status != 'error'")
