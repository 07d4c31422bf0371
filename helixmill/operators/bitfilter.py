"""A bit filter of packed k-mers for Python tasks: most that are not in it are known without a join.

Bits are gathered into words by Spark; the filter has some 16 bits a key up to
MOST_BITS, so what is broadcast is bounded.  Beyond that more keys pass by
chance and a join decides more of them: the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import mixed

BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 16, 28
_SHIFT = 6


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return mixed(keys) >> np.uint64(64 - bits)


def built(keys: DataFrame, key: str) -> np.ndarray:
    """The words of a filter of the bigint column `key` (repeats do no harm): 2^bits bits, 32 MiB at most."""
    n = keys.count()
    bits = min(max(LEAST_BITS, (BITS_PER_KEY * n).bit_length()), MOST_BITS)

    def words(batches):
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            word, which = (at >> np.uint64(_SHIFT)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            word, which = word[order], which[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, dtype=np.int64)
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(which, first).view(np.int64))], names=["word", "bits"])

    out = np.zeros(2 ** (bits - _SHIFT), dtype=np.uint64)
    found = keys.select(F.col(key).cast("bigint")).mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; False is certain."""
    at = _places(keys, len(words).bit_length() - 1 + _SHIFT)
    return (words[at >> np.uint64(_SHIFT)] >> (at & np.uint64(63))) & np.uint64(1) == 1
