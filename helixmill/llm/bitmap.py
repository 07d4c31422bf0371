"""A bitmap of keys that spares most rows a shuffle.

Rows whose bit is not set are certainly not among the keys; only the others
need a join to tell.  The bitmap is a small table of words, broadcast and
looked up in the JVM.  It has some 16 bits a key up to MOST_BITS, so its size is
bounded; beyond that more bits are set by chance, the join decides more rows
and the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, staged

BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 20, 26


@dataclass
class Bitmap:
    """The staged words (number, word) that are not 0, at most 2^bits / 64 of them."""

    words: DataFrame
    bits: int

    def marked(self, rows: DataFrame, key: str, flag: str = "maybe") -> DataFrame:
        """rows with the column `flag`: false where the bit of the key (bigint) is not set."""
        word, bits = fresh(rows, "__word", "__bits")
        at = _place(key, self.bits)
        words = self.words.toDF(word, bits)
        found = rows.withColumn(word, F.expr(f"shiftright({at}, 6)")).join(F.broadcast(words), word, "left")
        return found.withColumn(flag, F.coalesce(F.expr(f"shiftrightunsigned(`{bits}`, CAST({at} & 63 AS INT)) & 1L") == 1, F.lit(False))).drop(word, bits)

    def release(self) -> None:
        release(self.words)


def _place(key: str, bits: int) -> str:
    return f"pmod(xxhash64(`{key}`), shiftleft(1L, {bits}))"


def bitmap(keys: DataFrame, key: str) -> Bitmap:
    """The bitmap of a column of bigints; repeated keys do no harm, null ones are left out."""
    keys = keys.where(F.col(key).isNotNull())
    n = keys.count()
    bits = min(max(LEAST_BITS, (BITS_PER_KEY * n).bit_length()), MOST_BITS)
    at = _place(key, bits)
    words = keys.groupBy(F.expr(f"shiftright({at}, 6)").alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({at} & 63 AS INT)))").alias("__bits"))
    return Bitmap(staged(words, "bitmap"), bits)
