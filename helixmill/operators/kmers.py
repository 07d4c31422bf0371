"""k-mers of reads: windows, integer and quality-weighted counts, reduction.

Counts go by minimizers (superkmers): each task sums what it has seen before the
one shuffle, so there is no separate flush, sort and reduce.  Windows as rows are
for what needs their reads and places.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions import dna

from . import superkmers
from . import windows as windows_

#: Window weights at or below these don't count, for exact and for fixed-point sums.
WEIGHT_FLOOR, FIXED_WEIGHT_FLOOR = 0.0001, 0.005
FIXED_SCALE = 1_000_000


def check_k(k: int) -> int:
    if not 3 <= k <= 31:
        raise ValueError("k must be from 3 to 31")
    return k


def windows(reads: DataFrame, k: int, *keep: str, strands: int = 1) -> DataFrame:
    """(*keep, pos, kmer) of each window without an unknown base; pos from 0.

    With two strands the k-mer is the lesser of the window and its reverse
    complement, both cut from the read's strands as they are.  A null read or
    one shorter than k has none.
    """
    check_k(k)
    rows = reads.where(F.length("seq") >= k).select(*keep, "seq", dna.is_known("seq").alias("__known"), *([dna.reverse_complement("seq").alias("__rc")] if strands == 2 else []))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("seq") - k)))
    own = F.expr(f"substring(seq, pos + 1, {k})")
    kmer = F.least(own, F.expr(f"substring(__rc, length(seq) - pos - {k - 1}, {k})")) if strands == 2 else own
    # A read that is known as a whole needs no look at its windows.
    return rows.select(*keep, "pos", kmer.alias("kmer"), "__known").where(F.col("__known") | dna.is_known("kmer")).drop("__known")


def canonical_kmers(reads: DataFrame, k: int, *keep: str, both_strands: bool = True) -> DataFrame:
    return windows(reads, k, *keep, strands=2 if both_strands else 1)


def count_kmers(reads: DataFrame, k: int, min_count: int = 0, both_strands: bool = True) -> DataFrame:
    """(kmer, n): occurrences of each k-mer, of which only n > min_count."""
    counts = superkmers.counts(reads, check_k(k), both_strands)
    return counts.where(F.col("n") > min_count) if min_count else counts


def packed_counts(reads: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """(packed, n): the same with k-mers as dna.pack() makes them, for what does not need their letters."""
    return superkmers.counts(reads, check_k(k), both_strands, spell=False)


def weighted_kmers(reads: DataFrame, k: int, offset: int, *keep: str) -> DataFrame:
    """(*keep, pos, kmer, weight): canonical k-mers with the product of their bases' probabilities."""
    rows = reads.where(F.length("seq") >= k).withColumn("__p", dna.checked_phreds("qual", offset)).withColumn("__p", dna.probabilities("__p"))
    # Base by base from the left, so that every engine rounds alike.
    weight = F.expr(" * ".join(f"__p[pos + {j}]" for j in range(k)))
    return windows(rows, k, *keep, "__p", strands=2).select(*keep, "pos", "kmer", weight.alias("weight"))


def count_qmers(reads: DataFrame, k: int, offset: int, min_count: float = 0.0, floor: float = WEIGHT_FLOOR) -> DataFrame:
    """(kmer, q): summed weights, of which only q >= min_count.

    The sum of doubles depends on their order in the last bits; use
    count_qmers_fixed where runs must agree exactly.
    """
    counts = superkmers.sums(reads, check_k(k), offset, floor)
    return counts.where(F.col("q") >= min_count) if min_count else counts


def count_qmers_fixed(reads: DataFrame, k: int, offset: int, scale: int = FIXED_SCALE, floor: float = WEIGHT_FLOOR, most: int = 2**62) -> DataFrame:
    """(kmer, q): sums of floor(scale * weight) as bigint, saturating at `most`."""
    return superkmers.fixed_sums(reads, check_k(k), offset, scale, floor).withColumn("q", F.least("q", F.lit(most)).cast("bigint"))


def packed_sums(reads: DataFrame, k: int, offset: int, scale: int = FIXED_SCALE, floor: float = WEIGHT_FLOOR) -> DataFrame:
    """(packed, q): the same with packed k-mers."""
    return superkmers.fixed_sums(reads, check_k(k), offset, scale, floor, spell=False)


def spelt(rows: DataFrame, k: int, value: str) -> DataFrame:
    """(kmer, value) of packed k-mers."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([windows_.spelt(batch.column(0).to_numpy(zero_copy_only=False), k), batch.column(1)], names=["kmer", value])

    return rows.select("packed", value).mapInArrow(run, f"kmer string, {value} {rows.schema[value].dataType.simpleString()}")


def reduce_counts(partial: DataFrame, value: str, key: str = "kmer") -> DataFrame:
    """Sum partial count tables by k-mer; the input need not be sorted, empty stays empty."""
    return partial.groupBy(key).agg(F.sum(value).alias(value))


def scan_summary(reads: DataFrame, k: int) -> DataFrame:
    """One row: reads, bases, unknown bases, distinct canonical k-mers."""
    unknown: Column = F.length(F.translate("seq", "ACGT", ""))
    a = reads.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n_bases"), F.coalesce(F.sum(unknown), F.lit(0)).alias("n_unknown"))
    return a.crossJoin(packed_counts(reads, k).agg(F.count("*").alias("n_kmers")))
