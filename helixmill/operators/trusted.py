"""The trusted k-mers: by one cutoff or one for each AT count; membership; base priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.staging import checkpointed

from . import bitfilter, windows
from .kmers import check_k, packed_counts

#: Windows that a task looks at at a time.
_WINDOWS = 1_000_000


def trusted_scalar(counts: DataFrame, cutoff: float, value: str = "n") -> DataFrame:
    """Rows with a count of cutoff or more.  A cutoff of 0 or less trusts everything: an error."""
    if not cutoff > 0:
        raise ValueError("the cutoff must be above 0")
    return counts.where(F.col(value) >= cutoff)


def trusted_by_at(counts: DataFrame, cutoffs: DataFrame, value: str = "n") -> DataFrame:
    """Rows that reach the cutoff of their AT count; cutoffs is (at, cutoff), k + 1 rows.

    With at most 32 rows the cutoffs are broadcast.
    """
    return counts.withColumn("at", dna.at_count("kmer")).join(F.broadcast(cutoffs.limit(32)), "at").where(F.col(value) >= F.col("cutoff")).drop("cutoff")


def both_strands(trusted: DataFrame) -> DataFrame:
    """Distinct k-mers together with their reverse complements."""
    return trusted.select("kmer").union(trusted.select(dna.reverse_complement("kmer").alias("kmer"))).distinct()


def base_totals(trusted: DataFrame, k: int | None = None) -> DataFrame:
    """(at, gc): bases of the trusted k-mers, one strand each; with k of packed ones."""
    if k:
        at, gc = F.sum(dna.packed_at_count("packed", k)), F.sum(F.lit(k) - dna.packed_at_count("packed", k))
        return trusted.agg(F.coalesce(at, F.lit(0)).cast("bigint").alias("at"), F.coalesce(gc, F.lit(0)).cast("bigint").alias("gc"))
    at = dna.at_count("kmer")
    return trusted.agg(F.coalesce(F.sum(at), F.lit(0)).cast("bigint").alias("at"), F.coalesce(F.sum(F.length("kmer") - at), F.lit(0)).cast("bigint").alias("gc"))


def base_priors(trusted: DataFrame, k: int | None = None) -> list[float]:
    """P(A), P(C), P(G), P(T); without k-mers a quarter each."""
    at, gc = base_totals(trusted, k).head()
    a = at / (at + gc) / 2 if at + gc else 0.25
    return [a, 0.5 - a, 0.5 - a, a]


def untrusted_positions(reads: DataFrame, trusted: DataFrame, k: int, untrusted: DataFrame | None = None) -> DataFrame:
    """(read_id, pos) of each window that is not a trusted canonical k-mer.

    Windows with an unknown base are untrusted.  `trusted` holds canonical
    k-mers.  The question is turned round: of the different k-mers of the
    reads, few windows have one that is not trusted.  A bit filter of those
    rules out nearly all windows where they are, and only the rest is joined,
    whatever the size of the trusted set.  Who has counted these reads' k-mers
    before may give all that are not trusted as `untrusted` (packed); else they
    are counted here.  `trusted` may have its k-mers packed, too.
    """
    if untrusted is None:
        good = trusted.select(F.col("packed") if "packed" in trusted.columns else dna.pack("kmer").alias("packed"))
        untrusted = checkpointed(packed_counts(reads, check_k(k)).join(good, "packed", "left_anti"))
    bad = untrusted.select("packed")
    sent = reads.sparkSession.sparkContext.broadcast(bitfilter.built(bad, "packed"))
    id_type = reads.schema["read_id"].dataType.simpleString()

    def doubtful(batches):
        words = sent.value
        for batch in batches:
            own = windows.parsed(batch.column(1))
            owner = own.owner
            for at, part in windows.slices(own, k, _WINDOWS):
                kmer = windows.canonical(part.codes, k)
                known = windows.known(part, k)
                place = np.flatnonzero(windows.inside(part, k) & (~known | bitfilter.may_hold(words, kmer)))
                if len(place):
                    read = owner[at + place]
                    # Windows with an unknown base need no answer: negative numbers, which the join spreads.
                    key = np.where(known[place], kmer[place], -1 - (windows.mixed(at + place) >> np.uint64(1)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(read)), pa.array((at + place - own.offset[read]).astype(np.int32)), pa.array(key)], names=["read_id", "pos", "packed"])

    rows = reads.where(F.length("seq") >= k).select("read_id", "seq").mapInArrow(doubtful, f"read_id {id_type}, pos int, packed bigint")
    return rows.join(bad.withColumn("bad", F.lit(True)), "packed", "left").where("packed < 0 OR bad").select("read_id", "pos")
