"""Scalar functions on sequences and qualities, as Column expressions.

Sequences are upper-case strings; everything but A, C, G and T counts as an
unknown base.  Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUCLEOTIDES = "ACGT"
#: Phred values from MAX_QUALITY on are refused.
MAX_QUALITY = 60


def quality_probabilities() -> list[float]:
    """P(base is right) for each phred value below MAX_QUALITY, .25 at least."""
    return [max(0.25, 1 - 10 ** (-q / 10)) for q in range(MAX_QUALITY)]


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column | str) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_known(kmer: Column | str) -> Column:
    """Whether there are only upper-case A, C, G and T; lower case is unknown."""
    return F.translate(kmer, "ACGT", "") == ""


def pack(kmer: Column | str) -> Column:
    """Two bits a base, the first base in the highest, up to 31 bases; any case."""
    return F.conv(F.translate(kmer, "ACGTacgt", "01230123"), 4, 10).cast("bigint")


def unpack(packed: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(F.col(packed) if isinstance(packed, str) else packed, 10, 4), k, "0"), "0123", "ACGT")


def at_count(kmer: Column | str) -> Column:
    """The number of upper-case A and T."""
    return F.length(kmer) - F.length(F.translate(kmer, "AT", ""))


def packed_at_count(packed: str, k: int) -> Column:
    """The number of A and T of a packed k-mer: both bits of theirs are alike."""
    return F.lit(k) - F.bit_count(F.expr(f"({packed} ^ shiftright({packed}, 1)) & {0x5555555555555555}"))


def phreds(qual: str, offset: int | str) -> Column:
    """array<int> of the phred values of a quality string; `offset` may be a column name."""
    return F.expr(f"transform(filter(split({qual}, ''), c -> c != ''), c -> ascii(c) - {offset})")


def checked_phreds(qual: str, offset: int | str) -> Column:
    """phreds(), but a value outside 0..MAX_QUALITY-1 is an error."""
    return F.expr(
        f"transform(filter(split({qual}, ''), c -> c != ''), c -> IF(ascii(c) - {offset} BETWEEN 0 AND {MAX_QUALITY - 1}, ascii(c) - {offset}, CAST(raise_error(concat('quality out of range: ', c)) AS INT)))"
    )


def probabilities(phred: str) -> Column:
    """array<double> for an array of phred values."""
    table = "array(" + ", ".join(f"{p!r}D" for p in quality_probabilities()) + ")"
    return F.expr(f"transform({phred}, q -> {table}[q])")


def clamped_phreds(phred: str) -> Column:
    """Phred values by way of the probability, whose floor of .25 makes 1 of 0 and 1."""
    return F.expr(f"transform({phred}, q -> greatest(q, 1))")
