"""One-permutation MinHash fingerprints, in DataFrame expressions only.

Each word shingle is hashed once.  The top bits of the hash choose a bin, the
least hash of a bin represents it, and a bin that nothing fell into borrows from
another one found by its own pseudo-random probe sequence (optimal
densification).  Of each bin the low-order bits are kept, packed into 64-bit
words; two fingerprints compare by the share of equal bins, corrected for the
equality that so few bits have by chance.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

WORDS, BINS, BITS = 5, 256, 4
_BIN_SHIFT = 64 - 8
_EMPTY = (1 << _BIN_SHIFT) - 1
_PER_LONG = 64 // BITS
_UPPER_AND_SPACE = string.ascii_uppercase + "\t\n\x0b\x0c\r"
_LOWER_AND_SPACE = string.ascii_lowercase + " " * 5


def _probes() -> tuple[list[int], list[int]]:
    """For each bin the start and the odd stride of its walk through all bins."""
    state, starts, strides = 0x9E3779B97F4A7C15, [], []
    for _ in range(BINS):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        starts.append(state >> 56)
        strides.append((state >> 40 & 0xFF) | 1)
    return starts, strides


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > -(2**63) else "(-9223372036854775807L - 1L)" for v in values) + ")"


def packed_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: array<bigint> of BINS * BITS / 64 packed words.

    Words are runs of characters other than ASCII white space, A-Z in lower
    case; a shingle is WORDS of them, or the whole of a shorter text.  A text
    without words (null, empty, blank) has a null fingerprint.
    """
    t, w, h, s, o, d = (f"__{x}_{out}" for x in ("t", "w", "h", "s", "o", "d"))
    starts, strides = _probes()
    sentinels = _longs([(b << _BIN_SHIFT) | _EMPTY for b in range(-BINS // 2, BINS // 2)])
    windows = ", ".join(f"{w}[i + {k}]" for k in range(1, WORDS))
    walk = ", ".join(f"{o}[(__starts[i] + {k} * __strides[i]) & {BINS - 1}]" for k in range(1, BINS + 1))
    nibbles = " | ".join(f"shiftleft({d}[{_PER_LONG} * j + {k}] & {(1 << BITS) - 1}L, {BITS * k})" for k in range(_PER_LONG))
    steps = [
        (t, F.translate(F.col(text), _UPPER_AND_SPACE, _LOWER_AND_SPACE)),
        (w, F.expr(f"transform(filter(split({t}, ' '), x -> x != ''), x -> xxhash64(x))")),
        (h, F.expr(f"CASE WHEN size({w}) >= {WORDS} THEN transform(slice({w}, 1, size({w}) - {WORDS - 1}), (x, i) -> xxhash64(x, {windows})) WHEN size({w}) > 0 THEN array(xxhash64({w})) END")),
        (s, F.expr(f"sort_array(concat({h}, {sentinels}))")),
        (o, F.expr(f"transform(filter({s}, (x, i) -> i = 0 OR shiftright(x, {_BIN_SHIFT}) != shiftright(get({s}, i - 1), {_BIN_SHIFT})), x -> IF(x & {_EMPTY}L = {_EMPTY}L, NULL, x))")),
        (d, F.expr(f"transform({o}, (x, i) -> coalesce(x, {walk}))")),
        (out, F.expr(f"IF({h} IS NULL, NULL, transform(sequence(0, {BINS // _PER_LONG - 1}), j -> {nibbles}))")),
    ]
    df = df.withColumns({"__starts": F.expr(_ints(starts)), "__strides": F.expr(_ints(strides))})
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop(t, w, h, s, o, d, "__starts", "__strides")


def _ints(values: list[int]) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness (0 to 1) of two packed fingerprints.

    With BITS bits two unrelated bins agree by chance once in 2^BITS; the share
    of equal bins is corrected by that.  Two texts without words are alike (1),
    one with and one without are not (0).
    """
    ones = "1229782938247303441L"  # 0x1111111111111111: one bit for each four
    z = "(x ^ y)"
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & {ones})), 0, (n, v) -> n + v)"
    chance = 1 / (1 << BITS)
    return F.expr(f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1D WHEN {a} IS NULL OR {b} IS NULL THEN 0D ELSE greatest(0D, (1D - {differ} / {BINS}D - {chance}D) / {1 - chance}D) END")


def as_hex(packed: str) -> Column:
    """The packed words as lower-case hexadecimal; no words: the empty string."""
    return F.expr(f"coalesce(lower(array_join(transform({packed}, x -> lpad(hex(x), 16, '0')), '')), '')")


def with_ranges(df: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """(df with __k, the key or the least bigint for null, and __r, its range from 1; number of ranges).

    The ranges, n at most, are cut at quantiles of the key that are keys
    themselves (the only data on the driver), so a range begins with its cut
    (__cut).  A key is found by bisection.
    """
    k = F.coalesce(F.col(key), F.lit(-(2**63)).cast("bigint"))
    found = df.select(k.alias("k")).agg(F.min("k").alias("least"), F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("cuts")).head()
    cuts = sorted({found["least"], *((found["cuts"] or []) if n > 1 else [])} - {None})
    top = 1 << max(0, len(cuts).bit_length())
    halves = _ints([top >> i for i in range(top.bit_length())])
    df = df.withColumn("__k", k).withColumn("__cuts", F.expr(_longs(cuts) if cuts else "CAST(array() AS ARRAY<BIGINT>)"))
    df = df.withColumn("__r", F.expr(f"aggregate({halves}, 0, (p, s) -> IF(p + s <= {len(cuts)} AND get(__cuts, p + s - 1) <= __k, p + s, p))"))
    return df.withColumn("__cut", F.expr("get(__cuts, __r - 1)")).drop("__cuts"), len(cuts)


def with_next(df: DataFrame, key: str, ties: list[str], carry: list[str]) -> DataFrame:
    """df with next_<c> of the next row in ascending key order, cyclically.

    Rows go to ranges of the key, at most 8 a shuffle partition.  The first key
    of each range also goes to the range before, where it only serves as a
    successor.  Null keys come first; repeated keys are ordered by `ties`.
    df may not have columns r, guest, next_<c> or any that begin with __.
    """
    df, ranges = with_ranges(df, key, 8 * partitions(df.sparkSession))
    rows = df.withColumn("__to", F.expr(f"explode(IF(__cut = __k, array(struct(__r AS r, 0 AS guest), struct(IF(__r = 1, {ranges}, __r - 1) AS r, 1 AS guest)), array(struct(__r AS r, 0 AS guest))))"))
    rows = rows.select("*", "__to.r", "__to.guest").drop("__to", "__cut", "__r")
    order = ", ".join(["guest", "__k", *ties])
    leads = [f"lead(`{c}`) OVER (PARTITION BY r ORDER BY {order}) AS `next_{c}`" for c in carry]
    return rows.selectExpr("*", *leads).where("guest = 0").drop("r", "guest", "__k")


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `fingerprint` (hexadecimal) and `packed` (array<bigint>).

    Columns of these names are replaced, others pass through.  Rows are taken
    one by one: equal texts have equal fingerprints, a text without words (null,
    empty, blank) the empty one.
    """
    return packed_fingerprint(df, text, "packed").withColumn("fingerprint", as_hex("packed"))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Null texts count as empty.  Null ids come first in the order of ids; rows of
    one id follow each other by a hash of their texts.  Columns other than
    doc_id and text are not looked at; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = packed_fingerprint(docs, "text", "packed")
    both = with_next(own, "doc_id", ["xxhash64(text)", "text"], ["text", "packed"])
    both = both.withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, length(text) - half), substring(next_text, 1, half))"))
    both = both.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "packed", "next_packed", "edited")
    both = packed_fingerprint(both, "edited", "edited_packed")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex("packed").alias("fingerprint"), as_hex("edited_packed").alias("edited_fingerprint"),
        likeness("packed", "edited_packed").alias("near_edited"), likeness("packed", "next_packed").alias("near_next"),
    )
