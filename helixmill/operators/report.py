"""Accuracy reports, pairing and routing of corrected reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(original: DataFrame, corrected: DataFrame, key: str, order: str | None) -> DataFrame:
    """(key, old, new).  Of repeated keys the least sequence counts; with `order`, a column of both, the
    first corrected one does, and every original one is compared with it."""
    if order:
        old = original.select(key, F.col("seq").alias("old"))
        return old.join(corrected.groupBy(key).agg(F.min_by("seq", order).alias("new")), key)
    old = original.groupBy(key).agg(F.min("seq").alias("old"))
    return old.join(corrected.groupBy(key).agg(F.min("seq").alias("new")), key)


def changes(original: DataFrame, corrected: DataFrame, key: str = "header", order: str | None = None) -> DataFrame:
    """(key, pos, new_nt, old_nt): places, from 1, where corrected differs from original.

    Both have (key, seq); for repeated keys see _sides(); a shortened read is
    compared as far as it goes.
    """
    both = _sides(original, corrected, key, order).where(F.expr("substring(old, 1, length(new)) != new"))
    rows = both.withColumn("pos", F.explode(F.expr("sequence(1, length(new))")))
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), F.expr("substring(new, pos, 1)").alias("new_nt"), F.expr("substring(old, pos, 1)").alias("old_nt")).where("new_nt != old_nt")


def substitution_matrix(changed: DataFrame) -> DataFrame:
    """(new_nt, old_nt, num) without changes of unknown bases."""
    return changed.where("old_nt != 'N'").groupBy("new_nt", "old_nt").agg(F.count("*").alias("num"))


def by_position(changed: DataFrame) -> DataFrame:
    """(pos, num): changes at each place."""
    return changed.groupBy("pos").agg(F.count("*").alias("num"))


def trims_by_position(original: DataFrame, corrected: DataFrame, key: str = "header", order: str | None = None) -> DataFrame:
    """(pos, num): places, from 1, behind the end of how many of the reads that were changed."""
    cut = _sides(original, corrected, key, order).where(F.expr("length(new) < length(old) AND substring(old, 1, length(new)) != new"))
    rows = cut.select(F.explode(F.expr("sequence(CAST(length(new) + 1 AS BIGINT), CAST(length(old) AS BIGINT))")).alias("pos"))
    return rows.groupBy("pos").agg(F.count("*").alias("num"))


def correction_report(original: DataFrame, corrected: DataFrame, key: str = "header") -> DataFrame:
    """One row: total, tossed, corrected reads, corrected and trimmed bases of corrected reads."""
    changed = changes(original, corrected, key)
    reads = changed.select(key).distinct()
    lengths = original.groupBy(key).agg(F.min(F.length("seq")).alias("a")).join(corrected.groupBy(key).agg(F.min(F.length("seq")).alias("b")), key).join(reads, key)
    totals = original.agg(F.count("*").alias("total")).crossJoin(corrected.agg(F.count("*").alias("kept")))
    bases = changed.agg(F.count("*").alias("corrected_bp"))
    trims = lengths.agg(F.count("*").alias("corrected"), F.coalesce(F.sum(F.col("a") - F.col("b")), F.lit(0)).cast("bigint").alias("trimmed_bp"))
    return totals.crossJoin(bases).crossJoin(trims).select("total", (F.col("total") - F.col("kept")).alias("tossed"), "corrected", "corrected_bp", "trimmed_bp")


def paired(first: DataFrame, second: DataFrame, key: str = "pair_id") -> DataFrame:
    """Mates side by side: ok1, ok2 and route.  A mate without its partner is an error.

    Both have (key, ok); route is pair, single1_err2, err1_single2 or err.
    """
    both = first.select(key, F.col("ok").alias("ok1")).join(second.select(key, F.col("ok").alias("ok2")), key, "full_outer")
    both = both.withColumn("ok1", F.when(F.col("ok1").isNull() | F.col("ok2").isNull(), F.expr("CAST(raise_error('a read has no mate') AS BOOLEAN)")).otherwise(F.col("ok1")))
    route = F.when(F.col("ok1") & F.col("ok2"), "pair").when(F.col("ok1"), "single1_err2").when(F.col("ok2"), "err1_single2").otherwise("err")
    return both.withColumn("route", route)
