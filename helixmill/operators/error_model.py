"""How often which base is read as which, by quality, smoothed over qualities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.dna import MAX_QUALITY, NUCLEOTIDES

SIGMA = 2.0
#: Kernel weights are integers, so that sums do not depend on their order.
KERNEL_SCALE = 10**9
#: Corrections that an error model is learnt from.
SAMPLES = 200_000


def kernel_weights() -> list[int]:
    """The weight of each distance between two qualities."""
    return [round(KERNEL_SCALE * math.exp(-(d**2) / (2 * SIGMA**2))) for d in range(MAX_QUALITY - 1)]


def substitution_counts(corrections: DataFrame, *by: str) -> DataFrame:
    """(*by, q, actual, observed, n) of corrections (q, actual, observed); unknown bases don't count."""
    return corrections.where(F.col("observed").isin(*NUCLEOTIDES)).groupBy(*by, "q", "actual", "observed").agg(F.count("*").alias("n"))


def smoothed(counts: DataFrame, *by: str) -> DataFrame:
    """(*by, q, actual, observed, p) for q from 1 on and all pairs of different bases.

    A Gaussian kernel pools the counts of all qualities.  An actual base
    without any sample has a third for each other base.
    """
    spark = counts.sparkSession
    weights = "array(" + ", ".join(f"{w}L" for w in kernel_weights()) + ")"
    grid = spark.range(1, MAX_QUALITY).select(F.col("id").cast("int").alias("q"))
    bases = F.array(*(F.lit(b) for b in NUCLEOTIDES))
    grid = grid.withColumn("actual", F.explode(bases)).withColumn("observed", F.explode(bases)).where("actual != observed")
    if by:
        grid = counts.select(*by).distinct().crossJoin(F.broadcast(grid))
    used = counts.where(f"q BETWEEN 1 AND {MAX_QUALITY - 1}").withColumnRenamed("q", "qr")
    rows = used.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(MAX_QUALITY - 1)))).withColumn("w", F.expr(f"n * {weights}[abs(qr - q)]"))
    part = rows.groupBy(*by, "q", "actual", "observed").agg(F.sum("w").alias("part"))
    whole = rows.groupBy(*by, "q", "actual").agg(F.sum("w").alias("whole"))
    out = grid.join(part, [*by, "q", "actual", "observed"], "left").join(whole, [*by, "q", "actual"], "left")
    return out.select(*by, "q", "actual", "observed", F.expr("CASE WHEN coalesce(whole, 0) = 0 THEN 1D / 3D ELSE coalesce(part, 0) / CAST(whole AS DOUBLE) END").alias("p"))


def uniform() -> np.ndarray:
    """[quality, actual, observed]: a third for each other base."""
    return np.broadcast_to(np.where(np.eye(4) == 1, 0.0, 1 / 3), (MAX_QUALITY, 4, 4)).copy()


def as_array(rows: list) -> np.ndarray:
    """The model of collected (q, actual, observed, p) rows, 59 x 12 at most."""
    out = uniform()
    for r in rows:
        out[r["q"], NUCLEOTIDES.index(r["actual"]), NUCLEOTIDES.index(r["observed"])] = r["p"]
    return out


def report(counts: list, probabilities: list) -> str:
    """The text report: for each quality the observed rates with counts, then the smoothed ones."""
    n = {(r["q"], r["actual"], r["observed"]): r["n"] for r in counts}
    p = {(r["q"], r["actual"], r["observed"]): r["p"] for r in probabilities}
    head = "\t" + "\t".join(NUCLEOTIDES)
    lines = []
    for q in range(1, MAX_QUALITY):
        lines += [f"Quality = {q}", head]
        for a in NUCLEOTIDES:
            total = sum(n.get((q, a, o), 0) for o in NUCLEOTIDES)
            lines.append(a + "".join("\t-" if a == o else f"\t{n.get((q, a, o), 0) / total:g}({n.get((q, a, o), 0)})" if total else "\t0" for o in NUCLEOTIDES))
        lines.append(head)
        lines += [a + "".join("\t-" if a == o else f"\t{p.get((q, a, o), 1 / 3):g}" for o in NUCLEOTIDES) for a in NUCLEOTIDES]
        lines.append("")
    return "\n".join(lines) + "\n"
