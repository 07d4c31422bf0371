"""Coverage of k-mers: histograms, first valley and peak, AT bins, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.staging import checkpointed


def histogram(counts: DataFrame) -> DataFrame:
    """(cov, num): k-mers of each count, non-empty bins only."""
    return counts.groupBy(F.col("n").alias("cov")).agg(F.count("*").alias("num"))


def right_closed(counts: DataFrame, value: str, scale: int = 1) -> DataFrame:
    """(cov, num): values in (cov - 1, cov] in units of `scale`; zero falls in the first bin."""
    bin_ = F.greatest(F.expr(f"CAST(ceil({value} / CAST({scale} AS DOUBLE)) AS BIGINT)"), F.lit(1))
    return counts.groupBy(bin_.cast("bigint").alias("cov")).agg(F.count("*").alias("num"))


def at_bins(counts: DataFrame) -> DataFrame:
    """(at, num): k-mers of each AT count."""
    return counts.groupBy(dna.at_count("kmer").cast("bigint").alias("at")).agg(F.count("*").alias("num"))


def valley_and_peak(hist: DataFrame) -> DataFrame:
    """(valley, peak) of a histogram: the last bin of the first strict descent from
    bin 1 on, and the first bin with the most k-mers behind it.  Both null if the
    descent never ends.

    Bins without a row are empty.  They are never written out: where one follows
    another, or a bin that is not, the descent has ended, so a gap counts by its
    ends, however long it is.  There are as many rows as different counts.
    """
    rows = hist.where("num > 0").withColumns({"__cov": F.lag("cov").over(Window.orderBy("cov")), "__num": F.lag("num").over(Window.orderBy("cov"))})
    # Bin 1 is never a rise; if it is empty, bin 2 is one.
    rise = F.expr("CASE WHEN __cov IS NULL THEN IF(cov > 1, 2, NULL) WHEN cov > __cov + 1 THEN __cov + 2 WHEN num >= __num THEN cov END")
    turn = rows.agg(F.min(rise).cast("bigint").alias("turn"))
    after = hist.where("num > 0").crossJoin(F.broadcast(turn)).where("cov >= turn")
    return after.agg(F.min("turn").alias("turn"), F.min_by("cov", F.struct(-F.col("num"), "cov")).alias("peak")).select((F.col("turn") - 1).alias("valley"), "peak")


def fine_bins(values: DataFrame, value: str, unit: int, most_bins: int) -> DataFrame:
    """(bin, num) for all bins 1..most_bins of a tenth each; `value` counts in units of 1/unit.

    Bins are closed on the right; zero falls in the first; what reaches the
    last bin's end is left out.
    """
    tenth = unit // 10
    used = values.where(F.col(value) < most_bins * tenth)
    bin_ = F.greatest(F.expr(f"({value} + {tenth - 1}) div {tenth}"), F.lit(1))
    found = used.groupBy(bin_.cast("bigint").alias("bin")).agg(F.count("*").alias("num"))
    spine = values.sparkSession.range(1, most_bins + 1).withColumnRenamed("id", "bin")
    return spine.join(found, "bin", "left").select("bin", F.coalesce("num", F.lit(0)).alias("num"))


_DRAWS = 1_000_003
#: Rows that pass the first cut of a sample, as a multiple of those wanted.
_ROOM = 2


def _draw(seed: int, packed=None):
    return F.pmod((dna.pack("kmer") if packed is None else packed) % _DRAWS * 7919 + seed * 104_729, F.lit(_DRAWS))


def _limit(n: int, total: int) -> int:
    """Draws below it are some _ROOM * n of `total`."""
    return min(_DRAWS, -(-_DRAWS * _ROOM * n // max(1, total)))


def sample(counts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows with the least pseudo-random keys; the same ones in every run.

    Counting the rows gives a bound on the keys that about twice as many pass
    as are wanted, so that the last task sees no more, whatever the table's
    size.  Should fewer than n pass, the bound grows until enough do.
    """
    rows = checkpointed(counts.withColumn("__draw", _draw(seed)))
    limit = _limit(n, rows.count())
    while limit < _DRAWS and rows.where(F.col("__draw") < limit).count() < n:
        limit = min(_DRAWS, 2 * limit)
    return rows.where(F.col("__draw") < limit).orderBy("__draw", "kmer").limit(n).drop("__draw")


def stratified_sample(counts: DataFrame, n: int, seed: int = 0, k: int | None = None) -> DataFrame:
    """(at, kmer, ...) up to n rows of each AT count, those with the least keys; bounds as for sample(), one for each AT count.

    Counts of packed k-mers, which are smaller, take k or have a column `at`; their order is the same.
    """
    packed = "packed" in counts.columns
    if packed:
        rows = checkpointed(counts if "at" in counts.columns else counts.withColumn("at", dna.packed_at_count("packed", k))).withColumn("__draw", _draw(seed, F.col("packed")))
    else:
        rows = checkpointed(counts.withColumn("at", dna.at_count("kmer")).withColumn("__draw", _draw(seed)))
    totals = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.count("*").alias("n")).collect()}  # k + 1 at most
    limits = {at: _limit(n, total) for at, total in totals.items()}

    def passing() -> DataFrame:
        table = F.create_map(*(F.lit(v) for pair in limits.items() for v in pair)) if limits else F.lit(None)
        return rows.where(F.col("__draw") < table[F.col("at")]) if limits else rows

    while True:
        found = {r["at"]: r["n"] for r in passing().groupBy("at").agg(F.count("*").alias("n")).collect()}
        short = [at for at, total in totals.items() if found.get(at, 0) < min(n, total) and limits[at] < _DRAWS]
        if not short:
            break
        limits |= {at: min(_DRAWS, 2 * limits[at]) for at in short}
    by = Window.partitionBy("at").orderBy("__draw", "packed" if packed else "kmer")
    return passing().withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= n).drop("__rank", "__draw")
