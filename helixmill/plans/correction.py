"""From FASTQ files to corrected FASTQ files: count, fit, trust, learn, correct, route."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import correct, coverage, error_model, kmers, model, report, trim, trusted
from helixmill.shipping import ship
from helixmill.sources import files
from helixmill.staging import checkpointed

OFFSET_READS = 1000
LOW_COVERAGE = 1.0


@dataclass
class Run:
    """What a run found: the quality offset, the cutoff, the trusted k-mers, the output rows of all
    files, and for each file statistics, a log, and the counts and probabilities of its error model."""

    offset: int
    cutoff: float
    trusted: DataFrame
    rows: DataFrame
    stats: DataFrame
    log: DataFrame
    error_counts: DataFrame
    error_rates: DataFrame


def choose_cutoff(counts: DataFrame, goal: float = 200, value: str = "n", sample: int = 30_000) -> float:
    """The cutoff by the mixture model: of integer counts (n) or of weighted ones (q)."""
    if value == "n":
        hist = coverage.histogram(counts).toPandas()
        return model.fit_int(hist["cov"].to_numpy(), hist["num"].to_numpy()).cutoff(goal)
    values = coverage.sample(counts, sample).select("q").toPandas()["q"].to_numpy(float)
    return model.fit_q(np.round(values, 3)).cutoff(goal)


def correct_files(
    spark: SparkSession, paths: list[str], k: int, *, weighted: bool = True, cutoff: float | None = None, goal: float = 200, by_at: bool = False,
    offset: int | None = None, trim_threshold: int = 3, keep_headers: bool = False,
) -> Run:
    """Correct the reads of FASTQ files (plain or gzip) against their own k-mers.

    Counts cover all files; each file learns its own error model.  Without a
    cutoff the coverage model chooses one, or (by_at) one for each AT count.
    keep_headers leaves the headers of kept reads as they are.
    """
    ship(spark)
    reads = files.read_fastq(spark, *paths)
    offset = offset or files.quality_offset(reads, OFFSET_READS).head()[0]
    counts = kmers.count_qmers(reads, k, offset) if weighted else kmers.count_kmers(reads, k)
    value = "q" if weighted else "n"
    if by_at:
        cutoffs = model.cutoffs_by_at(counts, k, goal, value=value)
        good, cutoff = trusted.trusted_by_at(counts, cutoffs, value), float(cutoffs.agg(F.min("cutoff")).head()[0])
    else:
        cutoff = choose_cutoff(counts, goal, value) if cutoff is None else cutoff
        good = trusted.trusted_scalar(counts, cutoff, value)
    if cutoff < LOW_COVERAGE:
        print(f"cutoff {cutoff}: the coverage is low, some errors will look genuine")
    good = checkpointed(good.select("kmer"))
    known, priors = correct.packed_trusted(good, k), trusted.base_priors(good)
    suspect = checkpointed(correct.suspects(reads, good, k, offset, trim_threshold))
    learnt = checkpointed(correct.learn(suspect, known, k, offset, priors, by=("file",)))
    rates = error_model.smoothed(learnt, "file")
    models = {r["file"]: error_model.uniform() for r in suspect.select("file").distinct().collect()}
    by_file: dict[str, list] = {}
    for r in rates.collect():
        by_file.setdefault(r["file"], []).append(r)
    models |= {file: error_model.as_array(rows) for file, rows in by_file.items()}
    rows = checkpointed(correct.annotated(correct.searched(suspect, known, k, offset, models, priors), offset))
    if keep_headers:
        rows = rows.withColumn("out_header", F.when(F.col("status") == "removed", F.col("out_header")).otherwise(F.col("header")))
    return Run(offset, cutoff, good, rows, correct.run_stats(rows, "file"), correct.correction_log(rows, offset, "file"), learnt, rates)


def mates(run: Run, first: str, second: str) -> DataFrame:
    """The routes of two mate files' reads, side by side by their place in the files."""
    rows = run.rows.select("file", F.col("ordinal").alias("pair_id"), (F.col("status") != "removed").alias("ok"))
    rows = rows.join(F.broadcast(files.sides_of(rows, [(first, second)])), "file")
    return report.paired(*(rows.where(f"side = {i}").select("pair_id", "ok") for i in (0, 1)))


def _error_reports(run: Run, files_: DataFrame) -> DataFrame:
    """(file, at, value): the lines of each file's error-model report, made where its 1,416 rows are."""
    counts = run.error_counts.select("file", "q", "actual", "observed", "n", F.lit(None).cast("double").alias("p"))
    rates = run.error_rates.select("file", "q", "actual", "observed", F.lit(None).cast("bigint").alias("n"), "p")

    def report_of(names: pa.Table, rows: pa.Table) -> pa.Table:
        own = rows.to_pylist()
        lines = error_model.report([r for r in own if r["n"] is not None], [r for r in own if r["p"] is not None]).rstrip("\n").split("\n") if names.num_rows else []
        return pa.table({"file": pa.array([names["file"][0].as_py()] * len(lines) if lines else [], pa.string()), "at": pa.array(range(len(lines)), pa.int64()), "value": pa.array(lines, pa.string())})

    return files_.select("file").groupBy("file").cogroup(counts.unionByName(rates).groupBy("file")).applyInArrow(report_of, "file string, at long, value string")


def write_run(run: Run, manifest: list[tuple[str, ...]], folder: str | None = None, keep_errors: bool = False, gzip: bool = False, log: bool = False, one_line: bool = False) -> list[str]:
    """All output of a run: corrected reads in record order, statistics, error models and (log) logs.

    manifest: one path a single file, two for mates.  Output goes beside the
    reads, or into `folder`.  Returns the paths written.  One job writes all
    files of reads, another one all the others, however many there are.
    """
    to = [tuple(f"{folder}/{p.rpartition('/')[2]}" if folder else p for p in paths) for paths in manifest]
    lines, reads = files.routed(run.rows, manifest, to, keep_errors, gzip, one_line=one_line)
    files.write_many(lines, [p for own in reads for p in own], gzip)
    flat, sides = [t for targets in to for t in targets], files.sides_of(run.rows, manifest)
    starts = [sum(map(len, manifest[:e])) for e in range(len(manifest))]
    sides = F.broadcast(sides.select("file", F.expr(f"array({', '.join(map(str, starts))})[entry] + side").alias("place")))
    texts = [(files.stats_name, files.stats_lines(run.stats)), (files.error_model_name, _error_reports(run, sides)), *([(lambda p: f"{p}.log", files.log_lines(run.log))] if log else [])]
    names, all_lines = [], None
    for name, own in texts:
        then = F.col("then") if "then" in own.columns else F.lit(0).cast("bigint")
        own = own.join(sides, "file").select((F.col("place") + len(names)).cast("int").alias("out"), F.col("at").cast("bigint").alias("at"), then.alias("then"), "value")
        all_lines = own if all_lines is None else all_lines.union(own)
        names += [name(t) for t in flat]
    files.write_many(all_lines, names)
    out = []
    for e, own in enumerate(reads):
        out += own
        for place in range(starts[e], starts[e] + len(manifest[e])):
            out += names[place :: len(flat)]
    return out


def trim_files(spark: SparkSession, manifest: list[tuple[str, ...]], threshold: int = 3, offset: int | None = None, folder: str | None = None, gzip: bool = False) -> list[str]:
    """Trim reads by quality: single files to .trim, mates to .trim and .trim_single, in step; one job writes all.

    Reads that get too short are dropped; their mate, if it stays, is single.
    """
    ship(spark)
    reads = files.read_fastq(spark, *(p for paths in manifest for p in paths))
    offset = offset or files.quality_offset(reads, OFFSET_READS).head()[0]
    rows = trim.trim_reads(reads, threshold, offset, keep_short=True)
    rows = rows.withColumns({"out_header": F.col("header"), "out_seq": F.col("seq"), "out_qual": F.col("qual"), "status": F.when(F.col("status") == "error", "removed").otherwise(F.col("status"))})
    to = [tuple(f"{folder}/{p.rpartition('/')[2]}" if folder else p for p in paths) for paths in manifest]
    lines, names = files.routed(rows, manifest, to, gzip=gzip, kind="trim")
    return files.write_many(lines, [p for own in names for p in own], gzip)


def build_bitset(spark: SparkSession, counts_path: str, k: int, out: str, cutoff: float | None = None, cutoffs_path: str | None = None) -> int:
    """Trusted k-mers of a file of counts, by one cutoff or by a file of one for each AT count, as a bit array.

    Returns how many k-mers (one strand) are trusted.
    """
    if (cutoff is None) == (cutoffs_path is None):
        raise ValueError("either one cutoff or a file of cutoffs is needed")
    ship(spark)
    counts = files.read_counts(spark, counts_path, k, kind="double")
    good = trusted.trusted_scalar(counts, cutoff) if cutoffs_path is None else trusted.trusted_by_at(counts, files.read_at_cutoffs(spark, cutoffs_path, k))
    good = checkpointed(good.select("kmer"))
    files.write_bitset(good, k, out)
    return good.count()
