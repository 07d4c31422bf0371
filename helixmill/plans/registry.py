"""The k-mer queries by name, each with its SQL twin where SQL can express it.

All run over the derived reads (sources.fixture); k is 15 and the trusted
cutoff 4 unless a query says otherwise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.operators import correct, coverage, error_model, kmers, model, regions, report, scan, trim, trusted
from helixmill.sources import fixture
from helixmill.sources.files import quality_offset
from helixmill.staging import checkpointed

K, CUTOFF, TRIM = 15, 4, 3
#: Parameters at which the models are compared; mean and variance are the peak of the reads' coverage.
FIXED = {"copies": 2.0, "p_error": 0.6, "shape": 2.0}
FIXED_Q = {"copies": 2.0, "p_error": 0.6, "shape": 1.0, "scale": 0.9}
GOAL = 200.0
BASES = "ACGT"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.reads(spark, sf_dir)


def _staged_reads(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The reads (or these columns of theirs) for queries that use them several times: derived once."""
    return checkpointed(_reads(spark, sf_dir).select(*columns or "*"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(_reads(spark, sf_dir), K)


def _packed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.packed_counts(_reads(spark, sf_dir), K)


def _packed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.packed_sums(_reads(spark, sf_dir), K, fixture.OFFSET)


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trusted.trusted_scalar(_counts(spark, sf_dir), CUTOFF)


def _trusted_of(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trusted k-mers, packed ones that are not) of the reads, counted once."""
    counts = checkpointed(kmers.packed_counts(reads, K))
    return trusted.trusted_scalar(counts, CUTOFF).select(dna.unpack("packed", K).alias("kmer"), "packed", "n"), counts.where(F.col("n") < CUTOFF)


def reads_scan(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", "contig_id", "truth", "seq", "qual")


def quality_offset_guess(spark, sf_dir):
    return quality_offset(_reads(spark, sf_dir), 1000, "read_id")


def scan_summary(spark, sf_dir):
    return kmers.scan_summary(_staged_reads(spark, sf_dir), K)


def kmer_count_int(spark, sf_dir):
    return _counts(spark, sf_dir)


def kmer_count_min(spark, sf_dir):
    return kmers.count_kmers(_reads(spark, sf_dir), K, min_count=2)


def kmer_count_one_strand(spark, sf_dir):
    return kmers.count_kmers(_reads(spark, sf_dir), K, both_strands=False)


def qmer_count_fixed(spark, sf_dir):
    return kmers.count_qmers_fixed(_reads(spark, sf_dir), K, fixture.OFFSET)


def qmer_count_saturated(spark, sf_dir):
    return kmers.count_qmers_fixed(_reads(spark, sf_dir), K, fixture.OFFSET, scale=500, floor=kmers.FIXED_WEIGHT_FLOOR, most=8191)


def qmer_count_double(spark, sf_dir):
    """Sums of doubles, compared in thousandths."""
    return kmers.count_qmers(_reads(spark, sf_dir), K, fixture.OFFSET, min_count=1.0).select("kmer", F.round(F.col("q") * 1000).cast("bigint").alias("q_milli"))


def _in_parts(spark, sf_dir, counter) -> DataFrame:
    """What four counters give, each for a quarter of the reads."""
    reads = _staged_reads(spark, sf_dir, "read_id", "seq", "qual")
    return reduce(DataFrame.unionAll, (counter(reads.where(f"read_id % 4 = {i}")) for i in range(4)))


def _spelt(rows: DataFrame, value: str) -> DataFrame:
    return kmers.spelt(rows, K, value)


def reduce_kmers(spark, sf_dir):
    """Partial counts, as of four counters, reduced."""
    return _spelt(kmers.reduce_counts(_in_parts(spark, sf_dir, lambda reads: kmers.packed_counts(reads, K)), "n", "packed"), "n")


def reduce_qmers_fixed(spark, sf_dir):
    return _spelt(kmers.reduce_counts(_in_parts(spark, sf_dir, lambda reads: kmers.packed_sums(reads, K, fixture.OFFSET)), "q", "packed"), "q")


def kmer_pack(spark, sf_dir):
    return _counts(spark, sf_dir).select("kmer", dna.pack("kmer").alias("packed"), dna.pack(dna.reverse_complement("kmer")).alias("packed_rc"), dna.unpack(dna.pack("kmer"), K).alias("unpacked"))


def at_count_bins(spark, sf_dir):
    return coverage.at_bins(_counts(spark, sf_dir))


def coverage_hist(spark, sf_dir):
    return coverage.histogram(_packed_counts(spark, sf_dir))


def hist_bin10(spark, sf_dir):
    """Tenths up to two and a half times the peak of the coverage."""
    values = checkpointed(_packed_sums(spark, sf_dir))
    peak = coverage.valley_and_peak(coverage.right_closed(values, "q", kmers.FIXED_SCALE)).head()["peak"]
    return coverage.fine_bins(values, "q", kmers.FIXED_SCALE, 25 * (peak or 1))


def first_valley_peak(spark, sf_dir):
    return coverage.valley_and_peak(coverage_hist(spark, sf_dir))


def count_sample(spark, sf_dir):
    return coverage.sample(_counts(spark, sf_dir), 3000)


def stratified_sample(spark, sf_dir):
    return coverage.stratified_sample(_packed_counts(spark, sf_dir), 200, k=K).select(F.col("at").cast("bigint").alias("at"), dna.unpack("packed", K).alias("kmer"), "n")


def trusted_scalar(spark, sf_dir):
    return _trusted(spark, sf_dir)


def trusted_at_cutoff(spark, sf_dir):
    cutoffs = spark.range(K + 1).selectExpr("CAST(id AS INT) AS at", "CAST(3 + id % 3 AS DOUBLE) AS cutoff")
    return trusted.trusted_by_at(_counts(spark, sf_dir), cutoffs).select("kmer", "n")


def trusted_both_strands(spark, sf_dir):
    return trusted.both_strands(_trusted(spark, sf_dir))


def at_gc_prior(spark, sf_dir):
    return trusted.base_totals(_trusted(spark, sf_dir))


def quick_trim(spark, sf_dir):
    return trim.quick_trim(_reads(spark, sf_dir), TRIM, fixture.OFFSET).select("read_id", F.col("trim_len").cast("bigint").alias("trim_len"))


def trim_clamped(spark, sf_dir):
    return trim.quick_trim(_reads(spark, sf_dir), 9, fixture.OFFSET, clamped=True).select("read_id", F.col("trim_len").cast("bigint").alias("trim_len"))


def trim_program(spark, sf_dir):
    return trim.trim_reads(_reads(spark, sf_dir), TRIM, fixture.OFFSET, keep_short=True).select("read_id", "seq", "qual", "status")


def _shared(reads: DataFrame) -> correct.SharedKmers:
    """The trusted k-mers as a file, which K allows for any number of them."""
    return correct.packed_trusted(_trusted_of(reads)[0], K)


def untrusted_positions(spark, sf_dir):
    reads = _staged_reads(spark, sf_dir, "read_id", "seq")
    return scan.untrusted_positions(reads, _shared(reads), K).select("read_id", F.col("pos").cast("bigint").alias("pos"))


def _components(spark, sf_dir, *keep: str):
    reads = _staged_reads(spark, sf_dir, "read_id", "seq", *keep)
    return regions.with_core(scan.components(reads, _shared(reads), K), K)


def _joined(name: str):
    return F.expr(f"array_join(transform({name}, x -> CAST(x AS STRING)), ',')")


def untrusted_components(spark, sf_dir):
    return _components(spark, sf_dir).select("read_id", F.col("component").cast("bigint").alias("component"), F.expr("CAST(starts[0] AS BIGINT)").alias("first"), F.expr("CAST(array_max(starts) AS BIGINT)").alias("last"), F.size("starts").cast("bigint").alias("num"))


def component_intersect(spark, sf_dir):
    return _components(spark, sf_dir).select("read_id", F.col("component").cast("bigint").alias("component"), _joined("intersect").alias("places"))


def component_union(spark, sf_dir):
    return _components(spark, sf_dir).select("read_id", F.col("component").cast("bigint").alias("component"), _joined("union_").alias("places"))


def _with_ends(spark, sf_dir):
    rows = _components(spark, sf_dir, "qual").withColumn("q", dna.checked_phreds("qual", fixture.OFFSET))
    return rows.withColumns({"trim_len": F.length("seq"), "probs": dna.probabilities("q")})


def error_region(spark, sf_dir):
    return regions.error_region(_with_ends(spark, sf_dir), K).select("read_id", F.col("component").cast("bigint").alias("component"), _joined("region").alias("places"))


def error_region_chop(spark, sf_dir):
    return regions.error_region_chop(_with_ends(spark, sf_dir), K).select("read_id", F.col("component").cast("bigint").alias("component"), _joined("chopped").alias("places"))


def _at_peak(hist: DataFrame) -> dict[str, float]:
    peak = coverage.valley_and_peak(hist).head()["peak"] or 1
    return {"mean": float(peak), "variance": float(peak)}


def int_cutoff_fixed_params(spark, sf_dir):
    """Coverages 1..40 at the reads' peak: whether the error ratio is under the goal."""
    fixed = model.IntModel(**FIXED, **_at_peak(coverage_hist(spark, sf_dir)))
    return spark.createDataFrame([(i + 1, bool(b), fixed.cutoff(GOAL)) for i, b in enumerate(fixed.ratios() < GOAL)], "cov long, below boolean, cutoff long")


def _planted(spark, sf_dir):
    """Planted substitutions as corrections: (read_id, q, actual, observed)."""
    rows = _reads(spark, sf_dir).where("error_at >= 0").withColumnRenamed("error_at", "p")
    return rows.selectExpr("read_id", "p", f"ascii(substring(qual, p + 1, 1)) - {fixture.OFFSET} AS q", "substring(truth, p + 1, 1) AS actual", "substring(seq, p + 1, 1) AS observed").where("actual != observed")


def int_likelihood_fixed_params(spark, sf_dir):
    """Minus the log-likelihood of the coverage histogram at its peak, without extreme coverages, rounded."""
    hist = checkpointed(coverage_hist(spark, sf_dir))
    at = _at_peak(hist)
    rows = hist.where(F.col("cov") < model.EXTREME * at["mean"]).toPandas()
    nll = model.int_likelihood(model.IntModel(**FIXED, **at), rows["cov"].to_numpy(float), rows["num"].to_numpy(float))
    return spark.createDataFrame([(round(nll),)], "nll long")


def q_likelihood_fixed_params(spark, sf_dir):
    """The same of weighted counts, in thousandths."""
    values = checkpointed(_packed_sums(spark, sf_dir))
    at = _at_peak(coverage.right_closed(values, "q", kmers.FIXED_SCALE))
    rows = values.groupBy(F.expr("greatest(q div 1000, 1)").alias("milli")).agg(F.count("*").alias("num")).where(F.col("milli") < model.EXTREME * 1000 * at["mean"]).toPandas()
    nll = model.q_likelihood(model.QModel(**FIXED_Q, **at), rows["milli"].to_numpy(float) / 1000, rows["num"].to_numpy(float))
    return spark.createDataFrame([(round(nll),)], "nll long")


def q_cutoff_fixed_params(spark, sf_dir):
    """Coverages in hundredths at the peak of the weighted counts: whether the error ratio is under the goal, and the cutoff."""
    fixed = model.QModel(**FIXED_Q, **_at_peak(coverage.right_closed(_packed_sums(spark, sf_dir), "q", kmers.FIXED_SCALE)))
    at = np.arange(1, 2501)
    return spark.createDataFrame([(int(i), bool(b), round(100 * fixed.cutoff(GOAL))) for i, b in zip(at, fixed.ratios(at / 100) < GOAL)], "centi long, below boolean, cutoff long")


def error_model_counts(spark, sf_dir):
    return error_model.substitution_counts(_planted(spark, sf_dir)).select(F.col("q").cast("bigint").alias("q"), "actual", "observed", "n")


def error_model_kernel(spark, sf_dir):
    # Spread the one quality of the planted errors over several.
    rows = _planted(spark, sf_dir).withColumn("q", F.expr("CAST(7 + read_id % 3 * 5 AS INT)"))
    return error_model.smoothed(error_model.substitution_counts(rows)).select(F.col("q").cast("bigint").alias("q"), "actual", "observed", "p")


def _headed(reads: DataFrame, column: str) -> DataFrame:
    return reads.select(F.expr("concat('r', read_id)").alias("header"), F.col(column).alias("seq"))


def _changes(spark, sf_dir):
    reads = _staged_reads(spark, sf_dir)
    return report.changes(_headed(reads, "seq"), _headed(reads, "truth"))


def substitution_matrix(spark, sf_dir):
    return report.substitution_matrix(_changes(spark, sf_dir))


def substitution_by_position(spark, sf_dir):
    return report.by_position(_changes(spark, sf_dir))


def _restored(reads: DataFrame) -> DataFrame:
    """As if every fourth read was lost and the others were restored, every seventh cut to 54 bases."""
    return reads.where("read_id % 4 != 3").selectExpr("concat('r', read_id) AS header", "IF(read_id % 7 = 0, substring(truth, 1, 54), truth) AS seq")


def correction_report(spark, sf_dir):
    reads = _staged_reads(spark, sf_dir)
    return report.correction_report(_headed(reads, "seq"), _restored(reads))


def trims_by_position(spark, sf_dir):
    reads = _staged_reads(spark, sf_dir)
    return report.trims_by_position(_headed(reads, "seq"), _restored(reads))


def pair_routing(spark, sf_dir):
    """Every read and, as of a second file, a mate of it that fares otherwise."""
    reads = _staged_reads(spark, sf_dir)
    first, second = (reads.select(F.col("read_id").alias("pair_id"), F.expr(ok).alias("ok")) for ok in ("read_id % 5 != 0 AND seq NOT LIKE '%N%'", "read_id % 3 != 0"))
    return report.paired(first, second).select("pair_id", "ok1", "ok2", "route")


def _as_found(spark, sf_dir):
    """Reads cut by quality, planted substitutions taken back: rows like those of a search."""
    rows = trim.quick_trim(_reads(spark, sf_dir), TRIM, fixture.OFFSET).withColumn("trim_len", F.expr("IF(read_id % 11 = 0, 20, trim_len)"))
    rows = rows.withColumn("cor", F.explode(F.array(F.expr("substring(IF(read_id % 97 = 0, seq, truth), 1, trim_len)"))))
    edits = F.expr("transform(filter(IF(cor = substring(seq, 1, length(cor)), CAST(array() AS ARRAY<INT>), sequence(1, length(cor))), i -> substring(cor, i, 1) != substring(seq, i, 1)), i -> struct(i - 1 AS place, substring(cor, i, 1) AS base))")
    return rows.withColumn("edits", F.explode(F.array(edits))).withColumn("header", F.expr("concat('r', read_id)"))


def run_stats(spark, sf_dir):
    return correct.run_stats(correct.annotated(_as_found(spark, sf_dir), fixture.OFFSET))


def output_rows(spark, sf_dir):
    rows = correct.annotated(_as_found(spark, sf_dir), fixture.OFFSET)
    return rows.select("read_id", "status", "out_header", "out_seq", "out_qual")


def correction_log(spark, sf_dir):
    rows = correct.correction_log(correct.annotated(_as_found(spark, sf_dir), fixture.OFFSET), fixture.OFFSET)
    return rows.select("read_id", F.col("q").cast("bigint").alias("q"), F.col("pos").cast("bigint").alias("pos"), "new_nt", "old_nt")


def _searchable(spark, sf_dir):
    reads = _staged_reads(spark, sf_dir, "read_id", "seq", "qual")
    good, bad = _trusted_of(reads)
    shared = correct.packed_trusted(good, K)
    rows = checkpointed(correct.suspects(reads, good, K, fixture.OFFSET, TRIM, bad, shared))
    return rows, shared, trusted.base_priors(good, K)


def learn_error_model(spark, sf_dir):
    rows, good, priors = _searchable(spark, sf_dir)
    return error_model.smoothed(correct.learn(rows, good, K, fixture.OFFSET, priors))


def correct_reads(spark, sf_dir):
    rows, good, priors = _searchable(spark, sf_dir)
    learnt = error_model.smoothed(correct.learn(rows, good, K, fixture.OFFSET, priors)).collect()
    found = correct.searched(rows, good, K, fixture.OFFSET, error_model.as_array(learnt), priors)
    return correct.annotated(found.withColumn("header", F.expr("concat('r', read_id)")), fixture.OFFSET).select("read_id", "status", "out_header", "out_seq", "out_qual")


def single_edits(spark, sf_dir):
    """What the search finds for reads with one component, by even error rates: one edit, of a doubtful or unknown base."""
    rows, good, priors = _searchable(spark, sf_dir)
    rows = rows.where("size(comps) = 1 AND NOT qual LIKE '%#%'")
    found = correct.searched(rows, good, K, fixture.OFFSET, error_model.uniform(), priors).where("solved AND size(edits) = 1")
    found = found.selectExpr("read_id", "seq", "qual", "get(edits, 0).place AS at", "get(edits, 0).base AS base").where("substring(seq, at + 1, 1) = 'N' OR substring(qual, at + 1, 1) = '('")
    return found.selectExpr("read_id", "CAST(at AS BIGINT) AS place", "base")


def _doubled_rows(spark, sf_dir, which: str):
    """(reads with a second planted error 20 or 30 bases from the first whose components are as asked for, shared k-mers, priors)."""
    reads = _staged_reads(spark, sf_dir, "read_id", "seq", "qual", "error_at")
    good = _trusted_of(reads.select("seq"))[0]
    shared = correct.packed_trusted(good, K)
    rows = reads.where("error_at >= 0 AND length(seq) = 60").withColumn("o", F.expr("CAST((error_at + IF(read_id % 2 = 0, 30, 20)) % 60 AS INT)"))
    rows = rows.selectExpr("read_id", "overlay(seq PLACING translate(substring(seq, o + 1, 1), 'ACGT', 'CGTA') FROM o + 1 FOR 1) AS seq", "overlay(qual PLACING '(' FROM o + 1 FOR 1) AS qual")
    rows = correct.suspects(rows, good, K, fixture.OFFSET, TRIM, shared=shared).where("comps IS NOT NULL")
    rows = rows.withColumns({"n_comps": F.expr("size(comps)"), "width": F.expr("array_max(comps[0].starts) - comps[0].starts[0]")})
    # The search of a read does not depend on others, so only those that are asked for are searched.
    return checkpointed(rows.where(which)), shared, trusted.base_priors(good, K)


def _doubled_errors(spark, sf_dir, which: str):
    """What the search finds for these reads, by a model that tells bases apart: two edits, of doubtful bases."""
    rows, shared, priors = _doubled_rows(spark, sf_dir, which)
    rates = error_model.uniform()
    rates[:] = [[(0.0, 0.5, 0.3, 0.2)[(o - a) % 4] for o in range(4)] for a in range(4)]
    found = correct.searched(rows, shared, K, fixture.OFFSET, rates, priors)
    found = found.where("solved AND size(edits) = 2 AND forall(edits, e -> substring(qual, e.place + 1, 1) = '(')")
    return found.select("read_id", F.explode("edits").alias("e")).selectExpr("read_id", "CAST(e.place AS BIGINT) AS place", "e.base AS base")


def component_edits(spark, sf_dir):
    """Two components of a read, each solved by one edit of a doubtful base."""
    return _doubled_errors(spark, sf_dir, "n_comps = 2")


def paired_edits(spark, sf_dir):
    """One component that takes two edits, of the two doubtful bases."""
    return _doubled_errors(spark, sf_dir, f"n_comps = 1 AND width > {K - 1}")


def fit_int(spark, sf_dir):
    hist = coverage_hist(spark, sf_dir).toPandas()
    found = model.fit_int(hist["cov"].to_numpy(), hist["num"].to_numpy())
    return spark.createDataFrame([(found.copies, found.p_error, found.shape, found.mean, found.variance, found.cutoff(GOAL))], "copies double, p_error double, shape double, mean double, variance double, cutoff long")


def fit_q(spark, sf_dir):
    values = qmer_count_fixed(spark, sf_dir)
    values = coverage.sample(values, 30_000).select((F.col("q") / kmers.FIXED_SCALE).alias("q")).toPandas()["q"]
    found = model.fit_q(np.round(values.to_numpy(), 3))
    return spark.createDataFrame([(found.copies, found.p_error, found.shape, found.scale, found.mean, found.variance, found.cutoff(GOAL))], "copies double, p_error double, shape double, scale double, mean double, variance double, cutoff double")


def fit_gc(spark, sf_dir):
    counts = qmer_count_fixed(spark, sf_dir).select(dna.pack("kmer").alias("packed"), F.round(F.col("q") / kmers.FIXED_SCALE, 1).alias("q"))
    return model.cutoffs_by_at(counts, K, GOAL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage histogram of canonical k-mers."""
    return coverage_hist(spark, sf_dir)


_PLANS = (
    reads_scan, quality_offset_guess, scan_summary, kmer_count_int, kmer_count_min, kmer_count_one_strand, qmer_count_fixed, qmer_count_saturated, qmer_count_double,
    reduce_kmers, reduce_qmers_fixed, kmer_pack, at_count_bins, coverage_hist, hist_bin10, first_valley_peak, count_sample, stratified_sample,
    trusted_scalar, trusted_at_cutoff, trusted_both_strands, at_gc_prior, quick_trim, trim_clamped, trim_program, untrusted_positions, untrusted_components,
    component_intersect, component_union, error_region, error_region_chop, int_cutoff_fixed_params, int_likelihood_fixed_params, q_likelihood_fixed_params, q_cutoff_fixed_params, error_model_counts, error_model_kernel,
    substitution_matrix, substitution_by_position, correction_report, trims_by_position, pair_routing, run_stats, output_rows, correction_log,
    single_edits, component_edits, paired_edits, correct_reads, learn_error_model, fit_int, fit_q, fit_gc,
)

QUERIES = {f.__name__: f for f in _PLANS}

from .oracle import ORACLE_SQL  # noqa: E402, F401
