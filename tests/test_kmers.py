from collections import Counter

import pytest

from helixmill.operators import coverage, kmers, trusted

READS = ["ACGTACGTTTGN", "TTTTTTT", "AC", None, "ACGNACGTAC", "acgtacgt", "GGGTTT"]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def expected(k, reads=READS):
    return Counter(min(w, rc(w)) for r in reads if r for w in (r[i : i + k] for i in range(len(r) - k + 1)) if set(w) <= set("ACGT"))


def frame(spark, reads=READS):
    return spark.createDataFrame([(i, r, "I" * len(r or "")) for i, r in enumerate(reads)], "read_id long, seq string, qual string")


@pytest.mark.parametrize("k", [3, 4, 6, 7])
def test_counts_match_brute_force(spark, k):
    got = {r.kmer: r.n for r in kmers.count_kmers(frame(spark), k).collect()}
    assert got == dict(expected(k))
    assert {r.kmer: r.n for r in kmers.count_kmers(frame(spark), k, min_count=1).collect()} == {x: n for x, n in expected(k).items() if n > 1}


def test_windows_of_short_and_exact_reads(spark):
    assert kmers.windows(frame(spark, ["AC", "ACG", "ACGT"]), 3, "read_id").count() == 3


def test_palindromes_count_once(spark):
    assert {r.kmer: r.n for r in kmers.count_kmers(frame(spark, ["ACGT"]), 4).collect()} == {"ACGT": 1}


def test_k_out_of_range(spark):
    for k in (2, 32):
        with pytest.raises(ValueError):
            kmers.count_kmers(frame(spark), k)


def test_empty_input(spark):
    empty = frame(spark).limit(0)
    assert kmers.count_kmers(empty, 5).count() == 0
    assert kmers.reduce_counts(kmers.count_kmers(empty, 5), "n").count() == 0
    row = kmers.scan_summary(empty, 5).head()
    assert tuple(row) == (0, 0, 0, 0)


def test_partitions_do_not_matter(spark):
    one = frame(spark).coalesce(1)
    assert set(kmers.count_kmers(one, 4).collect()) == set(kmers.count_kmers(one.repartition(7), 4).collect())


def test_filters_of_counts_are_strict_and_of_weights_inclusive(spark):
    reads = frame(spark, ["AAAA", "AAAA"])
    assert kmers.count_kmers(reads, 4, min_count=2).count() == 0
    q = kmers.count_qmers_fixed(reads, 4, 33).head().q
    assert q == 2 * int(0.9999**4 * 1_000_000)
    assert kmers.count_qmers(reads, 4, 33, min_count=2 * 0.9999**4 - 1e-9).count() == 1


def test_saturation(spark):
    assert kmers.count_qmers_fixed(frame(spark, ["AAAA"] * 9), 4, 33, scale=500, most=1000).head().q == 1000


def test_trusted_and_positions(spark):
    reads = frame(spark, ["ACGTTGCA", "ACGTTGCA", "ACGTTNCA", "GG"])
    counts = kmers.count_kmers(reads, 4)
    good = trusted.trusted_scalar(counts, 3)
    assert {r.kmer for r in good.collect()} == {k for k, n in expected(4, ["ACGTTGCA", "ACGTTGCA", "ACGTTNCA"]).items() if n >= 3}
    with pytest.raises(ValueError):
        trusted.trusted_scalar(counts, 0)
    bad = {(r.read_id, r.pos) for r in trusted.untrusted_positions(reads, good, 4).collect()}
    ok = {r.kmer for r in good.collect()}
    want = {(i, p) for i, s in enumerate(["ACGTTGCA", "ACGTTGCA", "ACGTTNCA"]) for p in range(5) if min(s[p : p + 4], rc(s[p : p + 4])) not in ok or "N" in s[p : p + 4]}
    assert bad == want
    assert {r.kmer for r in trusted.both_strands(good).collect()} == ok | {rc(x) for x in ok}


def test_valley_and_peak(spark):
    def found(values):
        hist = spark.createDataFrame(list(enumerate(values, 1)), "cov long, num long")
        return tuple(coverage.valley_and_peak(hist).head())

    assert found([9, 5, 2, 3, 8, 8, 1]) == (3, 5)
    assert found([1, 2, 7]) == (1, 3)
    assert found([9, 5, 2]) == (None, None)


def test_samples_repeat(spark):
    counts = kmers.count_kmers(frame(spark), 4)
    a = coverage.stratified_sample(counts, 2).collect()
    assert sorted(a) == sorted(coverage.stratified_sample(counts.repartition(5), 2).collect())
    assert max(Counter(r["at"] for r in a).values()) <= 2


def test_fit_gc_takes_the_whole_sample(spark, monkeypatch):
    from helixmill.operators import model
    from helixmill.plans import registry

    sizes, rounds = [], []
    counts = spark.createDataFrame([("A" * i + "C" * (15 - i), 28_000_000) for i in range(16)], "kmer string, q long")
    monkeypatch.setattr(registry, "qmer_count_fixed", lambda spark, sf_dir: counts)
    monkeypatch.setattr(model, "stratified_sample", lambda rows, n: sizes.append(n) or coverage.stratified_sample(rows, n))
    monkeypatch.setattr(model, "fit_q", lambda values, **how: rounds.append(how) or 1 / 0)
    # The fits run where the rows are; here one is enough.
    monkeypatch.setattr(type(counts.groupBy("kmer")), "applyInPandas", lambda self, f, schema: f(rows_of_one_count()))
    with pytest.raises(ZeroDivisionError):
        registry.fit_gc(spark, "")
    assert sizes == [15_000] and rounds == [{}]


def rows_of_one_count():
    import pandas as pd

    return pd.DataFrame({"at": [5, 5], "cov": [28.0, 29.0]})
