import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.operators import bitfilter, correct, coverage, error_model, kmers, model, superkmers, trusted, windows


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def code(kmer):
    return int(kmer.translate(str.maketrans("ACGT", "0123")), 4)


def reads_of(seed, n=120):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(400)) + "A" * 60 + "AC" * 40 + "ACG" * 30
    out = []
    for _ in range(n):
        at = rng.randrange(len(genome) - 20)
        s = genome[at : at + rng.randint(5, 90)]
        s = "".join(rng.choice("ACGTNa") if rng.random() < 0.01 else c for c in s)
        out.append(rc(s) if rng.random() < 0.5 and set(s) <= set("ACGT") else s)
    return [*out, *out[:30], "A" * 200, "T" * 77, "", None, "ACGTéACGTACGTACGTTTGACCATG", "N" * 40, genome * 3]


def brute(reads, k, both=True):
    words = (r[i : i + k] for r in reads if r for i in range(len(r) - k + 1))
    return Counter(min(w, rc(w)) if both else w for w in words if set(w) <= set("ACGT"))


def frame(spark, reads):
    return spark.createDataFrame([(i, r, None if r is None else "I" * len(r)) for i, r in enumerate(reads)], "read_id long, seq string, qual string").repartition(3)


@pytest.mark.parametrize("k,both", [(3, True), (11, True), (12, True), (15, True), (15, False), (21, True), (31, True), (31, False)])
def test_counts_by_minimizers(spark, monkeypatch, k, both):
    monkeypatch.setattr(superkmers, "WINDOWS", 700)  # several rounds a task, and reads cut in pieces
    reads = reads_of(k)
    got = [(r.kmer, r.n) for r in kmers.count_kmers(frame(spark, reads), k, both_strands=both).collect()]
    assert len(got) == len(dict(got)) and dict(got) == dict(brute(reads, k, both))
    packed = {r.packed: r.n for r in kmers.packed_counts(frame(spark, reads), k, both).collect()}
    assert packed == {code(x): n for x, n in brute(reads, k, both).items()}


@pytest.mark.parametrize("k", [5, 15, 31])
def test_weighted_sums_by_minimizers(spark, monkeypatch, k):
    monkeypatch.setattr(superkmers, "WINDOWS", 900)
    rng = random.Random(k)
    rows = [(i, s, None if s is None else "".join(chr(33 + rng.choice([0, 2, 7, 20, 40, 41])) for _ in s)) for i, s in enumerate(reads_of(k, 80))]
    rows.append((999, "ACGTACGTACGTACGTACGTACGTACGTACGTTT", None))
    right, floor, want = dna.quality_probabilities(), 0.0001, Counter()
    for _, s, q in rows:
        for i in range(len(s) - k + 1 if s and q else 0):
            w, weight = s[i : i + k], 1.0
            for c in q[i : i + k]:
                weight *= right[ord(c) - 33]
            if set(w) <= set("ACGT") and weight > floor:
                want[min(w, rc(w))] += int(weight * 1_000_000)
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string").repartition(4)
    got = {r.kmer: r.q for r in kmers.count_qmers_fixed(reads, k, 33).collect()}
    assert got == dict(want) and len(got) > 100
    assert {r.packed: r.q for r in kmers.packed_sums(reads, k, 33).collect()} == {code(x): n for x, n in want.items()}


def test_bad_qualities_are_errors(spark):
    for qual in ("I" * 19 + "~", "I" * 19):
        with pytest.raises(Exception, match="quality|qualities"):
            kmers.count_qmers_fixed(spark.createDataFrame([("ACGTA" * 4, qual)], "seq string, qual string"), 15, 33).collect()


def _sent(reads, k=15, buckets=64):
    own = windows.parsed(pa.array(reads))
    return superkmers.sent(own, windows.inside(own, k) & windows.known(own, k), None, k, buckets, True)


def test_what_is_sent_follows_different_windows_not_copies():
    rng = random.Random(2)
    read = "".join(rng.choice("ACGT") for _ in range(60))
    one, many = _sent([read]), _sent([read] * 5000)
    assert many.nbytes == one.nbytes
    runs = _sent(["A" * 5000, "AC" * 3000, "T" * 900])
    assert runs.nbytes < 400
    # Windows of many different reads take less than five bytes each, most of them zeros of the sums.
    reads = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(3000)]
    assert _sent(reads, buckets=8).nbytes < 5 * 3000 * 86


def test_windows_that_repeat_themselves_are_dealt_out():
    rng = random.Random(4)
    # A third of all windows has the minimizer A..A, with different bases round it.
    reads = ["".join(rng.choice("ACGT") for _ in range(3)) + "A" * 11 + "".join(rng.choice("ACGT") for _ in range(3)) for _ in range(4000)]
    sent = _sent(reads, buckets=32)
    sizes = sorted(len(x) for x in sent["lengths"].to_pylist())
    assert len(sizes) == 32 and sizes[-1] < 3 * sum(sizes) / 32


def test_bit_filter(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**40, 3000)
    words = bitfilter.built(spark.createDataFrame([(int(x),) for x in keys] * 2, "k long").repartition(5), "k")
    assert bitfilter.may_hold(words, keys).all()
    assert bitfilter.may_hold(words, rng.integers(2**41, 2**42, 100_000)).mean() < 0.1
    assert not bitfilter.may_hold(bitfilter.built(spark.createDataFrame([], "k long"), "k"), keys).any()


def test_untrusted_windows_of_any_read(spark, monkeypatch):
    monkeypatch.setattr(trusted, "_WINDOWS", 50)
    reads, k = reads_of(8), 15
    counts = brute(reads, k)
    good = spark.createDataFrame([(x,) for x, n in counts.items() if n >= 4], "kmer string")
    want = {(i, p) for i, s in enumerate(reads) if s for p in range(len(s) - k + 1) if not set(s[p : p + k]) <= set("ACGT") or counts[min(s[p : p + k], rc(s[p : p + k]))] < 4}
    for bits in (16, 28):  # a filter that is nearly full only gives the join more to do
        monkeypatch.setattr(bitfilter, "MOST_BITS", bits)
        got = [(r.read_id, r.pos) for r in trusted.untrusted_positions(frame(spark, reads), good, k).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    none = spark.createDataFrame([], "kmer string")
    assert trusted.untrusted_positions(frame(spark, ["ACGTACGTACGTACGTA"]), none, k).count() == 3
    assert trusted.untrusted_positions(frame(spark, reads).limit(0), good, k).count() == 0


def test_very_high_coverage(spark):
    rows = [(1, 900), (2, 40), (3, 5), (28, 30), (29, 31), (30, 31), (3_000_000_000, 1)]
    assert tuple(coverage.valley_and_peak(spark.createDataFrame(rows, "cov long, num long")).head()) == (4, 29)
    assert model.peak(*np.array(rows).T) == 29
    planted = model.IntModel(2.0, 0.5, 2.0, 30.0, 40.0)
    cov = np.arange(1, 200)
    num = np.round(1e6 * (planted.error(cov) + planted.genuine(cov)))
    found = model.fit_int(np.append(cov[num > 0], 3_000_000_000), np.append(num[num > 0], 1))
    assert abs(found.mean - 30) < 1


def test_valley_against_written_out_bins(spark):
    rng = random.Random(6)
    for _ in range(25):
        hist = {c: rng.randint(1, 4) for c in rng.sample(range(1, 14), rng.randint(1, 9))}
        full = [hist.get(c, 0) for c in range(1, max(hist) + 1)]
        turn = next((i for i in range(1, len(full)) if full[i] >= full[i - 1]), None)
        want = (None, None) if turn is None else (turn, max(range(turn, len(full)), key=lambda i: (full[i], -i)) + 1)
        assert tuple(coverage.valley_and_peak(spark.createDataFrame(list(hist.items()), "cov long, num long")).head()) == want
        if turn is None:
            with pytest.raises(ValueError):
                model.peak(*np.array(sorted(hist.items())).T)
        else:
            assert model.peak(*np.array(sorted(hist.items())).T) == want[1]


@pytest.mark.parametrize("room", [2, 0.01])
def test_samples_by_a_bound(spark, monkeypatch, room):
    monkeypatch.setattr(coverage, "_limit", lambda n, total, f=coverage._DRAWS: min(f, max(1, int(f * room * n / max(1, total)))))
    rows = [("".join(random.Random(i).choices("ACGT", k=9)), i) for i in range(3000)]
    counts = spark.createDataFrame(rows, "kmer string, n long").dropDuplicates(["kmer"])
    draw = {r.kmer: code(r.kmer) % 1_000_003 * 7919 % 1_000_003 for r in counts.collect()}
    want = sorted(draw, key=lambda x: (draw[x], x))
    assert {r.kmer for r in coverage.sample(counts, 50).collect()} == set(want[:50])
    assert coverage.sample(counts, 10_000).count() == len(want)
    found = coverage.stratified_sample(counts, 20).collect()
    for at in range(10):
        assert {r.kmer for r in found if r["at"] == at} == set([x for x in want if x.count("A") + x.count("T") == at][:20])


def test_first_rows_of_each_group(spark):
    rng = random.Random(3)
    rows = [(f"f{i % 3}", i // 2, i % 2, rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "file string, read_id long, place int, x double").repartition(7)
    for n in (0, 1, 700, 5000):
        got = correct.first_rows(df, n, (), "read_id", "place").collect()
        assert sorted(map(tuple, got), key=lambda r: (r[1], r[2])) == sorted(rows, key=lambda r: (r[1], r[2]))[:n]
    got = Counter(r.file for r in correct.first_rows(df, 700, ("file",), "read_id", "place").collect())
    assert got == {"f0": 700, "f1": 700, "f2": 700}


def test_learning_stops_with_the_same_samples(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    rows = []
    for i in range(600):
        at = rng.randint(0, 240)
        seq, qual = genome[at : at + 60], "I" * 60
        if i % 2 == 0:
            p = rng.randint(0, 59)
            seq, qual = seq[:p] + rng.choice([c for c in "ACGT" if c != seq[p]]) + seq[p + 1 :], qual[:p] + "(" + qual[p + 1 :]
        rows.append((i, seq, qual, f"f{i % 2 + i // 300}"))
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string, file string")
    good = trusted.trusted_scalar(kmers.count_kmers(reads, 15), 4)
    suspects = correct.suspects(reads, good, 15, 33).cache()
    shared, priors = correct.packed_trusted(good, 15), trusted.base_priors(good)
    assert isinstance(shared, correct.SharedKmers) and shared.n == good.count()
    found = correct.searched(suspects, shared, 15, 33, error_model.uniform(), priors, learning=True).where("solved AND length(cor) >= 30")
    whole = correct.corrections(found, 33, "file").where("observed != 'N'").orderBy("read_id", "place").collect()
    assert len(whole) > 150
    for n in (7, 40, 100_000):
        got = {(r.q, r.actual, r.observed): r.n for r in correct.learn(suspects, shared, 15, 33, priors, samples=n).collect()}
        assert got == Counter((r.q, r.actual, r.observed) for r in whole[:n])
    got = {(r.file, r.q, r.actual, r.observed): r.n for r in correct.learn(suspects, shared, 15, 33, priors, samples=9, by=("file",)).collect()}
    by_file = {}
    for r in whole:
        by_file.setdefault(r.file, []).append(r)
    assert got == Counter((f, r.q, r.actual, r.observed) for f, own in by_file.items() for r in own[:9])


def test_workers_map_one_file(spark):
    rows = [("".join(random.Random(i).choices("ACGT", k=15)),) for i in range(5000)]
    good = spark.createDataFrame(rows, "kmer string").dropDuplicates()
    shared = correct.packed_trusted(good, 15)
    want = np.sort(np.array([code(r.kmer) for r in good.collect()]))

    def seen(batches):
        import pandas as pd

        for _ in batches:
            own = shared.load()
            base = own
            while getattr(base, "base", None) is not None:
                base = base.base
            yield pd.DataFrame({"n": [len(own)], "total": [int(own.astype(object).sum())], "mapped": [type(base).__name__ == "mmap"]})

    got = spark.range(8).repartition(4).mapInPandas(seen, "n long, total decimal(38,0), mapped boolean").collect()
    assert {(r.n, int(r.total), r.mapped) for r in got} == {(len(want), int(want.astype(object).sum()), True)}
    assert correct.packed_trusted(good.limit(0), 15).load().tolist() == []
