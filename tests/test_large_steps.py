"""Steps that have to keep up with large inputs: the same results by less work."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helixmill.functions import dna
from helixmill.operators import correct, coverage, error_model, kmers, prefilter, search, superkmers, trim, trusted, windows
from helixmill.plans import registry
from helixmill.sources import fixture

SF = "/root/testdata/sf0.001"
PRIORS = [0.3, 0.2, 0.2, 0.3]


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def genome_reads(k, seed, errors):
    """(reads, their qualities, trusted set) of a random genome with `errors` doubtful and one unmarked wrong base a read."""
    rng = np.random.default_rng(seed)
    genome, up = rng.integers(0, 4, 400), 4 ** np.arange(k)[::-1]
    w = np.lib.stride_tricks.sliding_window_view(genome, k)
    known = np.unique(np.minimum(w @ up, (3 - w) @ up[::-1]))
    reads = []
    for i in range(60):
        at = int(rng.integers(0, 340))
        codes, quality = genome[at : at + 60].copy(), np.full(60, 40)
        for p in rng.choice(60, errors + i % 2, replace=False):
            codes[p] = (codes[p] + 1 + rng.integers(0, 3)) % 4
            quality[p] = 7
        if i % 5 == 0:
            codes[rng.integers(0, 60)] = 4
        if i % 7 == 0:
            codes[:] = rng.integers(0, 4, 60)
        reads.append((codes, quality))
    return reads, search.TrustedSet(known, k)


def suspect_batch(spark, reads, known, k):
    rows = [(i, "".join("ACGTN"[c] for c in codes), "".join(chr(33 + q) for q in quality)) for i, (codes, quality) in enumerate(reads)]
    good = spark.createDataFrame([(int(p),) for p in known.packed], "packed long").select(dna.unpack("packed", k).alias("kmer"), "packed")
    frame = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    return correct.suspects(frame, good, k, 33).where("comps IS NOT NULL").toArrow().combine_chunks().to_batches()[0], frame, good


def test_reads_that_cannot_be_solved_are_not_searched(spark, monkeypatch):
    """a whole batch is ruled out at once, with the results of a search of each read."""
    k = 9
    reads, known = genome_reads(k, 1, 1)
    batch, _, _ = suspect_batch(spark, reads, known, k)
    right, solve, calls = np.array(dna.quality_probabilities()), search.solve, []
    monkeypatch.setattr(search, "solve", lambda *a: calls.append(1) or solve(*a))
    for learning in (True, False):
        want = []
        for r in batch.to_pandas().itertuples(index=False):
            read, comps = correct._parsed(r, 33, right)
            want.append(correct._outcome(r, *search.correct(read, comps, known, error_model.uniform(), PRIORS, learning)[:3]))
        before = len(calls)
        calls.clear()
        out = correct._searched(batch, known, 33, error_model.uniform(), PRIORS, learning)
        assert list(zip(*(out.column(c).to_pylist() for c in ("cor", "solved", "edits")))) == want
        assert any(w[1] for w in want) and len(calls) < before
        calls.clear()


@pytest.mark.parametrize("k, errors", [(5, 2), (7, 2), (9, 2), (9, 3)])
def test_two_edits_are_never_ruled_out_wrongly(spark, k, errors):
    """two doubtful bases of a component, in sparse and in dense trusted sets."""
    reads, known = genome_reads(k, k + errors, errors)
    batch, _, _ = suspect_batch(spark, reads, known, k)
    right, ruled = np.array(dna.quality_probabilities()), 0
    for r in batch.to_pandas().itertuples(index=False):
        read, comps = correct._parsed(r, 33, right)
        one = prefilter.Batch(read.codes.astype(np.uint8), read.quality, read.right, np.array([0, len(read.codes)]), np.array([len(read.codes)]), np.array([0])).prepared(k)
        for starts, chopped, _ in comps:
            for learning in (True, False):
                no = prefilter.hopeless(one, known, error_model.uniform()[None], PRIORS, learning, np.array([0]), np.array(starts), np.array([0, len(starts)]), np.array(chopped, dtype=np.int64), np.array([0, len(chopped)]))
                code = search.solve(read, chopped, starts, known, error_model.uniform(), PRIORS, learning, 1.0)[0]
                assert not (no[0] and code in (search.SOLVED, search.AMBIGUOUS))
                ruled += bool(no[0])
    assert ruled


@pytest.mark.parametrize("k", [7, 9, 11])
def test_single_edits_are_found_without_a_search(spark, monkeypatch, k):
    """those of a whole batch at once, also where one of several components, or two edits for one, leave it ambiguous."""
    reads, known = genome_reads(k, k, 1)
    batch, _, _ = suspect_batch(spark, reads, known, k)
    right, solve, calls = np.array(dna.quality_probabilities()), search.solve, []
    rates = error_model.uniform()
    rates[:] = [[(0.0, 0.5, 0.3, 0.2)[(o - a) % 4] for o in range(4)] for a in range(4)]
    for learning in (True, False):
        for model in (error_model.uniform(), rates):
            want = []
            for r in batch.to_pandas().itertuples(index=False):
                read, comps = correct._parsed(r, 33, right)
                want.append(correct._outcome(r, *search.correct(read, comps, known, model, PRIORS, learning)[:3]))
            out = correct._searched(batch, known, 33, model, PRIORS, learning)
            assert list(zip(*(out.column(c).to_pylist() for c in ("cor", "solved", "edits")))) == want
            easy = [len(comps) == 1 and w[1] and len(w[2]) == 1 for comps, w in zip(batch.column("comps").to_pylist(), want)]
            with monkeypatch.context() as patch:
                patch.setattr(search, "solve", lambda *a: calls.append(1) or solve(*a))
                correct._searched(batch.filter(pa.array(easy)), known, 33, model, PRIORS, learning)
            assert sum(easy) and (k < 11 or len(calls) < sum(easy) / 2)
            calls.clear()


def test_later_components_go_on_from_the_first(spark):
    """reads with several components keep the edits of those that are solved."""
    k = 9
    reads, known = genome_reads(k, 5, 2)
    batch, _, _ = suspect_batch(spark, reads, known, k)
    batch = batch.filter(pa.array([len(c) > 1 for c in batch.column("comps").to_pylist()]))
    out = correct._searched(batch, known, 33, error_model.uniform(), PRIORS, False)
    right = np.array(dna.quality_probabilities())
    want = []
    for r in batch.to_pandas().itertuples(index=False):
        read, comps = correct._parsed(r, 33, right)
        want.append(correct._outcome(r, *search.correct(read, comps, known, error_model.uniform(), PRIORS)[:3]))
    assert batch.num_rows and any(w[2] for w in want)
    assert list(zip(*(out.column(c).to_pylist() for c in ("cor", "solved", "edits")))) == want


def test_many_trusted_kmers_go_out_as_bits(spark):
    """their file has a fixed size, and the same answers."""
    k = 13
    kmers_ = np.unique(np.random.default_rng(2).integers(0, 4**k, 200_000))
    good = spark.range(0).select(F.col("id").alias("packed")).unionAll(spark.createDataFrame(pa.table({"packed": kmers_})))
    shared = correct.packed_trusted(good, k)
    assert shared.bits and len(shared.load()) == 4**k // 8
    asked = np.arange(0, 4**k, 7)
    known = asked % 5 > 0
    assert np.array_equal(shared.opened(k).holds(asked, known), search.TrustedSet(kmers_, k).holds(asked, known))
    few = correct.packed_trusted(good.limit(5), k)
    assert not few.bits and len(few.load()) == 5


def test_the_bits_are_made_once(spark):
    """sorting their pieces does not make them again."""
    good = spark.createDataFrame(pa.table({"packed": np.arange(0, 4**13, 400)}))
    made = correct._bits_of(good)
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.collect()
    assert [r["at"] for r in rows] == sorted(r["at"] for r in rows)
    assert sum(int(np.unpackbits(np.frombuffer(r.piece, dtype=np.uint8)).sum()) for r in rows) == good.count()


def test_error_region_chop_joins_and_numbers_no_windows(spark):
    """windows are looked up where the reads are."""
    assert not any(step in plan(spark, "error_region_chop") for step in ("Join", "Window", "Exchange"))


def test_error_region_joins_and_numbers_no_windows(spark):
    """windows are looked up where the reads are."""
    assert not any(step in plan(spark, "error_region") for step in ("Join", "Window", "Exchange"))


def test_suspects_of_a_file_are_those_of_joins(spark):
    """what the model is learnt from, with and without joins."""
    reads = fixture.reads(spark, SF).select("read_id", "seq", "qual").localCheckpoint()
    good = trusted.trusted_scalar(kmers.count_kmers(reads, 15), 4).cache()
    for frame in (reads, reads.selectExpr("read_id", "substring(seq, 1 + CAST(read_id % 9 AS INT), 45) AS seq", "translate(substring(qual, 1 + CAST(read_id % 9 AS INT), 45), 'I', 'F') AS qual")):
        joined = correct.suspects(frame, good, 15, 33)
        found = correct.suspects(frame, good, 15, 33, shared=correct.packed_trusted(good, 15))
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.where("comps IS NOT NULL").count() > 0
        assert found.exceptAll(joined).count() == 0 and joined.exceptAll(found).count() == 0
    high = frame.withColumn("qual", F.regexp_replace("qual", "F", "~"))
    with pytest.raises(Exception, match="quality out of range"):
        correct.suspects(high, good, 15, 33, shared=correct.packed_trusted(good, 15)).collect()


def test_suspects_trim_whole_batches(spark):
    """the tasks that look for untrusted windows trim, by the same rule, also odd quality strings."""
    marks = ["", "I" * 40, "#" * 10, "I" * 20 + "#" * 6, "#" * 3 + "I" * 9, "$" * 7, "!I!I!", "IéI", "##é##", "é猫###", "I\"\"\"", "\x1fI\x1f", "II$##$", "#I#I#", "I" * 60 + "##", "#" + "I" * 59, "I" * 35 + "#$#I$#"]
    frame = spark.createDataFrame([(i, "A" * len(m), m) for i, m in enumerate(marks)] + [(97, "AC", None), (98, "A" * 40, None), (99, None, "I#"), (100, None, None)], "read_id long, seq string, qual string")
    for threshold in (1, 3, 9):
        want = trim.quick_trim(frame, threshold, 33)
        rows = want.select("qual").where("qual IS NOT NULL").toArrow()["qual"].combine_chunks()
        assert trim.trim_lengths(rows, threshold, 33).tolist() == [r.trim_len for r in want.where("qual IS NOT NULL").collect()]
    good = spark.createDataFrame([(0,)], "packed long").select(dna.unpack("packed", 15).alias("kmer"), "packed")
    shared = correct.packed_trusted(good, 15)
    got, want = (correct.suspects(frame, good, 15, 33, shared=s).where("read_id NOT IN (7, 8, 9)") for s in (shared, None))
    assert "aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_reduce_qmers_fixed_makes_no_row_of_a_window(spark):
    """F8: each counter sums up before anything is sent."""
    steps = plan(spark, "reduce_qmers_fixed")
    assert "Generate" not in steps and "FlatMapGroupsInArrow" in steps


def test_component_union_joins_and_numbers_no_windows(spark):
    """windows are looked up where the reads are."""
    assert not any(step in plan(spark, "component_union") for step in ("Join", "Window", "Exchange"))


def test_packed_counts_give_the_same_cutoffs_sample(spark):
    """the sample of each AT count needs no letters."""
    reads = fixture.reads(spark, SF)
    want = coverage.stratified_sample(kmers.count_kmers(reads, 15), 50)
    got = coverage.stratified_sample(kmers.packed_counts(reads, 15), 50, k=15).select(dna.unpack("packed", 15).alias("kmer"), "n", "at")
    assert got.count() > 500 and got.exceptAll(want.select("kmer", "n", "at")).count() == 0 and want.count() == got.count()


def test_sums_of_doubles_go_by_buckets(spark):
    """as the sums of windows as rows, but for the last bits."""
    reads = fixture.reads(spark, SF)
    rows = kmers.weighted_kmers(reads, 15, fixture.OFFSET).where(F.col("weight") > kmers.WEIGHT_FLOOR).groupBy("kmer").agg(F.sum("weight").alias("q"))
    counts = kmers.count_qmers(reads, 15, fixture.OFFSET)
    assert "FlatMapGroupsInArrow" in counts._jdf.queryExecution().executedPlan().toString() and counts.dtypes == [("kmer", "string"), ("q", "double")]
    got, want = ({r.kmer: r.q for r in f.collect()} for f in (counts, rows))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_reduce_kmers_makes_no_row_of_a_window(spark):
    """each counter sums up before anything is sent."""
    steps = plan(spark, "reduce_kmers")
    assert "Generate" not in steps and "FlatMapGroupsInArrow" in steps


def test_untrusted_components_joins_and_numbers_no_windows(spark):
    """windows are looked up where the reads are."""
    assert not any(step in plan(spark, "untrusted_components") for step in ("Join", "Window", "Exchange"))


def test_component_intersect_joins_and_numbers_no_windows(spark):
    """windows are looked up where the reads are."""
    assert not any(step in plan(spark, "component_intersect") for step in ("Join", "Window", "Exchange"))


def test_untrusted_positions_joins_and_numbers_no_windows(spark):
    """windows are looked up where the reads are."""
    assert not any(step in plan(spark, "untrusted_positions") for step in ("Join", "Window", "Exchange"))


def test_the_largest_bucket_of_trusted_scalar_is_small(spark):
    """F16: a task counts one bucket at a time, so that is what it holds."""
    rng = np.random.default_rng(3)
    reads = superkmers.Reads(rng.integers(0, 4, 400_000).astype(np.uint8), np.array([0, 400_000]))
    batch = superkmers.sent(reads, np.ones(400_000 - 15 + 1, dtype=bool), None, 15, superkmers.BUCKETS_A_PARTITION, True)
    sizes = [len(b) for b in batch.column("bases").to_pylist()]
    assert max(sizes) < sum(sizes) / 20


def test_only_doubtful_reads_are_trimmed_base_by_base(spark):
    """a read without a base below the threshold is as long as it was, whatever marks it has."""
    marks = ["", "I" * 40, "#" * 10, "I" * 20 + "#" * 6, "#" * 3 + "I" * 9, "$" * 7, "!I!I!", "IéI", "I\"\"\"", "\x1fI\x1f", "II$##$"]
    frame = spark.createDataFrame([(i, "A" * len(m), m) for i, m in enumerate(marks)] + [(99, "AC", None)], "read_id long, seq string, qual string")
    for threshold in (1, 3, 9):
        for clamped in (False, True):
            q = dna.clamped_phreds("__q") if clamped else F.col("__q")
            want = frame.withColumn("__q", dna.phreds("qual", 33)).withColumn("__q", q).select("read_id", trim.trim_length("__q", threshold).alias("n"))
            got = trim.quick_trim(frame, threshold, 33, clamped)
            assert "RLIKE" in got._jdf.queryExecution().optimizedPlan().toString()
            assert {r.read_id: r.trim_len for r in got.collect()} == {r.read_id: r.n for r in want.collect()}


def test_the_largest_bucket_of_kmer_pack_is_small(spark):
    """a task counts one bucket at a time, so that is what it holds."""
    rng = np.random.default_rng(3)
    reads = superkmers.Reads(rng.integers(0, 4, 400_000).astype(np.uint8), np.array([0, 400_000]))
    batch = superkmers.sent(reads, np.ones(400_000 - 21 + 1, dtype=bool), None, 21, superkmers.BUCKETS_A_PARTITION, True)
    sizes = [len(b) for b in batch.column("bases").to_pylist()]
    assert max(sizes) < sum(sizes) / 20


def test_a_bucket_is_spelt_out_in_pieces(spark, monkeypatch):
    """what a task holds of a bucket is a few bytes a window, and no more bases at a time than a piece has; the counts are the same."""
    rng = np.random.default_rng(4)
    sent = []
    for i in range(30):
        own = superkmers.Reads(rng.integers(0, 4, 60_000).astype(np.uint8) if i % 3 else np.tile(rng.integers(0, 4, 600), 100).astype(np.uint8), np.arange(0, 60_001, 60))
        sent.append(superkmers.sent(own, windows.inside(own, 15), None, 15, 1, True))
    table, most, spelt = pa.Table.from_batches(sent), [], windows.canonical
    want = superkmers.received(table, 15, False, True)
    monkeypatch.setattr(superkmers, "PIECE", 100_000, raising=False)
    monkeypatch.setattr(windows, "canonical", lambda codes, *a: most.append(len(codes)) or spelt(codes, *a))
    got = superkmers.received(table, 15, False, True)
    assert all(map(np.array_equal, got, want)) and want[1].sum() == 30 * 1000 * 46
    assert max(most) < 300_000 < sum(most)


def test_stratified_sample_keeps_packed_kmers(spark):
    """what is written and read again has no letters."""
    counts = kmers.packed_counts(fixture.reads(spark, SF), 15)
    got = coverage.stratified_sample(counts, 7, k=15)
    assert dict(got.dtypes) == {"packed": "bigint", "n": "bigint", "at": "int"}
    assert {r["at"]: r["m"] for r in got.groupBy("at").agg(F.count("*").alias("m")).collect()}[7] == 7


def test_contigs_of_odd_texts_are_those_of_the_sql(spark):
    long = " ".join(f"w{i}" for i in range(250_000))
    assert len(long) > fixture._PIECE
    assert list(fixture._pieces(b"x" * 7)) == [b"x" * 7] and b"".join(fixture._pieces(long.encode())) == long.encode() and len(list(fixture._pieces(long.encode()))) > 1
    texts = ["one two", "", None, " \t\r\n\x0b\x0c ", "  lead\x0bvt\x0cff\r\ncrlf  ", "\x1cnot\x1da\x1eblank here too", "grüß 猫 x\u0085y", "w" * 100 + " " + "w" * 100, long]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    found = fixture.contigs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    wanted = con.execute(f"WITH {fixture._CONTIGS.format(base=fixture._BASE).strip().removesuffix(',')} SELECT contig_id, cseq FROM contigs").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(wanted) == 6


def test_staged_reads_hold_the_columns_asked_for_only(spark):
    assert registry._staged_reads(spark, SF, "read_id", "seq").columns == ["read_id", "seq"]


def test_only_reads_with_components_as_asked_for_are_searched(spark):
    rows = {which: registry._doubled_rows(spark, SF, which)[0] for which in ("n_comps = 2", "n_comps = 1 AND width > 14", "true")}
    two, one, whole = ([(r.read_id, len(r.comps), max(r.comps[0].starts) - r.comps[0].starts[0]) for r in found.collect()] for found in rows.values())
    assert 0 < len(two) and 0 < len(one) and len(two) + len(one) < len(whole)
    assert sorted(two) == sorted(r for r in whole if r[1] == 2) and sorted(one) == sorted(r for r in whole if r[1] == 1 and r[2] > 14)


def doubtful_ends(spark, k, n, *errors):
    """(reads with wrong doubtful bases at `errors`, k-mers trusted, their file as bits, as numbers): the true last window is not trusted, but many others are."""
    rng = np.random.default_rng(k)
    truth = rng.integers(0, 4, (n, 60))
    w, up = np.lib.stride_tricks.sliding_window_view(truth, k, axis=1), 4 ** np.arange(k)[::-1]
    own = np.minimum(w @ up, (3 - w) @ up[::-1])
    at_random = np.flatnonzero(rng.random(4**k) < 0.12)
    known = np.setdiff1d(np.union1d(own[:, :-1], at_random), own[:, -1])
    codes, quality = truth.copy(), np.full((n, 60), 40)
    for p in errors:
        codes[:, p], quality[:, p] = (truth[:, p] + rng.integers(1, 4, n)) % 4, 7
    texts = [["".join(map(chr, row)) for row in letters] for letters in (np.frombuffer(b"ACGT", dtype=np.uint8)[codes], quality + 33)]
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*texts))], "read_id long, seq string, qual string")
    good = spark.createDataFrame(pa.table({"packed": known})).select(dna.unpack("packed", k).alias("kmer"), "packed")
    bits = correct.packed_trusted(good, k)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(correct, "_SPARSE", 0)
        numbers = correct.packed_trusted(good, k)
    assert bits.bits and not numbers.bits
    return frame, known, good, bits, numbers


def test_correct_reads_asks_no_bit_that_is_not_there(spark):
    """two edits near the end of a read, tried for windows beyond it, by uniform and by learnt rates."""
    k = 11
    frame, _, good, bits, numbers = doubtful_ends(spark, k, 2000, 59)
    rows, out = correct.suspects(frame, good, k, 33, shared=bits), []
    for shared in (bits, numbers):
        learnt = error_model.smoothed(correct.learn(rows, shared, k, 33, PRIORS)).orderBy("q", "actual", "observed").collect()
        found = correct.searched(rows, shared, k, 33, error_model.as_array(learnt), PRIORS).withColumn("header", F.lit("r"))
        out.append((learnt, correct.annotated(found, 33).orderBy("read_id").collect()))
    assert out[0] == out[1] and {"corrected", "trimmed"} <= {r.status for r in out[0][1]}


def test_component_edits_asks_no_bit_that_is_not_there(spark):
    """the same where the read has another component before."""
    k = 11
    frame, _, good, bits, numbers = doubtful_ends(spark, k, 2000, 20, 59)
    rates = error_model.uniform()
    rates[:] = [[(0.0, 0.5, 0.3, 0.2)[(o - a) % 4] for o in range(4)] for a in range(4)]
    rows = correct.suspects(frame, good, k, 33, shared=bits).where("size(comps) = 2")
    by_bits, by_numbers = (correct.searched(rows, shared, k, 33, rates, PRIORS).orderBy("read_id").collect() for shared in (bits, numbers))
    assert by_bits == by_numbers and any(r.edits for r in by_bits)


def test_single_edits_asks_no_bit_that_is_not_there(spark):
    """the same, against a search of each read."""
    k = 11
    frame, known, good, bits, _ = doubtful_ends(spark, k, 600, 59)
    rows = correct.suspects(frame, good, k, 33, shared=bits).where("size(comps) = 1").orderBy("read_id")
    found = correct.searched(rows, bits, k, 33, error_model.uniform(), PRIORS).orderBy("read_id").select("cor", "solved", "edits").collect()
    right, trusted_set, want = np.array(dna.quality_probabilities()), search.TrustedSet(known, k), []
    for r in rows.toPandas().itertuples(index=False):
        read, comps = correct._parsed(r, 33, right)
        want.append(correct._outcome(r, *search.correct(read, comps, trusted_set, error_model.uniform(), PRIORS)[:3]))
    assert [(r.cor, r.solved, [e.asDict() for e in r.edits]) for r in found] == want
    assert any(w[1] for w in want) and not all(w[1] for w in want)
