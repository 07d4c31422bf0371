import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.operators import correct, error_model, kmers, model, regions, report, search, trim, trusted
from helixmill.sources import files


def test_trim_matches_a_scan(spark):
    rng = random.Random(3)
    quals = ["".join(chr(33 + rng.choice([0, 1, 2, 3, 7, 40])) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "!!!!", "####", "IIII"]

    def cut(q, t, low):
        total = best = 0
        out = len(q)
        for i in range(len(q) - 1, -1, -1):
            total += t - max(ord(q[i]) - 33, low)
            if total > best:
                best, out = total, i
        return out

    df = spark.createDataFrame([(i, "A" * len(q), q) for i, q in enumerate(quals)], "read_id long, seq string, qual string")
    for clamped, low in ((False, 0), (True, 1)):
        got = {r.read_id: r.trim_len for r in trim.quick_trim(df, 3, 33, clamped).collect()}
        assert got == {i: cut(q, 3, low) for i, q in enumerate(quals)}
    status = {r.read_id: r.status for r in trim.trim_reads(df, 3, 33, keep_short=True).collect()}
    assert set(status.values()) == {"error"} and trim.trim_reads(df, 3, 33).count() == 0


def test_components_and_regions(spark):
    k, n = 4, 20
    pos = [(1, p) for p in (5, 6, 7, 8, 14, 15)] + [(2, p) for p in (0, 1, 9, 10, 11, 12, 13, 14, 15, 16)]
    comps = regions.with_core(regions.components(spark.createDataFrame(pos, "read_id long, pos int"), k), k)
    comps = comps.withColumn("trim_len", F.lit(n)).withColumn("probs", F.expr(f"array_repeat(0.9999D, {n})"))
    rows = {(r.read_id, r.component): r for r in regions.error_region_chop(regions.error_region(comps, k), k).collect()}
    assert rows[1, 0].starts == [5, 6, 7, 8] and rows[1, 0].core == [8] and rows[1, 1].core == [15, 16, 17]
    # The window before vouches for bases up to 7, the one behind for those from 9 on.
    assert rows[1, 0].chopped == [7, 8] and rows[1, 0].region == [8]
    assert rows[2, 0].region == [1, 2, 3, 0] and rows[2, 0].chopped == [1, 0]
    assert rows[2, 1].core == list(range(9, 20)) and rows[2, 1].region[-1] == 19


def _world(seed=1, length=300, reads=400, size=60):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(length))
    out = []
    for i in range(reads):
        at = rng.randint(0, length - size)
        truth = genome[at : at + size]
        seq, qual = truth, "I" * size
        if i % 4 == 0:
            p = rng.randint(0, size - 1)
            seq = seq[:p] + rng.choice([c for c in "ACGT" if c != seq[p]]) + seq[p + 1 :]
            qual = qual[:p] + "(" + qual[p + 1 :]
        if i % 17 == 0:
            seq = seq[:30] + "N" + seq[31:]
            qual = qual[:30] + "#" + qual[31:]
        out.append((i, truth, seq, qual))
    return out


def test_correction_restores_planted_errors(spark, tmp_path):
    k, world = 15, _world()
    reads = spark.createDataFrame(world, "read_id long, truth string, seq string, qual string")
    good = trusted.trusted_scalar(kmers.count_kmers(reads, k), 4)
    priors = trusted.base_priors(good)
    assert abs(sum(priors) - 1) < 1e-12
    rows = correct.suspects(reads.drop("truth"), good, k, 33)
    packed = correct.packed_trusted(good, k)
    counts = correct.learn(rows, packed, k, 33, priors)
    assert sum(r.n for r in counts.collect()) > 50
    learnt = error_model.as_array(error_model.smoothed(counts).collect())
    found = correct.searched(rows, packed, k, 33, learnt, priors)
    out = {r.read_id: r for r in correct.annotated(found.withColumn("header", F.concat(F.lit("r"), "read_id")), 33).collect()}
    truth = {i: t for i, t, _, _ in world}
    assert len(out) == len(world)
    same = sum(r.cor == truth[i] for i, r in out.items())
    wrong = sum(r.cor != truth[i][: len(r.cor)] for i, r in out.items() if r.status != "removed")
    assert same >= 0.93 * len(world) and wrong <= 2
    for r in out.values():
        if "corrected" in r.status:
            assert " correct" in r.out_header and "#" in r.out_qual and len(r.out_qual) == len(r.out_seq)
    # What was corrected has no untrusted window any more, so a second pass changes nothing.
    again = spark.createDataFrame([(i, r.cor, "I" * len(r.cor)) for i, r in out.items() if r.solved], "read_id long, seq string, qual string")
    assert trusted.untrusted_positions(again, good, k).count() == 0
    # A trusted set too large to be broadcast gives the same by rounds of joins.
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    large = correct.packed_trusted(good, k, most=1)
    rounds = correct.searched(rows.where("read_id % 4 = 0 AND read_id < 120"), large, k, 33, learnt, priors).collect()
    assert len(rounds) == 30
    for r in rounds:
        assert (r.cor, r.solved, r.edits) == (out[r.read_id].cor, out[r.read_id].solved, out[r.read_id].edits)


def test_search_against_all_pairs_of_edits():
    k, rng = 5, random.Random(7)
    for _ in range(40):
        truth = [rng.randint(0, 3) for _ in range(16)]
        codes = list(truth)
        for p in rng.sample(range(16), rng.choice([1, 1, 2])):
            codes[p] = (codes[p] + rng.randint(1, 3)) % 4
        up = 4 ** np.arange(k - 1, -1, -1)
        w = np.lib.stride_tricks.sliding_window_view(np.array(truth), k)
        good = search.TrustedSet(np.unique(np.minimum(w @ up, (3 - w) @ up[::-1])), k)
        quality = np.array([7 if a != b else 30 for a, b in zip(truth, codes)])
        right = np.array(dna.quality_probabilities())[quality]
        read = search.Read(np.array(codes), quality, right)
        bad = [int(i) for i in np.flatnonzero(~good.windows(read.codes))]
        if not bad:
            continue
        m, priors = error_model.uniform(), [0.25] * 4
        code, edits, like = search.solve(read, list(range(16)), bad, good, m, priors, False, 1.0)
        singles = [((p, b), x) for p in range(16) for b, x in search.edit_weights(read, p, m, priors)]
        tries = [({p: b}, x) for (p, b), x in singles] + [({p: b, q: c}, x * y) for (p, b), x in singles for (q, c), y in singles if p < q]

        def solved(e):
            c = np.array(codes)
            for p, b in e.items():
                c[p] = b
            return good.windows(c).all()

        best = sorted((x for e, x in tries if solved(e)), reverse=True)
        if code == search.SOLVED and len(edits) <= 2:
            assert solved(edits) and abs(like - best[0]) < 1e-12
            assert len(best) == 1 or best[1] < best[0]
        elif code == search.AMBIGUOUS:
            assert len(best) > 1 or not best


def test_error_model_kernel_and_report(spark):
    counts = spark.createDataFrame([(7, "A", "C", 3), (7, "A", "G", 1), (9, "A", "C", 1)], "q int, actual string, observed string, n long")
    rows = {(r.q, r.actual, r.observed): r.p for r in error_model.smoothed(counts).collect()}
    assert len(rows) == 59 * 12 and rows[7, "C", "A"] == 1 / 3
    w = error_model.kernel_weights()
    assert rows[7, "A", "C"] == (3 * w[0] + w[2]) / (4 * w[0] + w[2]) and rows[7, "A", "T"] == 0
    text = error_model.report(counts.collect(), error_model.smoothed(counts).collect())
    assert "Quality = 7\n\tA\tC\tG\tT\nA\t-\t0.75(3)\t0.25(1)\t0(0)" in text


def test_models_find_planted_parameters():
    rng = np.random.default_rng(5)
    planted = model.IntModel(2.0, 0.5, 2.5, 30.0, 45.0)
    cov = np.arange(1, 200)
    num = np.round(1e6 * (planted.error(cov) + planted.genuine(cov)))
    found = model.fit_int(cov[num > 0], num[num > 0])
    assert abs(found.mean - 30) < 1 and abs(found.p_error - 0.5) < 0.05
    assert 4 <= found.cutoff(200) <= 20
    errors, genuine = rng.gamma(1.2, 0.7, 6000), rng.normal(30, 5.5, 6000)
    q = model.fit_q(np.concatenate([errors, np.maximum(genuine, 0.1)]))
    assert abs(q.mean - 30) < 1 and 2 < q.cutoff(200) < 15
    with pytest.raises(ValueError):
        model.peak(np.arange(1, 5), np.array([5, 4, 3, 2]))
    assert abs(model.zeta(2.0) - np.pi**2 / 6) < 1e-12
    assert abs(model.gamma_cdf(np.array([2.0]), 1.0, 1.0)[0] - (1 - np.exp(-2))) < 1e-12


def test_fastq_files(spark, tmp_path):
    text = "".join(f"@r{i} error\n{'ACGT' * 8}\n+\n{'I' * 32}\n" for i in range(25)).rstrip("\n")
    plain, zipped = tmp_path / "a.fastq", tmp_path / "b.fastq.gz"
    plain.write_text(text)
    zipped.write_bytes(gzip.compress(text.encode()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        for path in (plain, zipped):
            rows = files.read_fastq(spark, str(path)).orderBy("ordinal").collect()
            assert [r.header for r in rows] == [f"r{i} error" for i in range(25)] and rows[-1].qual == "I" * 32
            assert [r.read_id for r in rows] == list(range(25))
        both = files.read_fastq(spark, str(plain), str(zipped)).collect()
        assert len(both) == 50 and {r.read_id >> 40 for r in both} == {0, 1} and len({r.read_id for r in both}) == 50
        # With too many splits to be broadcast, records are put together by a shuffle.
        files.BROADCAST_SPLITS, old = 1, files.BROADCAST_SPLITS
        try:
            again = files.read_fastq(spark, str(plain), str(zipped)).collect()
        finally:
            files.BROADCAST_SPLITS = old
        assert sorted(map(tuple, again)) == sorted(map(tuple, both))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # Other lines between records, blanks inside, quality lines that begin with @.
    mixed = "".join(f"{'# note' if i % 3 else 'x'}@  r{i}\nAC GT{'A' * (i % 5)}\n+r{i}\n@I I@{'#' * (i % 5)}\n{'' if i % 4 else chr(10) + 'junk' + chr(10)}" for i in range(40)) + "@last\nACGT\n"
    (tmp_path / "mixed.fastq").write_text(mixed)
    for size, most in (("100", 10**6), ("100", 1), ("128m", 10**6)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        files.BROADCAST_SPLITS, old = most, files.BROADCAST_SPLITS
        try:
            rows = files.read_fastq(spark, str(tmp_path / "mixed.fastq"), str(plain), lenient=True).where("file LIKE '%mixed%'").orderBy("ordinal").collect()
        finally:
            files.BROADCAST_SPLITS = old
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.ordinal, r.header, r.seq, r.mid, r.qual) for r in rows] == [(i, f"r{i}", "ACGT" + "A" * (i % 5), f"+r{i}", "@II@" + "#" * (i % 5)) for i in range(40)]
    (tmp_path / "bad.fastq").write_text("@x\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        files.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()
    df = files.read_fastq(spark, str(plain))
    assert files.quality_offset(df, 1000).head()[0] == 64  # no byte below 64 among the first reads
    low = spark.createDataFrame([(0, "III"), (1, "I5I")], "ordinal long, qual string")
    assert files.quality_offset(low, 1000).head()[0] == 33 and files.quality_offset(low, 1).head()[0] == 64
    files.write_fastq(df, str(tmp_path / "out"), gzip=True, order=["ordinal"])
    assert files.read_fastq(spark, str(tmp_path / "out")).count() == 25


def test_counts_and_cutoffs_as_text(spark, tmp_path):
    counts = spark.createDataFrame([("ACG", 3.25), ("AAA", 0.5), ("CCC", 1.0)], "kmer string, q double")
    for style, want in (("q", {"ACG\t3.250000", "CCC\t1.000000"}), ("fixed", {"ACG\t3.250", "CCC\t1.000"})):
        files.write_counts(counts, str(tmp_path / style), "q", style, min_count=1)
        assert {r.value for r in spark.read.text(str(tmp_path / style)).collect()} == want
    reads = spark.createDataFrame([("r1", "ACGT", "+", "IIII")], "header string, seq string, mid string, qual string")
    files.write_fastq(reads, str(tmp_path / "one"), one_line=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "one")).collect()] == ["r1\tACGT"]
    (tmp_path / "cutoff").write_text("5.25\nshape: 2\n")
    assert files.read_cutoff(spark, str(tmp_path / "cutoff")) == 5.25
    (tmp_path / "empty").write_text("")
    with pytest.raises(ValueError, match="no cutoff"):
        files.read_cutoff(spark, str(tmp_path / "empty"))


def test_search_bound_changes_no_outcome(monkeypatch):
    k, rng = 5, random.Random(3)
    up = 4 ** np.arange(k - 1, -1, -1)
    monkeypatch.setattr(search, "QUEUE", 3000)
    for _ in range(80):
        truth = [rng.randint(0, 3) for _ in range(18)]
        codes = list(truth)
        for p in rng.sample(range(18), rng.choice([1, 2, 4, 9])):
            codes[p] = rng.choice([0, 1, 2, 3, 3, 2, 1, 0, 4])
        w = np.lib.stride_tricks.sliding_window_view(np.array(truth), k)
        good = search.TrustedSet(np.unique(np.minimum(w @ up, (3 - w) @ up[::-1])), k)
        quality = np.array([rng.choice([7, 30, 40, 40]) for _ in codes])
        read = search.Read(np.array(codes), quality, np.array(dna.quality_probabilities())[quality])
        bad = [int(i) for i in np.flatnonzero(~good.windows(read.codes))]
        args = (read, list(range(18)), bad, good, error_model.uniform(), [0.25] * 4, False, 1.0)
        if bad:
            found = search.solve(*args)
            with monkeypatch.context() as m:
                m.setattr(search, "_most_edits", lambda *args: 10**6)
                whole = search.solve(*args)
            assert found[1:] == whole[1:] and (found[0] == whole[0] or {found[0], whole[0]} <= {search.EXHAUSTED, search.GAVE_UP})


def test_manifest_names_and_counts(spark, tmp_path):
    (tmp_path / "list").write_text("a.fq\nb.fq c.fq\n\nd.fq\n")
    assert [(r.file, r.pe_code) for r in files.read_manifest(spark, str(tmp_path / "list")).orderBy("ordinal").collect()] == [("a.fq", 0), ("b.fq", 1), ("c.fq", 2)]
    (tmp_path / "mixed").write_text("a.fq\nb.fq.gz\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "mixed"))
    assert files.output_name("x/y.fastq.gz", "cor_single", gzip=True) == "x/y.cor_single.fastq.gz"
    assert files.output_name("x/y", "err") == "x/y.err"
    counts = spark.createDataFrame([("ACG", 3), ("AAA", 1)], "kmer string, n long")
    files.write_counts(counts, str(tmp_path / "counts"), min_count=1)
    assert [tuple(r) for r in files.read_counts(spark, str(tmp_path / "counts"), 3).collect()] == [("ACG", 3)]
    (tmp_path / "pairs").write_text(">5\nACG\n>2\nAAA\n")
    assert {tuple(r) for r in files.read_count_pairs(spark, str(tmp_path / "pairs")).collect()} == {("ACG", 5), ("AAA", 2)}
    (tmp_path / "at").write_text("1.5\n2\n3\n4\n")
    assert files.read_at_cutoffs(spark, str(tmp_path / "at"), 3).count() == 4
    with pytest.raises(ValueError):
        files.read_at_cutoffs(spark, str(tmp_path / "at"), 4)


def test_bitset_round_trip(spark, tmp_path):
    good = spark.createDataFrame([("ACGAA",), ("AAAAA",)], "kmer string")
    files.write_bitset(good, 5, str(tmp_path / "bits"))
    want = {"ACGAA", "TTCGT", "AAAAA", "TTTTT"}
    assert {r.kmer for r in files.read_bitset(spark, str(tmp_path / "bits"), 5).collect()} == want
    files.write_raw_bitset(spark.read.parquet(str(tmp_path / "bits")), 5, str(tmp_path / "raw"))
    raw = (tmp_path / "raw").read_bytes()
    assert len(raw) == 4**5 // 8 and raw[0] & 128
    assert {r.kmer for r in files.read_bitset(spark, str(tmp_path / "raw"), 5, raw=True).collect()} == want


@pytest.mark.parametrize("k", [3, 9, 10, 15, 17])
def test_raw_bitset_of_any_size(spark, tmp_path, k):
    rng = random.Random(k)
    some = {"".join(rng.choice("ACGT") for _ in range(k)) for _ in range(12)} | {"A" * k, "G" * k}
    files.write_bitset(spark.createDataFrame([(x,) for x in some], "kmer string"), k, str(tmp_path / "bits"))
    chunks = spark.read.parquet(str(tmp_path / "bits"))
    assert chunks.agg(F.max(F.octet_length("bits"))).head()[0] <= 65_536
    files.write_raw_bitset(chunks, k, str(tmp_path / "raw"))
    assert (tmp_path / "raw").stat().st_size == 4**k // 8
    both = some | {x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in some}
    with open(tmp_path / "raw", "rb") as raw:
        for x in both:
            bit = int(x.translate(str.maketrans("ACGT", "0123")), 4)
            raw.seek(bit // 8)
            assert raw.read(1)[0] & (128 >> bit % 8)
    pieces = files._raw_chunks(spark, str(tmp_path / "raw"), k)
    assert pieces.agg(F.max(F.octet_length("bits"))).head()[0] <= 65_536
    assert sorted(r.kmer for r in files.read_bitset(spark, str(tmp_path / "raw"), k, raw=True).collect()) == sorted(both)
    (tmp_path / "raw").unlink()  # 2 GiB for k = 17


def test_repeated_headers_in_their_order(spark):
    original = spark.createDataFrame([("r", "ACGT", 0), ("r", "ACGA", 1), ("x", "AAAA", 2)], "header string, seq string, ordinal long")
    corrected = spark.createDataFrame([("r", "TCGT", 0), ("r", "ACG", 1), ("x", "CA", 2)], "header string, seq string, ordinal long")
    got = sorted(map(tuple, report.changes(original, corrected, order="ordinal").collect()))
    assert got == [("r", 1, "T", "A"), ("r", 1, "T", "A"), ("r", 4, "T", "A"), ("x", 1, "C", "A")]
    assert sorted(map(tuple, report.changes(original, corrected).collect())) == [("x", 1, "C", "A")]
    assert {(r.pos, r.num) for r in report.trims_by_position(original, corrected, order="ordinal").collect()} == {(3, 1), (4, 1)}


def test_pairs_and_missing_mates(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "pair_id long, ok boolean")
    b = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "pair_id long, ok boolean")
    assert {r.pair_id: r.route for r in report.paired(a, b).collect()} == {1: "pair", 2: "err1_single2", 3: "single1_err2", 4: "err"}
    with pytest.raises(Exception, match="no mate"):
        report.paired(a, b.where("pair_id < 4")).collect()


def test_streaming_counts(spark, tmp_path):
    from helixmill.streaming import counts

    table, folder = str(tmp_path / "table"), str(tmp_path / "in")
    reads = [f"ACGTAC{'ACGT'[i % 4]}GTTTA" for i in range(10)]

    def run(every):
        stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(folder)
        query = counts.stream_counts(stream, 4, table, str(tmp_path / "cp"), every)
        query.processAllAvailable()
        query.stop()

    def same():
        return {r.kmer: r.n for r in counts.counted(spark, table).collect()} == {r.kmer: r.n for r in kmers.count_kmers(spark.read.parquet(folder), 4).collect()}

    assert counts.counted(spark, table).count() == 0
    for i, seq in enumerate(reads):
        spark.createDataFrame([(seq,)], "seq string").coalesce(1).write.mode("append").parquet(folder)
        if i in (3, 6, 9):  # started again from its checkpoint
            run(every=2)
            assert same()
    left = sorted(p.name for p in (tmp_path / "table").iterdir())
    assert sum(n.startswith("upto") for n in left) == 2 and len(left) <= 2 + 4
    # A batch that runs again, and a sum that was cut off, change nothing.
    last = max(int(n.partition("=")[2]) for n in left if n.startswith("upto"))
    (tmp_path / "table" / f"upto={last}" / "_SUCCESS").unlink()
    assert same()
