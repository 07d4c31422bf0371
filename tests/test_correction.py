import random

import pytest

from helixmill.plans.correction import build_bitset, correct_files, mates, trim_files, write_run
from helixmill.sources import files


def test_files_are_corrected_end_to_end(spark, tmp_path):
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    truth = {}
    tmp_path = tmp_path / "with blank"
    tmp_path.mkdir()
    for name in ("a.fastq", "b.fastq"):
        lines = []
        for i in range(150):
            at = rng.randint(0, 340)
            seq, qual = genome[at : at + 60], "I" * 60
            truth[f"{name}{i}"] = seq
            if i % 5 == 0:
                p = rng.randint(0, 59)
                seq = seq[:p] + rng.choice([c for c in "ACGT" if c != seq[p]]) + seq[p + 1 :]
                qual = qual[:p] + "(" + qual[p + 1 :]
            if i % 31 == 0:
                qual = "#" * 60
            lines.append(f"@{name}{i}\n{seq}\n+\n{qual}\n")
        (tmp_path / name).write_text("".join(lines))
    run = correct_files(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq")], 13, weighted=False, cutoff=4)
    assert run.offset == 33 and run.cutoff == 4
    rows = run.rows.collect()
    assert len(rows) == 300
    right = sum(r.cor == truth[r.header] for r in rows if r.status != "removed")
    assert right >= 270 and sum(r.status == "removed" for r in rows) >= 9
    stats = run.stats.collect()
    assert [r.validated + r.corrected + r.trimmed_only + r.removed for r in stats] == [150, 150]
    assert len({r.read_id for r in rows}) == 300
    assert run.log.count() == sum(len(r.edits) for r in rows if r.status != "removed")
    routes = {r.pair_id: r.route for r in mates(run, "a.fastq", "b.fastq").collect()}
    assert len(routes) == 150 and routes[0] == "err" and routes[1] == "pair"
    paths, folder = tuple(str(tmp_path / n) for n in ("a.fastq", "b.fastq")), str(tmp_path / "out")

    def read(name):
        return [(r.header, r.seq, r.qual) for r in files.read_fastq(spark, f"{folder}/{name}").orderBy("ordinal").collect()]

    by_id = {r.header: r for r in rows}
    names = {(i, r) for i, r in routes.items()}
    out = write_run(run, [paths], folder, keep_errors=True, log=True)
    assert len(out) == 8 + 6
    for mate in "ab":
        other = "b" if mate == "a" else "a"
        ok = {i: by_id[f"{mate}.fastq{i}"].status != "removed" for i in range(150)}
        both = {i: by_id[f"{other}.fastq{i}"].status != "removed" for i in range(150)}
        for name, used in ((f"{mate}.cor.fastq", lambda i: ok[i] and both[i]), (f"{mate}.cor_single.fastq", lambda i: ok[i] and not both[i]), (f"{mate}.err_single.fastq", lambda i: not ok[i] and both[i]), (f"{mate}.err.fastq", lambda i: not ok[i] and not both[i])):
            want = [by_id[f"{mate}.fastq{i}"] for i in range(150) if used(i)]
            got = read(name) if want else []
            assert [g[1:] for g in got] == [(w.out_seq, w.out_qual) for w in want], name
            assert [g[0] for g in got] == [w.out_header if w.status != "removed" else w.header + " " for w in want]
        text = "\n".join(r.value for r in spark.read.text(f"{folder}/{mate}.stats.txt").collect())
        assert text.split("\n")[0].startswith("Validated: ") and text.split("\n")[3].startswith("Trimmed only: ") and len(text.split("\n")) == 5
        lines = [r.value.split("\t") for r in spark.read.text(f"{folder}/{mate}.fastq.log").collect()]
        assert len(lines) == sum(len(by_id[f"{mate}.fastq{i}"].edits) for i in range(150) if ok[i]) and all(len(x) == 4 for x in lines)
        assert spark.read.text(f"{folder}/error_model.{mate}.txt").count() == 59 * 12 - 1
    assert names
    single = write_run(run, [paths[:1]], str(tmp_path / "single"), keep_errors=True)
    got = [r.header for r in files.read_fastq(spark, single[0]).orderBy("ordinal").collect()]
    assert got == [by_id[f"a.fastq{i}"].out_header for i in range(150) if by_id[f"a.fastq{i}"].status != "removed"]
    # Mates out of step are an error.
    with pytest.raises(Exception, match="has no mate"):
        files.write_paired(run.rows.where("file LIKE '%a.fastq'"), run.rows.where("file LIKE '%b.fastq' AND ordinal < 140"), str(tmp_path / "x.fastq"), str(tmp_path / "y.fastq"))


def test_trimmed_files_and_bit_arrays(spark, tmp_path):
    quals = {"a": ["I" * 40, "#" * 40, "I" * 35 + "#" * 5, "I" * 40], "b": ["I" * 40, "I" * 40, "#" * 40, "#" * 40]}
    for name, own in quals.items():
        (tmp_path / f"{name}.fq").write_text("".join(f"@{name}{i}\n{'ACGT' * 10}\n+{name}\n{q}\n" for i, q in enumerate(own)))
    a, b = (str(tmp_path / f"{n}.fq") for n in "ab")
    trim_files(spark, [(a, b)], offset=33, folder=str(tmp_path / "paired"))
    trim_files(spark, [(a,)], offset=33, folder=str(tmp_path / "single"))

    def read(name):
        return [(r.header, len(r.seq), r.mid) for r in files.read_fastq(spark, str(tmp_path / name)).orderBy("ordinal").collect()]

    assert read("paired/a.trim.fq") == [("a0", 40, "+a")] and read("paired/b.trim.fq") == [("b0", 40, "+b")]
    assert read("paired/a.trim_single.fq") == [("a2", 35, "+a"), ("a3", 40, "+a")] and read("paired/b.trim_single.fq") == [("b1", 40, "+b")]
    assert read("single/a.trim.fq") == [("a0", 40, "+a"), ("a2", 35, "+a"), ("a3", 40, "+a")]
    (tmp_path / "counts").write_text("ACGAA\t5\nAAAAA\t2.5\nCCCCC\t1\n")
    assert build_bitset(spark, str(tmp_path / "counts"), 5, str(tmp_path / "bits"), cutoff=2.5) == 2
    assert {r.kmer for r in files.read_bitset(spark, str(tmp_path / "bits"), 5).collect()} == {"ACGAA", "TTCGT", "AAAAA", "TTTTT"}
    (tmp_path / "at").write_text("1\n9\n9\n5\n9\n2\n")
    assert build_bitset(spark, str(tmp_path / "counts"), 5, str(tmp_path / "bits_at"), cutoffs_path=str(tmp_path / "at")) == 3
    with pytest.raises(ValueError):
        build_bitset(spark, str(tmp_path / "counts"), 5, str(tmp_path / "none"))
