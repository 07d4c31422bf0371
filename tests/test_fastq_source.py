import gzip
import random

import pytest

from helixmill.sources import fastq_source, files


def _text(rng, n, end="\n", last=True):
    out = []
    for i in range(n):
        size = rng.randint(0, 40) if i < n - 1 else 7
        # Qualities may begin with @ or +, and look like headers.
        out += [f"@r{i} x", "".join(rng.choice("ACGTN") for _ in range(size)), rng.choice(["+", f"+r{i}"]), "".join(rng.choice("@+IA5") for _ in range(size))]
    return end.join(out) + (end if last else "")


def _same(spark, paths, split_bytes):
    want = sorted(map(tuple, files.read_fastq(spark, *paths).collect()))
    rows = fastq_source.fastq(spark, *paths, split_bytes=split_bytes)
    got = sorted(map(tuple, fastq_source.with_ordinals(rows).collect()))
    assert got == want
    return rows


@pytest.mark.parametrize("end,last", [("\n", True), ("\n", False), ("\r\n", True)])
def test_rows_of_any_splits(spark, tmp_path, end, last):
    folder = tmp_path / "with blank"
    folder.mkdir()
    rng = random.Random(len(end) + last)
    one, two = folder / "a.fastq", folder / "b.fastq.gz"
    one.write_bytes(_text(rng, 150, end, last).encode())
    two.write_bytes(gzip.compress(_text(rng, 40, end, last).encode()))
    for size in (1 << 20, 997, 300):
        rows = _same(spark, [str(one), str(two)], size)
    assert rows.select("split").where("file LIKE '%a.fastq'").distinct().count() > 5
    assert rows.where("file LIKE '%gz'").select("split").distinct().count() == 1


def test_every_split_of_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(fastq_source, "_CHUNK", 37)
    text = _text(random.Random(5), 12)
    path = tmp_path / "a.fq"
    path.write_text(text)
    want = [(text.index(f"@r{i} x\n"), f"r{i} x") for i in range(12)]
    for size in range(1, len(text) + 2):
        got = [(r["at"], r["header"]) for s in fastq_source._splits(fastq_source._listed(str(path)), size) for b in fastq_source._records(s) for r in b.to_pylist()]
        assert got == want, size


def test_bad_files_are_errors(spark, tmp_path):
    for k, text in enumerate(["@a\nACGT\n+\nIII\n", "@a\nACGT\n+\n", "a\nACGT\n+\nIIII\n", "@a\nAC\n+\nII\nx\n"]):
        (tmp_path / f"{k}.fq").write_text(text)
        with pytest.raises(Exception, match="not a FASTQ record"):
            fastq_source.fastq(spark, str(tmp_path / f"{k}.fq")).collect()
    (tmp_path / "empty.fq").write_text("")
    assert fastq_source.fastq(spark, str(tmp_path / "empty.fq")).count() == 0
    with pytest.raises(Exception, match="missing"):
        fastq_source.fastq(spark, str(tmp_path / "missing.fq")).collect()


def test_streams_of_files(spark, tmp_path):
    from helixmill.operators import kmers
    from helixmill.streaming import counts

    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()

    def run():
        query = counts.stream_counts(fastq_source.fastq(spark, str(folder), stream=True), 4, table, str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()

    for i in range(3):
        (folder / f"{i}.fastq").write_text(_text(random.Random(i), 20))
        run()
        got = {r.kmer: r.n for r in counts.counted(spark, table).collect()}
        assert got == {r.kmer: r.n for r in kmers.count_kmers(files.read_fastq(spark, str(folder)), 4).collect()}
