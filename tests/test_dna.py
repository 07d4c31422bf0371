from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.functions import dna

KMERS = st.lists(st.text("ACGT", min_size=1, max_size=31), min_size=1, max_size=30)


@settings(max_examples=5, deadline=None)
@given(KMERS)
def test_reverse_complement_pack_and_canonical(spark, kmers):
    df = spark.createDataFrame([(k,) for k in kmers], "kmer string")
    rc = dna.reverse_complement
    rows = df.select("kmer", rc("kmer").alias("rc"), rc(rc("kmer")).alias("back"), dna.canonical("kmer").alias("c"), dna.canonical(rc("kmer")).alias("c2"), dna.pack("kmer").alias("p"), dna.at_count("kmer").alias("at")).collect()
    for r in rows:
        assert r.back == r.kmer and r.c == r.c2 == min(r.kmer, r.rc)
        assert r.p == int("".join(str("ACGT".index(c)) for c in r.kmer), 4)
        assert r.at == sum(c in "AT" for c in r.kmer)


def test_unpack_and_unknown_bases(spark):
    row = spark.createDataFrame([("AACGT", "ACNGT", "acgta", None)], "a string, n string, low string, z string").select(
        dna.unpack(dna.pack("a"), 5).alias("a"), dna.is_known("a").alias("ok"), dna.is_known("n").alias("n"), dna.is_known("low").alias("low"), dna.pack("z").alias("z")
    ).head()
    assert tuple(row) == ("AACGT", True, False, False, None)


def test_phreds(spark):
    row = spark.createDataFrame([("!\"(I", "")], "q string, e string").select(dna.phreds("q", 33).alias("q"), dna.phreds("e", 33).alias("e")).withColumn("p", dna.probabilities("q")).withColumn("c", dna.clamped_phreds("q")).head()
    assert row.q == [0, 1, 7, 40] and row.e == [] and row.c == [1, 1, 7, 40]
    assert row.p[0] == row.p[1] == 0.25 and abs(row.p[3] - 0.9999) < 1e-12


def test_quality_out_of_range_is_an_error(spark):
    import pytest

    for text in (chr(33 + 60), chr(32)):
        with pytest.raises(Exception, match="quality out of range"):
            spark.createDataFrame([(text,)], "q string").select(dna.checked_phreds("q", 33)).collect()
    assert spark.createDataFrame([(chr(33 + 59),)], "q string").select(dna.checked_phreds("q", 33).alias("x")).head().x == [59]


def test_columns_are_jvm_side(spark):
    plan = spark.createDataFrame([("ACGT",)], "kmer string").select(dna.canonical("kmer"), F.length("kmer"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
