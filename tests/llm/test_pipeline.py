import os

import pytest

import corpus_pipeline
from helixmill.llm import secrets

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in seen.select("doc_id", "text").collect()}
        seen = stage(spark, seen, DATA).cache()
        assert seen.columns == docs.columns, name
        after = {r.doc_id: r.text for r in seen.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name == "secret_scan":
            assert set(after) == set(before)
            auto = secrets._automaton()
            assert not any(secrets.spans_of(t, auto) for t in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
            assert len(after) > 0.6 * len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after)


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __maybe int")


def test_near_duplicates_are_told_apart_by_row(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = a + " tail"
    alone = "these words are like no other ones in here"
    rows = [(3, a), (5, a), (5, b), (5, b), (7, near), (None, near + " x"), (None, alone), (None, alone.upper()), (9, ""), (9, ""), (None, None), (8, "one"), (8, "one two")]
    docs = _documents(spark, rows).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns and {r["__maybe"] for r in kept.collect()} == {7}
    got = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([(3, a), (5, b), (-1, alone), (9, ""), (9, ""), (-1, ""), (8, "one"), (8, "one two")])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_on_odd_rows(spark):
    rows = [(None, "a null id has this text"), (1, None), (1, None), (2, ""), (3, "token=0123456789abcdef " * 2), (3, "token=0123456789abcdef " * 2), (4, "x " * 30_000)]
    docs = _documents(spark, rows)
    for seen in (docs, docs.limit(0)):
        n = seen.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, DATA)
            assert seen.columns == docs.columns, name
            # Of the two rows with a secret, which are the same, the join keeps one.
            assert seen.count() == (n if name == "toxicity" else max(0, n - 1)), name
        assert corpus_pipeline.pack(spark, seen, DATA).where("piece = 0").count() == max(0, n - 1)


ADDED = ("score", "held_out", "predicted", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_the_callers_columns_come_back(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in ADDED)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, DATA)
        assert rows.columns == docs.columns, name
        got = rows.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in ADDED), name


def test_entry_lists_all():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
