"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, of the rows that they keep.  run() writes
what a stage returns to the shared folder and reads it again for the next.
Stages see only doc_id and text by name: other columns come back as they were,
even if they are named like what an operator adds (score, n_words, spans).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import decontaminate, jaccard, packing, secrets, toxicity
from helixmill.llm.bitmap import bitmap
from helixmill.llm.common import fresh, staged, table
from helixmill.shipping import ship


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all other columns than doc_id and text under names of no operator, and what gives the names back."""
    own = {c: c if c in ("doc_id", "text") else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), lambda found: found.select(*(F.col(name).alias(c) for c, name in own.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models don't reject; they learn from `docs` and labels.

    Rows are judged one by one: repeated rows share their fate, a null or empty
    text is not toxic.  A null doc_id has no label and is judged like others.
    """
    model = toxicity.fit(docs, table(ship(spark), sf_dir, "labels"))
    apart, back = _apart(docs)
    return back(toxicity.score(apart, model).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the row with the least doc_id.

    Rows are told apart by doc_id and text, so rows of one doc_id with unlike
    texts are judged each by itself; of rows that tie (same id, or none) the
    one with the least hash stays, and of identical ones any.  A component
    without any doc_id keeps one row too.  Texts without words are like
    nothing: all stay, repeated or not.  Texts are shuffled only where a bitmap
    of the rows to go can't tell.
    """
    ship(spark)
    found = staged(jaccard.similar(docs), "components")
    judged = found.where("part IS NOT NULL")
    stays = staged(judged.where("doc_id <=> component_id").groupBy("part").agg(F.min("key").alias("key"), F.count("*").alias("n")), "stays")
    gone = staged(judged.join(stays.select("key"), "key", "left_anti").select("key").distinct(), "gone")
    again = judged.join(stays.where("n > 1").select("key"), "key", "left_semi").groupBy("key").count().where("count > 1").select("key")
    again = staged(again, "repeated")
    asked = bitmap(gone.union(again), "key")
    key, maybe = fresh(docs, "__key", "__maybe")
    rows = asked.marked(docs.withColumn(key, jaccard.row_key()), key, maybe)
    kept = rows.where(~F.col(maybe)).select(*docs.columns)
    left = rows.where(F.col(maybe)).join(gone.withColumnRenamed("key", key).hint("merge"), key, "left_anti")
    if again.isEmpty():
        return kept.union(left.select(*docs.columns))
    again = again.withColumnRenamed("key", key)
    once = left.join(again, key, "left_semi").dropDuplicates([key])
    return kept.union(left.join(again, key, "left_anti").select(*docs.columns)).union(once.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth repeats windows of the benchmark.

    Rows are judged one by one, whatever their doc_id; null and empty texts stay.
    """
    apart, back = _apart(docs)
    return back(decontaminate.contamination(apart, table(ship(spark), sf_dir, "benchmark")).where("NOT contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's span replaced by its kind and n_chars counted anew.

    No row goes: a null text stays null, repeated rows stay repeated.
    """
    ship(spark)
    apart, back = _apart(docs)
    return back(secrets.find(apart, redact=True)).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Repeated rows and null doc_ids have pieces like others; a null or empty
    text is one piece of one token.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: The stages learn, join by similarity and tokenise: no SQL says the same.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
