"""Bounded samples of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Rows that a classifier is fitted on at most; their ids (16 bytes each) are
#: all that is broadcast.
SAMPLE_ROWS = 20_000


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out.  Null id: fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label, fold) of at most `most` labelled documents outside fold 0.

    Which ones: those with the least hashes of the id, so that the choice does
    not depend on the order or the partitions of the input.  Null labels are
    left out; of a document that is labelled twice the larger label counts.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .where(fold() != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.join(F.broadcast(ids), "doc_id").select("text", "label", fold().alias("fold"))
