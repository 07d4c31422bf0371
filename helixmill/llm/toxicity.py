"""Toxicity of documents by two Kneser-Ney models (see kneser_ney)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, tokens
from .common import table
from .labelled import FOLDS, SAMPLE_ROWS, fold, sample
from .packed import pack_numbers, unpack_numbers

THRESHOLD = 0.5
#: Parts in which the counts are summed.
BUCKETS = 32


@dataclass
class Model:
    """score = logistic(slope * (mean log ratio - cut)); cut None: nothing learnt, score 0."""

    ratios: kneser_ney.Ratios
    cut: float | None
    slope: float

    def scores(self, data: np.ndarray, offset: np.ndarray) -> np.ndarray:
        if self.cut is None:
            return np.zeros(len(offset) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.ratios.means(data, offset) - self.cut), -30, 30)))


def _counts(batches):
    """Packed counts by bucket (low bits of the key) and group (label and fold), a few rows a slice."""
    for s in tokens.slices(batches):
        key, doc = kneser_ney.once(*kneser_ney.expressions(s.data, s.offset))
        group = s.batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64) * 8 + s.batch.column("fold").to_numpy(zero_copy_only=False)
        for g in np.unique(group).tolist():
            of_group, n = np.unique(key[group[doc] == g].view(np.uint64), return_counts=True)
            bucket = of_group % np.uint64(BUCKETS)
            for k in np.unique(bucket).tolist():
                yield _packed(k, g, of_group[bucket == k], n[bucket == k])


def _packed(bucket: int, group: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "grp": pa.array([group], pa.int32()), "keys": pa.array([pack_numbers(key, True)], pa.binary()), "n": pa.array([pack_numbers(n, False)], pa.binary())})


def _summed(rows: pa.Table) -> pa.Table:
    """The counts of a bucket, one row a group."""
    group, out = rows.column("grp").to_numpy(), []
    for g in np.unique(group).tolist():
        own = rows.filter(pa.array(group == g))
        parts = [(unpack_numbers(k, True), unpack_numbers(n, False)) for k, n in zip(own.column("keys").to_pylist(), own.column("n").to_pylist())]
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        out.append(_packed(own.column("bucket")[0].as_py(), g, key, np.bincount(at, np.concatenate([n for _, n in parts]).astype(float), len(key)).astype(np.int64)))
    return pa.Table.from_batches(out)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    The counts are summed on the executors.  Each fold's texts are judged by the
    counts of the others, and these differences give the decision's cut and
    slope; the counts of all folds give the ratios used.
    """
    rows = sample(docs, labels, label, most).where("label IN (0, 1)")
    packed = "bucket int, grp int, keys binary, n binary"
    counts = [(r.grp, unpack_numbers(bytes(r["keys"]), True).view(np.int64), unpack_numbers(bytes(r.n), False)) for r in rows.mapInArrow(_counts, packed).groupBy("bucket").applyInArrow(_summed, packed).collect()]

    def ratios(without: int = 0) -> kneser_ney.Ratios:
        used = [c for c in counts if c[0] & 7 != without]
        key, at = np.unique(np.concatenate([k for _, k, _ in used] or [np.zeros(0, dtype=np.int64)]), return_inverse=True)
        n = np.concatenate([n for *_, n in used] or [np.zeros(0)]).astype(float)
        toxic = np.repeat(np.array([g >> 3 == 1 for g, *_ in used], dtype=bool), [len(k) for _, k, _ in used])
        return kneser_ney.fit(key, np.bincount(at[~toxic], n[~toxic], len(key)), np.bincount(at[toxic], n[toxic], len(key)))

    others = docs.sparkSession.sparkContext.broadcast({f: ratios(f) for f in range(1, FOLDS)})

    def means(batches):
        for s in tokens.slices(batches):
            own, out = s.batch.column("fold").to_numpy(zero_copy_only=False), np.zeros(s.batch.num_rows)
            for f in np.unique(own):
                out[own == f] = others.value[f].means(s.data, s.offset)[own == f]
            yield pa.RecordBatch.from_pydict({"mean": out, "label": s.batch.column("label").cast(pa.int64())})

    held = rows.mapInArrow(means, "mean double, label long").toPandas()
    others.destroy()
    return Model(ratios(), *_calibrated(held["mean"].to_numpy(float), held["label"].to_numpy(int)))


def _calibrated(mean: np.ndarray, toxic: np.ndarray) -> tuple[float | None, float]:
    """The cut with the best F1, midway between two values, and a slope to match."""
    if not 0 < toxic.sum() < len(toxic):
        return None, 1.0
    order = np.lexsort((toxic, -mean))
    mean, toxic = mean[order], toxic[order]
    hits, found = np.cumsum(toxic), np.arange(1, len(toxic) + 1)
    last = np.append(mean[1:] < mean[:-1], True)
    best = int(np.argmax(np.where(last, 2 * hits / (found + toxic.sum()), -1)))
    below = mean[best + 1] if best + 1 < len(mean) else mean[best] - 1
    cut = float((mean[best] + below) / 2)
    spread = float(np.median(np.abs(mean - cut)))
    return cut, 3 / max(spread, 1e-6)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with held_out, score and predicted; all other columns pass through.

    Columns of these names are replaced.  A null or empty text has the score of
    a text without expressions; rows are judged one by one, so repeated rows
    have equal scores and an empty table gives an empty one.
    """
    docs = docs.drop("held_out", "score", "predicted").withColumn("held_out", fold() == 0)
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    for f in schema:
        f.nullable = True

    def scored(batches):
        for s in tokens.slices(batches):
            p = model.scores(s.data, s.offset)
            yield pa.RecordBatch.from_arrays([*s.batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*s.batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(scored, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by what the labels outside fold 0 teach; see score() for nulls, empty texts, ties and repeated rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
