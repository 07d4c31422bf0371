"""Quality of documents by a generalised additive model (see gam)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gam, tokens
from .common import table
from .html_text import STOP_WORDS
from .labelled import SAMPLE_ROWS, fold, sample

THRESHOLD = 0.3
_JUDGE_FOLD = 1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\"')"]] = True
_COMMON_MARKS = np.zeros(256, dtype=bool)
_COMMON_MARKS[[ord(c) for c in ".,;:'\"-()?"]] = True

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_bytes_spread", "letters", "upper", "digits", "common_marks", "odd_marks",
    "exclamations", "non_ascii", "blanks", "words_without_letters", "words_with_odd_end", "distinct_words", "top_word", "repeated_shingles",
    "repeated_lines", "line_words", "lines_that_end", "stop_words",
)


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(sorted(STOP_WORDS)).encode(), dtype=np.uint8)
    return np.sort(tokens.words(data, np.array([0, len(data)]), tokens.NOT_SPACE).hash)


_STOP = _stop_hashes()


def _runs(doc: np.ndarray, hash: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct hashes, most occurrences of one) for each of n texts."""
    order = np.lexsort((hash, doc))
    d, h = doc[order], hash[order]
    new = np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])) if len(d) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[first], length)
    return np.bincount(d[first], minlength=n), most


def features(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(texts, len(FEATURES)) of whole texts; a text without bytes has zeros."""
    n = len(offset) - 1
    low = tokens.LOWER[data]
    w = tokens.words(low, offset, tokens.NOT_SPACE)
    size, count = np.diff(offset), np.diff(w.first)
    total = np.append(0, np.cumsum(_LETTER[data]))

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return (sums[offset[1:]] - sums[offset[:-1]]) / np.maximum(of, 1)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, values, n) / np.maximum(count, 1)

    letters = total[offset[1:]] - total[offset[:-1]]
    ascii_mark = (data > 32) & (data < 127) & ~_LETTER[data] & ~((data >= 48) & (data < 58))
    width = (w.end - w.start).astype(float)
    mean = by_word(width)
    last = low[w.end - 1] if len(w.end) else low[:0]
    odd_end = (last < 128) & ~tokens.ALNUM[last] & ~_COMMON_MARKS[last]
    # The stop words' marks are cut off: the hash of the run of letters at the word's start.
    bare = np.flatnonzero(~_LETTER[low[np.maximum(w.end - 1, 0)]]) if len(w.end) else np.zeros(0, dtype=int)
    word_hash = w.hash.copy()
    if len(bare):
        end = w.end[bare].copy()
        for _ in range(3):
            cut = (end - 1 > w.start[bare]) & ~_LETTER[low[end - 1]]
            end = end - cut
        word_hash[bare] = tokens.hashes(low, w.start[bare], end)
    at = np.minimum(np.searchsorted(_STOP, word_hash), len(_STOP) - 1)
    distinct, most = _runs(w.doc, w.hash, n)
    s_hash, s_doc, _ = tokens.shingles(w, 5)
    s_count = np.bincount(s_doc, minlength=n)
    lines = tokens.words(data, offset, _LINE)
    l_count = np.diff(lines.first)
    l_distinct, _ = _runs(lines.doc, lines.hash, n)
    ends = _ENDS[data[lines.end - 1]] if len(lines.end) else np.zeros(0, dtype=bool)
    columns = (
        np.log1p(size), np.log1p(count), np.log1p(l_count), mean, np.sqrt(np.maximum(by_word(width**2) - mean**2, 0)), letters / np.maximum(size, 1),
        share((data >= 65) & (data < 91), letters), share((data >= 48) & (data < 58), size), share(_COMMON_MARKS[data], size), share(ascii_mark & ~_COMMON_MARKS[data], size),
        share(data == 33, count), share(data >= 128, size), share(~tokens.NOT_SPACE[data], size), by_word(total[w.end] == total[w.start]), by_word(odd_end), distinct / np.maximum(count, 1),
        most / np.maximum(count, 1), 1 - _runs(s_doc, s_hash, n)[0] / np.maximum(s_count, 1), 1 - l_distinct / np.maximum(l_count, 1), count / np.maximum(l_count, 1),
        np.bincount(lines.doc, ends, n) / np.maximum(l_count, 1), by_word(_STOP[at] == word_hash),
    )
    return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS) -> gam.Gam:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""

    def rows(batches):
        for s in tokens.slices(batches):
            x = features(s.data, s.offset)
            yield pa.RecordBatch.from_arrays([s.batch.column("label").cast(pa.int32()), s.batch.column("fold").cast(pa.int32()), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["label", "fold", *FEATURES])

    found = sample(docs, labels, label, most).where("label IN (0, 1)")
    found = found.mapInArrow(rows, "label int, fold int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    # The order of rows must not matter for the bins' sums.
    found = found.sort_values(list(found.columns), kind="stable")
    return gam.fit(found[list(FEATURES)].to_numpy(float), found["label"].to_numpy(float), (found["fold"] == _JUDGE_FOLD).to_numpy())


def score(docs: DataFrame, model: gam.Gam, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; all other columns pass through.

    Columns of these names are replaced.  A null or empty text has the score of
    a text of zeros; rows are judged one by one.
    """
    docs = docs.drop("held_out", "score", "predicted").withColumn("held_out", fold() == 0)
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    for f in schema:
        f.nullable = True

    def scored(batches):
        for s in tokens.slices(batches):
            p = model.probabilities(features(s.data, s.offset))
            yield pa.RecordBatch.from_arrays([*s.batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*s.batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(scored, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by what the labels outside fold 0 teach; see score() for nulls, empty texts, ties and repeated rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
