"""Stupid-backoff language-model scores, relationally.

The n-gram counts of the corpus are a table partitioned by hash.  Documents
come in blocks (by a hash of id and text, so that neither a frequent id nor a
group of copies fills one); a block's n-grams are exploded, counted, and sent
to their hash slices, each block's share of a slice as one packed row.  A slice
sums the counts of its n-grams over all blocks and joins the sums to what each
block has sent.  Back in its block, every n-gram of a document finds its count,
and the logarithms are summed per document.  An n-gram that a third of all
documents hold is thus moved once a block, not once an occurrence, and there
are never more packed rows than different n-grams of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import partitions, table
from .packed import pack_numbers, unpack_numbers

#: Words in the longest n-grams of the query; its SQL says the same.
ORDER = 2
BACKOFF = 0.4
#: Scores are sums of integers, millionths of log10, so that no order of rows matters.
SCALE = 1_000_000
BLOCK_BYTES, SLICE_GRAMS = 24_000_000, 2_000_000
_FLUSH = 4_000_000


def _grams(s: tokens.Texts, order: int) -> tuple[tokens.Words, list[np.ndarray]]:
    """(words, keys of the n-grams that end at them for n = 1..order; 0 where a text has fewer words before)."""
    w = tokens.words(tokens.LOWER[s.data], s.offset, tokens.ALNUM)
    place = np.arange(len(w.hash)) - w.first[w.doc]
    keys = [tokens.mix(w.hash ^ np.uint64(1))]
    for n in range(2, order + 1):
        key = np.zeros(len(w.hash), dtype=np.uint64)
        key[n - 1 :] = tokens.combined(w.hash, n)
        key[place < n - 1] = 0
        keys.append(key)
    return w, keys


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, summed counts) of several such."""
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _counted(s: tokens.Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    _, (one, *more) = _grams(s, order)
    return np.unique(np.concatenate([one, *(key[key != 0] for key in more)]), return_counts=True)


def _slice_edges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n hash slices begins among sorted keys."""
    bounds = np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_backoff, score_micro, mean_score), a row for each of docs.

    Words are runs of digits, letters a-z (A-Z in lower case) and non-ASCII
    characters.  Counts cover all documents, repeated rows as often as they
    occur, and leave out the occurrence that is scored: c is one less than the
    corpus has, N, the corpus's words, too.  A word after others has c(n-gram)
    / c(n-gram without it) for the longest n-gram, n up to `order`, that ends
    at it and occurs elsewhere, times BACKOFF for each longer one in the text;
    without one it has BACKOFF for each of them times c(word) / N.  A word that
    occurs nowhere else has BACKOFF / N in place of c(word) / N.  If it backs
    off to a shorter n-gram, it counts in n_backoff.  score_micro sums
    round(SCALE * log10(...)); mean_score is null for a text without words
    (null, empty), whose sum is 0.  Columns other than doc_id and text are not
    looked at.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    slices_ = max(1, math.ceil(size / 6 * max(order - 1, 1) / SLICE_GRAMS))
    blocks_ = max(1, math.ceil(size / BLOCK_BYTES))
    ranged = docs.select(F.expr(f"CAST(pmod(xxhash64(doc_id, text), {blocks_}L) AS INT)").alias("block"), "doc_id", "text")
    # One shuffle of the texts serves both the counting and the scoring of a block.
    ranged = ranged.repartition(partitions(docs.sparkSession), "block")

    def send(batches):
        held: dict[int, list] = {}
        weight = 0

        def flush():
            for block, parts in held.items():
                keys, counts = _merged(parts)
                edges = _slice_edges(keys, slices_)
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b > a:
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([pack_numbers(keys[a:b], True)], pa.binary()), pa.array([pack_numbers(counts[a:b], False)], pa.binary())], names=["slice", "block", "keys", "counts"])
            held.clear()

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks):
                for s in tokens.slices([batch.filter(pa.array(blocks == block))]):
                    part = _counted(s, order)
                    held.setdefault(int(block), []).append(part)
                    weight += len(part[0])
                    if weight > _FLUSH:
                        yield from flush()
                        weight = 0
        yield from flush()

    def count(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        parts = [(unpack_numbers(k, True), unpack_numbers(c, False).astype(np.int64)) for k, c in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist())]
        keys, totals = _merged(parts)
        out: list[list] = [[], [], []]
        for block in np.unique(blocks):
            own = np.unique(np.concatenate([parts[i][0] for i in np.flatnonzero(blocks == block)]))
            for column, value in zip(out, (int(block), rows.column("slice")[0].as_py(), pack_numbers(totals[np.searchsorted(keys, own)], False))):
                column.append(value)
        return pa.table({"block": pa.array(out[0], pa.int32()), "slice": pa.array(out[1], pa.int32()), "totals": pa.array(out[2], pa.binary())})

    sent = ranged.mapInArrow(send, "slice int, block int, keys binary, counts binary")
    totals = sent.groupBy("slice").applyInArrow(count, "block int, slice int, totals binary")
    lengths = docs.mapInArrow(_word_counts, "n long").agg(F.sum("n")).head()[0] or 0

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        batches = texts.select(["doc_id", "text"]).to_batches()
        parts: list = []
        for s in tokens.slices(batches):
            parts.append(_counted(s, order))
            if sum(len(k) for k, _ in parts[1:]) > _FLUSH:
                parts = [_merged(parts)]
        keys = _merged(parts)[0]
        # The sorted keys of a block meet their totals slice by slice.
        by_slice = np.argsort(found.column("slice").to_numpy())
        data = found.column("totals").to_pylist()
        total = np.concatenate([unpack_numbers(data[i], False) for i in by_slice] or [np.zeros(0, dtype=np.uint64)]).astype(float)
        out: list[list] = [[], [], [], []]
        for s in tokens.slices(batches):
            w, grams = _grams(s, order)
            c = [np.zeros(len(w.hash)) for _ in grams]
            for key, own in zip(grams, c):
                own[key != 0] = total[np.searchsorted(keys, key[key != 0])]
            p = np.where(c[0] > 1, c[0] - 1, BACKOFF) / max(lengths - 1, 1)
            backs_off = np.zeros(len(p), dtype=bool)
            # From short to long: a longer n-gram replaces what shorter ones gave, or costs BACKOFF.
            for n in range(1, order):
                seen = np.flatnonzero(c[n] > 1)
                fails = (grams[n] != 0) & (c[n] <= 1)
                p[fails] *= BACKOFF
                p[seen] = (c[n][seen] - 1) / (c[n - 1][seen - 1] - 1)
                backs_off = fails | (backs_off & (grams[n] == 0))
            micro = np.floor(SCALE * np.log10(p) + 0.5)
            rows = s.batch.num_rows
            for column, value in zip(out, (s.batch.column("doc_id"), np.diff(w.first), np.bincount(w.doc, backs_off, rows).astype(np.int64), np.bincount(w.doc, micro, rows).astype(np.int64))):
                column.append(value if isinstance(value, pa.Array) else pa.array(value, pa.int64()))
        return pa.table([pa.chunked_array(c, pa.int64()) for c in out], names=["doc_id", "n_words", "n_backoff", "score_micro"])

    found = ranged.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, n_backoff long, score_micro long")
    return found.withColumn("mean_score", F.expr(f"IF(n_words = 0, NULL, score_micro / CAST(n_words AS DOUBLE) / {SCALE})"))


def _word_counts(batches):
    for s in tokens.slices(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(tokens.words(tokens.LOWER[s.data], s.offset, tokens.ALNUM, hashed=False).start)], pa.int64())})


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of all documents; see scores() for nulls, empty texts, ties and repeated rows."""
    return scores(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM documents),
t AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT rid, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS v FROM t),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
total AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT b.rid, CASE WHEN b.v IS NOT NULL AND c2.n < 2 THEN 1 ELSE 0 END AS backs_off,
         CASE WHEN c2.n >= 2 THEN CAST(c2.n - 1 AS DOUBLE) / (before.n - 1)
              ELSE CASE WHEN own.n > 1 THEN CAST(own.n - 1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END / greatest(total.n - 1, 1)
                   * CASE WHEN b.v IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END END AS p
  FROM b CROSS JOIN total JOIN c1 AS own ON own.w = b.w
  LEFT JOIN c1 AS before ON before.w = b.v LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w),
r AS (SELECT rid, count(*) AS n_words, sum(backs_off) AS n_backoff, sum(CAST(floor(1000000 * log10(p) + 0.5) AS BIGINT)) AS score_micro FROM s GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff,
       CAST(coalesce(score_micro, 0) AS BIGINT) AS score_micro, CAST(score_micro AS DOUBLE) / CAST(n_words AS DOUBLE) / 1000000 AS mean_score
FROM d LEFT JOIN r USING (rid)
"""
