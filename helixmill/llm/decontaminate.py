"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of WINDOW consecutive words of the benchmark items (a
shorter item is one window).  Texts are sequences of word hashes.  For each
pattern length, a table over blocks of a few words says how far the search may
move on when a window ends with that block; only where it may not move is a
bucket, chosen by the window's last and first block, looked up, and what it
holds is compared word by word.  The search runs over many lanes of the text
at once, each lane moving by its own shifts.

The tables grow with the patterns, so that most of their cells stay free and
most moves are long.  They are flat arrays, compiled once on the driver from a
bounded part of the benchmark and broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import staged, table

WINDOW = 13
#: Words in a block, if the patterns have as many.
BLOCK = 3
#: Cells of a shift table for each pattern, 2^_LEAST_BITS at least.
_CELLS, _LEAST_BITS = 8, 16
_LANE = 512
#: Windows that are searched for at once, and bytes of their items; a larger benchmark takes several passes.
PART_WINDOWS, PART_BYTES = 1_000_000, 16_000_000
#: Windows of an item that are kept together when the benchmark is split.
_SEGMENT = 4096


@dataclass
class Patterns:
    """All windows of one length: window j is words start[j].. of the benchmark's words.

    `key` is sorted; the items of window j are owner[first[j]:first[j + 1]].
    """

    length: int
    block: int
    shift: np.ndarray
    key: np.ndarray
    start: np.ndarray
    first: np.ndarray
    owner: np.ndarray

    def move(self, ends: np.ndarray) -> np.ndarray:
        """How far the search may move on from a window that ends with each block."""
        return self.shift[(ends >> np.uint64(64 - len(self.shift).bit_length() + 1)).astype(np.int64)]


@dataclass
class Compiled:
    """A part of the benchmark: its item ids, its words (bytes lie from[w]:to[w] in data), and patterns by length."""

    items: list[str]
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    patterns: list[Patterns]

    def spelt(self, word: int, n: int) -> bytes:
        """The n words from `word` on."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.begin[word : word + n], self.end[word : word + n]))


def _blocks(hash: np.ndarray, block: int) -> np.ndarray:
    return hash if block == 1 else tokens.combined(hash, block)


def compiled(items: list[tuple[str, str]]) -> Compiled:
    """The search tables of (item id, text) pairs.  Null texts have no words.

    Windows that repeat are one pattern, with all their items once each.
    """
    raw = [(text or "").encode() for _, text in items]
    data = tokens.LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    w = tokens.words(data, np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), tokens.ALNUM)
    names = sorted({item for item, _ in items})
    place = {item: i for i, item in enumerate(names)}
    owner = np.array([place[item] for item, _ in items], dtype=np.int32)
    count = np.diff(w.first)
    out = []
    for m in np.unique(np.minimum(count, WINDOW)).tolist():
        if not m:
            continue
        texts = np.flatnonzero(np.minimum(count, WINDOW) == m)
        n = count[texts] - m + 1
        start = np.repeat(w.first[texts], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(_patterns(m, start, np.repeat(owner[texts], n), w.hash))
    return Compiled(names, data, w.start.astype(np.int32), w.end.astype(np.int32), w.hash, out)


def _patterns(m: int, start: np.ndarray, owner: np.ndarray, hash: np.ndarray) -> Patterns:
    block = min(BLOCK, m)
    ends = _blocks(hash, block)
    last = m - block
    key = tokens.mix(ends[start + last] ^ tokens.mix(ends[start]))
    columns = [hash[start + k] for k in range(m)]
    order = np.lexsort((owner, *columns, key))
    start, owner, key, columns = start[order], owner[order], key[order], [c[order] for c in columns]
    new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
    keep = new | np.append(True, owner[1:] != owner[:-1])
    first = np.append(np.flatnonzero(new[keep]), keep.sum())
    bits = max(_LEAST_BITS, int(_CELLS * new.sum()).bit_length())
    shift = np.full(1 << bits, last + 1, dtype=np.uint8)
    for q in range(last, -1, -1):
        # From the far blocks to the near ones, so that the least shift is written last.
        shift[(ends[start[new] + (last - q)] >> np.uint64(64 - bits)).astype(np.int64)] = q
    return Patterns(m, block, shift, key[new], start[new].astype(np.int32), first.astype(np.int64), owner[keep])


def occurrences(p: Patterns, c: Compiled, w: tokens.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of each occurrence of p's windows in the words w of data."""
    n, block = len(w.start), p.block
    if n < p.length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = _blocks(w.hash, block)  # ends[i]: the block of words i .. i + block - 1
    move = p.move(ends)
    first = p.length - block
    at = np.arange(first, len(ends), _LANE)
    stop = np.minimum(at + _LANE, len(ends))
    stops = []
    while len(at):
        step = move[at]
        stops.append(at[step == 0])
        at = at + np.maximum(step, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    start = np.concatenate(stops) - first
    start = start[w.doc[start] == w.doc[start + p.length - 1]]
    key = tokens.mix(ends[start + first] ^ tokens.mix(ends[start]))
    low, high = np.searchsorted(p.key, key), np.searchsorted(p.key, key, "right")
    n = high - low
    start, pattern = np.repeat(start, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    same = np.ones(len(start), dtype=bool)
    for k in range(p.length):
        same &= w.hash[start + k] == c.hash[p.start[pattern] + k]
    start, pattern = start[same], pattern[same]
    same = [b" ".join(data[a:b].tobytes() for a, b in zip(w.start[i : i + p.length], w.end[i : i + p.length])) == c.spelt(p.start[j], p.length) for i, j in zip(start, pattern)]
    same = np.array(same, dtype=bool)
    return start[same], pattern[same]


_RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _pass(docs: DataFrame, part: Compiled, text: str, carried: list[str], again: bool, more: bool) -> DataFrame:
    """docs with n_words, n_hit and the columns `carried` (items found, bits of hit words).

    With `again`, what is found adds to what these columns hold; `more` follows.
    """
    names = ["n_words", "n_hit", *carried]
    rest = docs.drop(*names)
    kinds = zip(names, ("bigint", "bigint", "array<string>", "binary"))
    schema = rest.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in kinds)).schema
    for f in schema:
        f.nullable = True
    sent = docs.sparkSession.sparkContext.broadcast(part)
    items_at, bits_at = carried

    def scan(batches):
        c = sent.value
        for s in tokens.slices(batches, text):
            data = tokens.LOWER[s.data]
            w = tokens.words(data, s.offset, tokens.ALNUM)
            edge = np.zeros(len(w.start) + 1, dtype=np.int64)
            own: dict[int, set[str]] = {}
            for p in c.patterns:
                start, pattern = occurrences(p, c, w, data)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + p.length, -1)
                for i, j in zip(w.doc[start].tolist(), pattern.tolist()):
                    own.setdefault(i, set()).update(c.items[x] for x in p.owner[p.first[j] : p.first[j + 1]])
            hit = np.cumsum(edge[:-1]) > 0
            if again:
                for i, (bits, items) in enumerate(zip(s.batch.column(bits_at).to_pylist(), s.batch.column(items_at).to_pylist())):
                    a, b = w.first[i], w.first[i + 1]
                    hit[a:b] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
                    if items:
                        own.setdefault(i, set()).update(items)
            rows = s.batch.num_rows
            bits = [np.packbits(hit[a:b]).tobytes() if more else b"" for a, b in zip(w.first[:-1], w.first[1:])]
            columns = [
                pa.array(np.diff(w.first).astype(np.int64)), pa.array(np.bincount(w.doc, hit, rows).astype(np.int64)),
                pa.array([sorted(own.get(i, ())) for i in range(rows)], pa.list_(pa.string())), pa.array(bits, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(s.batch.column(x) for x in s.batch.schema.names if x not in names), *columns], names=schema.names)

    return docs.mapInArrow(scan, schema)


def _segments(benchmark: DataFrame) -> DataFrame:
    """(item_id, segment, text, windows): items in segments of at most _SEGMENT windows.

    Segments overlap by WINDOW - 1 words, so that each window lies in one of
    them whole.  Words are as in the search; null ids and null texts are left out.
    """
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("t")).where("item_id IS NOT NULL AND t IS NOT NULL")
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = known.select("item_id", F.regexp_extract_all(lower, F.lit("([0-9a-z\\x{80}-\\x{10FFFF}]+)")).alias("w")).where("size(w) > 0")
    rows = rows.withColumn("segment", F.explode(F.expr(f"sequence(0, greatest(size(w) - {WINDOW}, 0) div {_SEGMENT})")))
    rows = rows.withColumn("w", F.expr(f"slice(w, CAST(segment * {_SEGMENT} + 1 AS INT), {_SEGMENT + WINDOW - 1})"))
    return rows.select("item_id", "segment", F.array_join("w", " ").alias("text"), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)).alias("windows"))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", part_windows: int = PART_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit inside any occurrence of a window; contaminated means that a
    hit word exists and that hits are a twentieth of the words or more.  Null
    and blank texts have no words and are clean; repeated rows are judged one
    by one, and an empty table or benchmark gives no hits.  Item ids that repeat count
    once; items with a null id or text are not searched for, as nothing could name them.  Columns of
    these five names are replaced, all others pass through.

    The benchmark is split by a hash into parts of about part_windows windows,
    so that what is broadcast is bounded; each further part is a further pass
    over the staged documents.
    """
    carried = ["__items", "__bits"]
    while set(carried) & set(docs.columns):
        carried = [f"_{c}" for c in carried]
    kept = [c for c in docs.columns if c not in _RESULT]
    found = docs.select(*kept)
    segments = _segments(benchmark)
    size = segments.agg(F.sum("windows").alias("windows"), F.sum(F.octet_length("text")).alias("bytes")).head()
    parts = max(1, math.ceil((size.windows or 0) / part_windows), math.ceil((size.bytes or 0) / PART_BYTES))
    for k in range(parts):
        own = segments.where(F.pmod(F.xxhash64("item_id", "segment", "text"), F.lit(parts)) == k)
        part = compiled([(r.item_id, r.text) for r in own.select("item_id", "text").collect()])
        if k:
            found = staged(found, "decontaminate")
        found = _pass(found, part, text, carried, again=k > 0, more=k + 1 < parts)
    return found.select(
        *kept, "n_words", "n_hit", F.size(carried[0]).cast("bigint").alias("n_items"), F.sha2(F.array_join(carried[0], ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark; see contamination() for nulls, empty texts, ties and repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
