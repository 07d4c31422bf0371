"""Sequencing reads derived from the tables documents and events.

Each word of a document is one base, so a document is a contig as long as its
text has words.  Two kinds of reads cover them.  Every contig is read from end
to end by tiles of 60 bases without errors, the last one as short as it comes.
Every event is a read of 60 bases, or what the contig has from there: the
events of a document lie close together, so that their windows are covered
deeply, on alternating strands, with planted substitutions, unknown bases and
low-quality tails.  `truth` is the read without errors; `error_at` the place of
a planted substitution, -1 without.

Documents without an id or without words are no contigs, and an event whose
document is none is no read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Contigs in SQL; Spark makes the same ones in contigs().
_CONTIGS = """
contigs AS (
  SELECT doc_id AS contig_id, array_to_string(list_transform(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x != ''), lambda x: {base}), '') AS cseq
  FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\\x20\\x09-\\x0D]')),"""
_SQL = """
raw AS ({raw}),
strand AS (
  SELECT read_id, contig_id, event, CASE WHEN (read_id {div} 3) % 2 = 0 THEN g ELSE reverse(translate(g, 'ACGT', 'TGCA')) END AS t FROM raw),
err AS (
  SELECT read_id, contig_id, event, t, CAST(length(t) AS INT) AS n, event AND read_id % 97 = 0 AS masked,
         CASE WHEN event AND (read_id {div} 7) % 5 = 0 THEN CAST((read_id * 13) % length(t) AS INT) ELSE -1 END AS ep FROM strand),
reads AS{kept} (
  SELECT read_id, contig_id, t AS truth,
         CASE WHEN masked THEN concat(substring(t, 1, n {div} 2), 'N', substring(t, CAST(n {div} 2 + 2 AS INT), 60))
              WHEN ep >= 0 THEN concat(substring(t, 1, ep), translate(substring(t, ep + 1, 1), 'ACGT', 'CGTA'), substring(t, ep + 2, 60))
              ELSE t END AS seq,
         CASE WHEN ep >= 0 THEN concat(repeat('I', ep), '(', repeat('I', n - ep - 1))
              WHEN event AND read_id % 7 = 0 THEN concat(repeat('I', greatest(n - 6, 0)), repeat('#', least(n, 6)))
              ELSE repeat('I', n) END AS qual, CASE WHEN masked THEN -1 ELSE ep END AS error_at FROM err)"""

_START = "CAST(1 + (contig_id * 131 % greatest(length(cseq) - 74, 1) + ({event} {div} {n}) % 4 * 5) % length(cseq) AS INT)"
#: Tiles and events of a contig; Spark makes both in one pass over the contigs.
_RAW_SPARK = """
  SELECT r.read_id, contig_id, substring(cseq, r.start, 60) AS g, r.event FROM (
    SELECT contig_id, cseq, explode(concat(
      transform(sequence(0, (length(cseq) - 1) div 60), x -> named_struct('read_id', 1000000000000 + contig_id * 1000000 + x, 'start', CAST(x * 60 + 1 AS INT), 'event', false)),
      transform(coalesce(ids, array()), x -> named_struct('read_id', x, 'start', {start}, 'event', true)))) AS r
    FROM {contigs} LEFT JOIN (SELECT event_id % {n} AS place, collect_list(event_id) AS ids FROM {events} GROUP BY event_id % {n}) e ON e.place = contig_id % {n})"""
_RAW_DUCKDB = """
  SELECT 1000000000000 + contig_id * 1000000 + tile AS read_id, contig_id, substring(cseq, CAST(tile * 60 + 1 AS INT), 60) AS g, false AS event
  FROM (SELECT contig_id, cseq, unnest(range(0, (length(cseq) - 1) // 60 + 1)) AS tile FROM contigs)
  UNION ALL
  SELECT event_id AS read_id, contig_id, substring(cseq, {start}, 60) AS g, true AS event
  FROM events JOIN contigs ON contig_id % {n} = event_id % {n}"""

#: Phred offset of the derived reads.
OFFSET = 33
_BASE = "translate(substring(md5(x), 1, 1), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def duckdb_ctes() -> str:
    """The same reads as common table expressions for DuckDB."""
    n = "(SELECT greatest(count(*), 1) FROM documents)"
    return _CONTIGS.format(base=_BASE) + _SQL.format(div="//", kept=" MATERIALIZED", raw=_RAW_DUCKDB.format(n=n, start=_START.format(event="event_id", div="//", n=n)))


#: Bytes of a text that are split at a time; words whose bases a task keeps, and how long they are at most.
_PIECE, _KEPT, _KEPT_BYTES = 1 << 20, 100_000, 64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class _Bases(dict):
    """The base of each word, as bytes: by the first hexadecimal digit of its MD5."""

    def __missing__(self, word: bytes) -> bytes:
        base = b"ACGT"[(at := hashlib.md5(word).digest()[0] >> 4 & 3) : at + 1]
        if len(word) <= _KEPT_BYTES:
            if len(self) >= _KEPT:
                self.clear()
            self[word] = base
        return base


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut at blanks."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + _PIECE)
        to = blank.start() if blank else len(text)
        yield text[at:to]
        at = to


def contigs(documents: DataFrame) -> DataFrame:
    """(contig_id, cseq) of documents (doc_id, text): a base a word."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = _Bases()
        for batch in batches:
            # bytes.split() splits at just these blanks.
            found = [b"".join(b"".join(map(bases.__getitem__, piece.split())) for piece in _pieces(text.as_buffer().to_pybytes())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()).cast(pa.string())], names=["contig_id", "cseq"])

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"contig_id {id_type}, cseq string").where("cseq != ''")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as tasks can run at once; a table of a few small files has fewer."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, contig_id, truth, seq, qual, error_at); the number of documents comes from a count."""
    documents, events = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "events"))
    n = max(1, documents.count())
    sql = _SQL.format(div="div", kept="", raw=_RAW_SPARK.format(n=n, contigs="{contigs}", events="{events}", start=_START.format(event="x", div="div", n=n)))
    documents, events = _spread(documents.select("doc_id", "text"), "doc_id"), _spread(events.select("event_id"), "event_id")
    return spark.sql(f"WITH {sql.lstrip()} SELECT * FROM reads", contigs=contigs(documents), events=events)
