"""Lines that many documents share: explode, hash, count documents, drop, reassemble.

Each text gives one row for each of its different line keys, hashed to 128 bits.
Counting the documents of a hash is an aggregation that sums up before it
shuffles, so a line in every document is no hot spot.  What a document loses
comes from a join of those rows with the repeated hashes, a join that Spark
splits where it is skewed.  Texts move only where a bitmap of the documents
that lose lines can't rule it out; lines are put back together by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap
from .common import fresh, release, staged, table

#: Shorter keys (in code points) never lose a line.
LEAST_LENGTH = 10
#: Documents that must hold a key before its lines go.
DOCUMENTS = 2
#: UTF-8 has at most so many bytes a code point.
_WIDEST = 4


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case; other letters stay."""
    return line.strip().lower()


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= _WIDEST * least or len(key.decode("utf-8", "replace")) >= least)


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, text_key, line): a row for each different key of a text, hashed; text_key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = {_hash(k) for k in set(map(line_key, batch.column(2)[i].as_py().encode().split(b"\n"))) if _counts(k, least)}
                if found:
                    one = batch.slice(i, 1).to_pydict()
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(one["doc_id"] * len(found), pa.int64()), "text_key": pa.array(one["text_key"] * len(found), pa.int64()), "line": pa.array(sorted(found), pa.binary())}
                    )

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, line binary")


def repeated_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(line, keeper): hashes in at least `documents` documents and the least doc_id that holds each.

    Rows of one doc_id are one document, those without an id are another one;
    they are no keeper unless no other document holds the line.
    """
    held = lines.groupBy("line").agg(F.count_distinct(F.struct("doc_id")).alias("documents"), F.min("doc_id").alias("keeper"))
    return held.where(F.col("documents") >= documents).select("line", "keeper")


def _assembled(rows: DataFrame, lost: str, lines: str, dropped: str) -> DataFrame:
    """rows with `text` cut down by the hashes in the column `lost`, which goes."""
    names = [c for c in rows.columns if c != lost]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != lost), f"`{lines}` bigint", f"`{dropped}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            gone = batch.column(batch.schema.get_field_index(lost))
            for text, out in zip(batch.column(batch.schema.get_field_index("text")), gone):
                out, own = set(out.as_py() or ()), text.as_py().encode().split(b"\n")
                stay = [x for x in own if not out or _hash(line_key(x)) not in out]
                texts.append(b"\n".join(stay).decode())
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(stay))
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, lines, dropped])

    return rows.mapInArrow(run, schema)


def drop_repeated(docs: DataFrame, least: int = LEAST_LENGTH, documents: int = DOCUMENTS, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """docs with `text` without the lines that other documents hold, and the columns n_lines and n_dropped.

    A line goes if its key has `least` code points and is in `documents`
    documents or more, except in the one with the least doc_id, where all its
    copies stay.  n_lines counts before dropping.  A null or empty text has one
    empty line and comes back as it was.  A text may lose all its lines: it is
    empty then.  Repeats of a row, and other rows of its doc_id, are one
    document: what one keeps all keep.  Rows without an id are one document
    that is kept last.  Other columns pass through; columns with the names of
    the two counts are replaced.  An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in (lines.lower(), dropped.lower())]
    docs = docs.select(*kept)
    id_, key, maybe, lost, own_id, own_key = fresh(docs, "__id", "__key", "__maybe", "__lost", "__own_id", "__own_key")
    hashed = staged(line_hashes(docs, least), "line-hashes")
    repeated = staged(repeated_lines(hashed, documents).withColumn("place", F.xxhash64("line")), "repeated-lines")
    seen = bitmap(repeated, "place")
    asked = seen.marked(hashed.withColumn("place", F.xxhash64("line")), "place").where("maybe").drop("maybe", "place")
    goes = asked.join(repeated.drop("place"), "line").where("NOT doc_id <=> keeper")
    losses = staged(goes.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines")), "lost-lines")
    release(hashed)
    hit = bitmap(losses, "text_key")
    rows = hit.marked(docs.withColumns({id_: F.col("doc_id").cast("bigint"), key: F.xxhash64("text")}), key, maybe)
    # xxhash64 of a null is its seed, no null: the flag and the filter on text decide.
    at_once = rows.where(~F.col(maybe) | F.col("text").isNull()).select(
        *kept, (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias(lines), F.lit(0).cast("bigint").alias(dropped)
    )
    losses = losses.toDF(own_id, own_key, lost)
    some = rows.where(F.col(maybe) & F.col("text").isNotNull()).join(losses, (F.col(key) == F.col(own_key)) & F.col(id_).eqNullSafe(F.col(own_id)), "left")
    return at_once.union(_assembled(some.select(*kept, lost), lost, lines, dropped))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every whole document, what goes, and a digest of what stays.  See drop_repeated() for nulls and repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = drop_repeated(docs)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same by windows over plain lines.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT d.row, d.doc_id, u.place, u.line, regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS place) u),
keyed AS (SELECT row, doc_id, place, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN h.key IS NULL THEN k.line END, chr(10) ORDER BY k.place), '')) AS kept_sha256
FROM keyed k LEFT JOIN held h ON h.key = k.key AND h.keeper <> k.doc_id GROUP BY k.row
"""
