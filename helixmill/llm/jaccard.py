"""Grouped prefix join: documents whose word shingles agree to three quarters.

A global order of shingles, rare ones first, comes from a fixed-size sketch of
how many documents hold each.  Two sets that are alike enough share a shingle
of their prefixes in that order.  Documents with the same prefix and size form
one group, and only groups meet: in each prefix shingle's list every group is
first paired with one hub, and only members of groups that these links leave
apart are paired with each other.  Pairs pass size and position filters, then
their members' whole sets are compared.  That loses no link between components,
and a group of near copies costs a star, not all its pairs.

Sets with equal 64-bit digests are one class; shingles are 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .bitmap import bitmap
from .common import release, staged, table
from .components import components
from .packed import pack_numbers, unpack_numbers

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
SKETCH_BITS, _CHUNKS = 22, 64
#: Prefix rows of one shingle that meet in one list; the key of a more common
#: shingle has a salt in its low bits.
_SALT_ROWS, _SALT_BITS = 4096, 16
#: Prefix entries that a task packs at once; text whose entries share a bucket, 12 bytes an entry or so.
_FLUSH, _BUCKET_BYTES = 300_000, 16_000_000
#: Pairs whose texts are compared at once.
_PAIRS_AT_ONCE = 100


def row_key() -> Column:
    """What names a row, whether or not its doc_id is null or repeated: a 64-bit hash of id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), "text")


def distinct_shingles(s: tokens.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text), sorted by text and hash, of the slice's shingle sets."""
    w = tokens.words(tokens.LOWER[s.data], s.offset, tokens.NOT_SPACE)
    hash, doc, _ = tokens.shingles(w, WORDS)
    order = np.lexsort((hash, doc))
    hash, doc = hash[order], doc[order]
    new = np.ones(len(hash), dtype=bool)
    new[1:] = (hash[1:] != hash[:-1]) | (doc[1:] != doc[:-1])
    return hash[new], doc[new]


def _digests(hash: np.ndarray, doc: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A digest of each text's set; the rows are sorted by text."""
    count = np.bincount(doc, minlength=n)
    ends = np.append(0, np.cumsum(count))
    sums = np.append(np.zeros(1, dtype=np.uint64), np.cumsum(tokens.mix(hash + np.uint64(seed)), dtype=np.uint64))
    return tokens.mix(sums[ends[1:]] - sums[ends[:-1]] + count.astype(np.uint64)).view(np.int64)


def _cell(hash: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each hash among `cells`, a power of two."""
    return (hash >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def shingle_sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each cell of the hash space the number of (document, shingle) pairs in it.

    All documents count.  Each task adds up its own cells and sends them packed;
    the driver receives 2^bits numbers, whatever the input.
    """
    total = 1 << bits

    def count(batches):
        cells = np.zeros(total, dtype=np.uint32)
        for s in tokens.slices(batches):
            at, n = np.unique(_cell(distinct_shingles(s)[0], total), return_counts=True)
            cells[at] += n.astype(np.uint32)
        if cells.any():
            for k, part in enumerate(np.split(cells, _CHUNKS)):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "cells": [pa.compress(part.tobytes(), "zstd", asbytes=True)]})

    size = total // _CHUNKS

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(pa.decompress(cells, 4 * size, "zstd", asbytes=True), dtype=np.uint32).astype(np.uint64)
        for k, cells in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "cells": [pa.compress(cells.tobytes(), "zstd", asbytes=True)]})

    found = docs.select("text").mapInArrow(count, "chunk int, cells binary").repartition(_CHUNKS, "chunk").mapInArrow(add, "chunk int, cells binary")
    out = np.zeros((_CHUNKS, size), dtype=np.uint64)
    for k, cells in found.collect():
        out[k] = np.frombuffer(pa.decompress(bytes(cells), 8 * size, "zstd", asbytes=True), dtype=np.uint64)
    return out.ravel()


def _prefixes(docs: DataFrame, sketch: np.ndarray, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, cls, grp) of each document, staged, and packed prefixes (bucket, keys, owners, owner, at).

    The prefixes go straight into their shuffle: a second reading of the texts
    takes less room than staging them.  A task gives a group's prefix once.  A prefix entry is a key, its group and
    `at`, which packs the key's place, the set's size and whether the key is
    salted; the entries of a hash bucket are packed together, sorted by key.
    """
    # What a cell holds beyond the usual: with much text, every cell adds up many rare shingles.
    excess = sketch.astype(float) - np.median(sketch)
    # Ranks on a logarithmic scale: chance differences between rare shingles don't count.
    rank = np.round(8 * np.log2(1 + np.maximum(excess, 0))).astype(np.uint16)
    salts = np.clip(excess // _SALT_ROWS, 1, 1 << _SALT_BITS).astype(np.uint32)
    salted = np.flatnonzero(salts > 1)
    sent = docs.sparkSession.sparkContext.broadcast((rank, salted, salts[salted]))

    def packed(held: list):
        key, grp, at = (np.concatenate(c) for c in zip(*held))
        bucket = _bucket(key, buckets)
        order = np.lexsort((key, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                owners, owner = np.unique(grp[own], return_inverse=True)
                data = [pack_numbers(key[own], True), pack_numbers(owners.view(np.uint64), False), pack_numbers(owner, False), pack_numbers(at[own], False)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], names=["bucket", "keys", "owners", "owner", "at"])

    def emit(batches, lean: bool):
        rank, salted, many = sent.value
        seen: set[int] = set()
        held: list = []
        for s in tokens.slices(batches):
            rows = s.batch.num_rows
            hash, doc = distinct_shingles(s)
            n = np.bincount(doc, minlength=rows)
            cls = _digests(hash, doc, rows, 1)
            order = np.lexsort((hash, rank[_cell(hash, len(rank))], doc))
            first = np.append(0, np.cumsum(n))
            keep = np.maximum(n - -(-PERCENT * n // 100) + 1, 0) * (n > 0)
            place = np.arange(len(order)) - first[doc]
            used = place < keep[doc]
            chosen, place = order[used], place[used]
            grp = _digests(hash[chosen], doc[chosen], rows, 2) ^ n
            if lean:
                yield pa.RecordBatch.from_arrays([s.batch.column("doc_id"), s.batch.column("key"), pa.array(n.astype(np.int64)), pa.array(cls), pa.array(grp)], names=["doc_id", "key", "n", "cls", "grp"])
                continue
            key, owner = hash[chosen], doc[chosen]
            fresh = np.zeros(rows, dtype=bool)
            for i, g in enumerate(grp.tolist()):
                fresh[i] = n[i] > 0 and g not in seen
                seen.add(g)
            cell = _cell(key, len(rank))
            j = np.minimum(np.searchsorted(salted, cell), max(len(salted) - 1, 0))
            common = salted[j] == cell if len(salted) else np.zeros(len(key), dtype=bool)
            low = np.uint64((1 << _SALT_BITS) - 1)
            key[common] = (key[common] & ~low) | (cls[owner][common].view(np.uint64) % many[j[common]].astype(np.uint64) & low)
            at = (place << 32) | (n[owner] << 1) | common
            own = fresh[owner]
            held.append((key[own], grp[owner[own]], at[own]))
            if sum(len(h[0]) for h in held) > _FLUSH:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), "text")
    lean = staged(rows.mapInArrow(lambda batches: emit(batches, True), "doc_id long, key long, n long, cls long, grp long"), "sets")
    return lean, rows.select("text").mapInArrow(lambda batches: emit(batches, False), "bucket int, keys binary, owners binary, owner binary, at binary")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((tokens.mix(key) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _shared_lists(rows: pa.Table) -> pa.Table:
    """The lists of a bucket with several groups or a salted key: (key, grp, at, hub_grp, hub_at).

    The hub is the group in which the key comes first.  Of unsalted lists with
    the same groups the one with the earliest key stays: it passes the position
    filter for every pair that another one passes.
    """
    parts = []
    for keys, owners, owner, at in zip(*(rows.column(c).to_pylist() for c in ("keys", "owners", "owner", "at"))):
        table = unpack_numbers(owners, False).view(np.int64)
        parts.append((unpack_numbers(keys, True), table[unpack_numbers(owner, False).astype(np.int64)], unpack_numbers(at, False).view(np.int64)))
    key, grp, at = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((grp, at, key))
    key, grp, at = key[order], grp[order], at[order]
    new = np.append(True, (key[1:] != key[:-1]) | (grp[1:] != grp[:-1]) | (at[1:] != at[:-1]))
    key, grp, at = key[new], grp[new], at[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    salted = (at[first] & 1) == 1
    digest = np.add.reduceat(tokens.mix(grp.view(np.uint64)), first)
    order = np.lexsort((at[first], size, digest))
    again = np.zeros(len(first), dtype=bool)
    again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
    keep = salted | ((size > 1) & ~again)
    hub, rows_kept = np.repeat(first, size), np.repeat(keep, size)
    out = key.view(np.int64), grp, at, grp[hub], at[hub]
    return pa.table([pa.array(c[rows_kept]) for c in out], names=["key", "grp", "at", "hub_grp", "hub_at"])


def _may_link(a: str, b: str) -> Column:
    """Size and position filter of two sets by their `at` (see similar) in one list.

    A pair with a link passes it at its first common shingle: what follows it
    in either set must hold the intersection.
    """
    n, n2 = (f"(shiftright({x} & 4294967295L, 1))" for x in (a, b))
    left, left2 = f"({n} - shiftright({a}, 32))", f"({n2} - shiftright({b}, 32))"
    return F.expr(f"least({n}, {n2}) * 100 >= {PERCENT} * greatest({n}, {n2}) AND least({left}, {left2}) * {100 + PERCENT} >= ({n} + {n2}) * {PERCENT}")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The staged pairs (a, b) of classes whose sets are alike enough.

    Each class is judged by the text of the row with its least key; classes is
    (cls, key).  Only texts in question are moved, packed, and each once: a
    bitmap tells beforehand most rows that aren't.  Both joins shuffle at any
    size, so that the plan for a small input is the plan for a large one.
    """
    one, two = (classes.selectExpr(f"cls AS {c}", f"key AS {c}_key") for c in "ab")
    pairs = staged(pairs.join(one, "a").join(two, "b"), "pairs")
    asked = bitmap(pairs.select(F.col("a_key").alias("key")).union(pairs.select("b_key")), "key")

    def shrunk(batches):
        sent: set[int] = set()
        for b in batches:
            fresh = [i for i, k in enumerate(b.column("key").to_pylist()) if k not in sent and not sent.add(k)]
            b = b.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([zlib.compress(t.encode(), 6) if t else b"" for t in b.column("text").to_pylist()], pa.binary())], names=["key", "text"])

    def alike(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _PAIRS_AT_ONCE):
                b = batch.slice(at, _PAIRS_AT_ONCE)
                sides, rows = [], b.num_rows
                for c in ("a", "b"):
                    column = pa.array([zlib.decompress(t) if t else b"" for t in b.column(f"text_{c}").to_pylist()], pa.large_binary())
                    hash, doc = distinct_shingles(tokens.Texts(b, *tokens.flat(column.cast(pa.large_string()))))
                    sides.append((hash, doc, _digests(hash, doc, rows, 1) == b.column(c).to_numpy()))
                (ha, da, ok_a), (hb, db, ok_b) = sides
                hash, doc = np.append(ha, hb), np.append(da, db)
                order = np.lexsort((hash, doc))
                hash, doc = hash[order], doc[order]
                both = np.bincount(doc[1:][(hash[1:] == hash[:-1]) & (doc[1:] == doc[:-1])], minlength=rows)
                union = np.bincount(doc, minlength=rows) - both
                found = b.filter(pa.array((100 * both >= PERCENT * union) & ok_a & ok_b))
                yield pa.RecordBatch.from_arrays([found.column("a"), found.column("b")], names=["a", "b"])
        tokens.trim_memory()

    rows = asked.marked(docs.select(row_key().alias("key"), "text"), "key").where("maybe").select("key", "text")
    # Staged, so that the joins are of plain exchanges, which Spark splits where a text has many pairs.
    texts = staged(rows.mapInArrow(shrunk, "key long, text binary").groupBy("key").agg(F.first("text").alias("text")), "texts")
    a_text, b_text = (texts.selectExpr(f"key AS {c}_key", f"text AS text_{c}").hint("merge") for c in "ab")
    sides = pairs.hint("merge").join(a_text, "a_key").hint("merge").join(b_text, "b_key")
    links = staged(sides.select("a", "b", "text_a", "text_b").mapInArrow(alike, "a long, b long").distinct(), "links")
    release(pairs, texts)
    asked.release()
    return links


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similar(docs: DataFrame, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, part), a row for each row of docs (doc_id, text).

    component_id is the least doc_id reachable by links, the own one included.
    Texts without words (null, empty, blank) have no shingles and no links.
    Equal sets are linked, also of rows with the same doc_id; rows with a null
    doc_id link like others, but null is never a component's id unless all its
    rows have none.  key is row_key() of the row; part names the component (a
    number that only tells components apart), null without shingles.  Columns
    other than doc_id and text are not looked at; an empty table gives an empty one.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    lean, prefixes = _prefixes(docs, shingle_sketch(docs, sketch_bits), max(1, math.ceil(size / _BUCKET_BYTES)))
    classes = staged(lean.where("n > 0").groupBy("cls", "grp").agg(F.min("doc_id").alias("least"), F.min("key").alias("key")), "classes")
    leaders = classes.groupBy("grp").agg(F.min("cls").alias("leader"), F.count("*").alias("members"))
    # Staged, so that joins with it are of plain exchanges, which Spark splits where a class has many pairs.
    one = staged(classes.groupBy("cls").agg(F.min("least").alias("least"), F.min("key").alias("key")), "one")

    shared = staged(prefixes.groupBy("bucket").applyInArrow(_shared_lists, "key long, grp long, at long, hub_grp long, hub_at long"), "shared")
    whole_key = f"IF(at & 1 = 1, key & {-(1 << _SALT_BITS)}L, key)"
    stars = shared.where("grp != hub_grp").where(_may_link("at", "hub_at")).selectExpr("grp AS x", "hub_grp AS y")
    hubs = shared.where("at & 1 = 1 AND grp = hub_grp").selectExpr("grp", "at", f"min(struct(at, grp)) OVER (PARTITION BY {whole_key}) AS top")
    hubs = hubs.where("grp != top.grp").where(_may_link("at", "top.at")).selectExpr("grp AS x", "top.grp AS y")
    lead = leaders.select("grp", "leader")
    stars = stars.union(hubs).distinct().join(lead.selectExpr("grp AS x", "leader AS lx"), "x").join(lead.selectExpr("grp AS y", "leader AS ly"), "y").select(*_pair("lx", "ly"))
    within = classes.join(leaders.where("members > 1"), "grp").where("cls != leader").select(*_pair("cls", "leader"))
    first = _verified(stars.union(within).where("a != b").distinct(), docs, one)
    roots = components(first.selectExpr("a AS u", "b AS v"))

    # Lists that still hold several components: all pairs across them that pass the filters.
    known = classes.select("grp", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").selectExpr("grp", "cls", "coalesce(root, cls) AS root")
    members = staged(known, "members")
    release(roots)
    held = shared.selectExpr(f"{whole_key} AS key", "grp", "at").join(members, "grp").drop("grp")
    # Staged, so that the join is one of plain exchanges, which Spark splits where a key is frequent.
    keys = staged(held.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("key"), "mixed-keys")
    held = staged(held.join(keys, "key", "left_semi"), "mixed")
    release(keys)
    # In a list, sets of one size with the key at one place are a cell.  Cells are paired first: a list of many
    # sets that the filter keeps apart, as of pages from one template, has few cells, and none that pass.
    cells = staged(held.groupBy("key", "at").agg(F.min("root").alias("r1"), F.max("root").alias("r2")), "cells")
    p, q = cells.alias("p"), cells.alias("q")
    mixed = (F.col("p.r1") != F.col("p.r2")) | (F.col("q.r1") != F.col("q.r2")) | (F.col("p.r1") != F.col("q.r1"))
    meet = staged(p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.at") <= F.col("q.at")) & _may_link("p.at", "q.at") & mixed).select("p.key", F.col("p.at").alias("at"), F.col("q.at").alias("at2")), "meeting-cells")
    sides = held.join(meet, ["key", "at"]).alias("p").join(held.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.at2") == F.col("q.at")) & (F.col("p.root") != F.col("q.root")) & ((F.col("p.at") != F.col("p.at2")) | (F.col("p.cls") < F.col("q.cls"))))
    apart = sides.select(*_pair("p.cls", "q.cls"))
    inside = members.join(leaders.where("members > 1"), "grp").select("grp", "cls", "root")
    inside = inside.alias("p").join(inside.alias("q"), (F.col("p.grp") == F.col("q.grp")) & (F.col("p.cls") < F.col("q.cls")) & (F.col("p.root") != F.col("q.root"))).select(*_pair("p.cls", "q.cls"))
    release(shared)
    second = _verified(apart.union(inside).distinct(), docs, one)
    roots = components(first.union(second).selectExpr("a AS u", "b AS v"))
    release(held, members, first, second, cells, meet)

    least = roots.join(one.withColumnRenamed("cls", "node"), "node").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(least, "root").selectExpr("node AS cls", "root", "component")
    # Staged, so that the last join is one of two plain exchanges, which Spark splits where a class is large.
    named = staged(one.join(linked, "cls", "left").selectExpr("cls", "IF(root IS NULL, least, component) AS component", "coalesce(root, cls) AS part"), "named")
    release(classes, roots, one)
    alone = lean.where("n = 0").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id", "key", "CAST(NULL AS BIGINT) AS part")
    return lean.where("n > 0").join(named, "cls").selectExpr("doc_id", "n AS n_shingles", "component AS component_id", "key", "part").union(alone)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component; see similar() for nulls, empty texts, ties and repeated rows."""
    return similar(table(spark, sf_dir, "documents")).drop("key", "part")
