"""Hard negatives by a full sort of every anchor's scores.

Rows and anchors are packed into blocks of bounded size, and each block of rows
meets each block of anchors in a join on the block's number: a task holds one
such pair, computes all its integer scores, sorts them for each anchor by score
and id, and reads the sorted list.  Two rounds of that: the first finds the
positives, whose scores are the limits of the second.  Of each pair only the
first few entries of a list go on, and Spark ranks those of all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, release, staged, table
from .vectors import finite, matrix, whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's, and at most as high.
LEAST_PERCENT = 80
#: Components of a block of rows, and of one of anchors, at most (two bytes each where they fit).
BLOCK_VALUES, ANCHOR_VALUES = 4_194_304, 1_048_576
#: Smaller blocks of rows are not made for the sake of more tasks.
LEAST_ROWS = 512
#: Scores that are sorted at a time: eight bytes each.
SORTED_AT_ONCE = 2_000_000

_PACKED = "block int, anchors int, ids binary, known binary, rows binary, labels binary, vectors binary, limits binary"


def _packer(width: int) -> Callable:
    def pack(group: pa.Table) -> pa.Table:
        """A block in one row, in the order of ids (null last) and row numbers."""
        group = group.sort_by([("id", "ascending"), ("row", "ascending")])
        x = matrix(group["x"], width)
        most = int(np.abs(x).max(initial=0))
        limits = [np.array(v if v is not None else [], dtype=np.int64) for v in group["limits"].to_pylist()]
        ends = np.cumsum([0, *map(len, limits)])
        out = {
            "block": group["block"][:1],
            "anchors": pa.array([len(x)], pa.int32()),
            "ids": group["id"].fill_null(0).to_numpy(),
            "known": group["id"].is_valid().to_numpy(),
            "rows": group["row"].to_numpy(),
            "labels": group["label"].to_numpy(),
            "vectors": x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64),
            "limits": np.concatenate([ends, *limits]).astype(np.int64),
        }
        return pa.table({k: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else v for k, v in out.items()})

    return pack


class _Block:
    """A packed block as arrays, from the row of a batch; `prefix` tells rows from anchors."""

    def __init__(self, row: dict, prefix: str, width: int):
        self.n = row[f"{prefix}anchors"]
        self.ids, self.rows, self.labels = (np.frombuffer(row[prefix + c], dtype=np.int64) for c in ("ids", "rows", "labels"))
        self.known = np.frombuffer(row[f"{prefix}known"], dtype=bool)
        raw = row[f"{prefix}vectors"]
        size = len(raw) // max(1, self.n * width)
        self.x = np.frombuffer(raw, dtype=f"i{size}").reshape(self.n, width) if raw else np.zeros((self.n, 0), dtype=np.int64)
        limits = np.frombuffer(row[f"{prefix}limits"], dtype=np.int64)
        self.ends, self.limits = limits[: self.n + 1], limits[self.n + 1 :]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:  # doubles are exact so far, and BLAS multiplies them
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _nearest_alike(score: np.ndarray, order: np.ndarray, a: _Block, at: slice, b: _Block, most: int) -> tuple:
    """(anchor, its list's number, place in b) of the first `most` other rows of the anchor's label."""
    alike = (b.labels[order] == a.labels[at, None]) & (b.rows[order] != a.rows[at, None])
    alike &= np.cumsum(alike, axis=1) <= most
    anchor, place = np.nonzero(alike)
    return anchor, np.zeros(len(anchor), dtype=np.int64), order[anchor, place]


def _below_limits(score: np.ndarray, order: np.ndarray, a: _Block, at: slice, b: _Block, most: int, percent: int) -> tuple:
    """The same for rows of other labels, a list for each positive: at most its score, and at least `percent` of it."""
    anchors, lists, places = [], [], []
    for i in range(len(score)):
        limit = a.limits[a.ends[at.start + i] : a.ends[at.start + i + 1]]
        unlike = order[i][b.labels[order[i]] != a.labels[at.start + i]]
        falling = -score[i][unlike]
        first = np.searchsorted(falling, -limit, "left")
        for p, (start, top) in enumerate(zip(first, limit)):
            own = unlike[start : start + most]
            own = own[100 * score[i][own] >= percent * top]
            anchors.append(np.full(len(own), i))
            lists.append(np.full(len(own), p + 1))
            places.append(own)
    return tuple(np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (anchors, lists, places))


def _read(cells: DataFrame, width: int, pick: Callable) -> DataFrame:
    """(anchor, list, id, score): what pick() reads from the sorted scores of every anchor in every cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a, b = _Block(row, "a_", width), _Block(row, "", width)
                step = max(1, SORTED_AT_ONCE // max(1, b.n))
                for start in range(0, a.n, step):
                    at = slice(start, min(start + step, a.n))
                    score = scores(a.x[at], b.x)
                    # A block stands in the order of ids, so that a stable sort by score is one by score and id.
                    order = np.argsort(-score, axis=1, kind="stable")
                    anchor, number, place = pick(score, order, a, at, b)
                    yield pa.RecordBatch.from_pydict({
                        "anchor": pa.array(a.rows[at][anchor], pa.int64()), "list": pa.array(number, pa.int32()),
                        "id": pa.array(b.ids[place], pa.int64(), mask=~b.known[place]), "score": pa.array(score[anchor, place], pa.int64()),
                    })

    return cells.mapInArrow(run, "anchor bigint, list int, id bigint, score bigint")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that `anchor` (a condition) holds for.

    A component c counts as floor(scale * c), a score is the inner product.
    An anchor's positives are its first `positives` other rows of its label by
    falling score; for each, the first `negatives` rows of other labels whose
    score is between `percent` hundredths of its score and its score.  Ties go
    to the smaller id.

    Rows without a label or a vector, or with a null or non-finite component,
    take no part.  Of vectors of unlike length the shorter counts as if zeros
    followed.  Repeated rows are rows of their own: they are each other's
    positives, and repeated anchors give repeated results.  A null id stands
    behind all others among equal scores and comes back as null.  An anchor
    without positives, or a positive without negatives, gives no row; an empty
    table gives an empty one.  A score beyond 64 bits is an error.  Columns are
    taken by name, others play no part whatever their names.
    """
    spark = rows.sparkSession
    usable = finite(rows, vector).where(F.col(label).isNotNull())
    lean = usable.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole(vector, scale).alias("x"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    # Staged with its row numbers, so that every reading sees the same ones.
    lean = staged(lean.withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    n, asked, width = lean.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("x"))).head()
    width = width or 0
    many = partitions(spark)
    blocks = max(1, -(-n * max(1, width) // BLOCK_VALUES), min(4 * many, n // LEAST_ROWS))
    anchor_blocks = max(1, -(-asked * max(1, width) // ANCHOR_VALUES))

    def packed(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("block", F.expr(f"CAST(pmod(xxhash64(row), {number}) AS INT)")).groupBy("block").applyInArrow(_packer(width), _PACKED)

    no_limits = F.expr("CAST(NULL AS ARRAY<BIGINT>)").alias("limits")
    row_blocks = staged(packed(lean.select("row", "id", "label", "x", no_limits), blocks), "row-blocks")

    def cells(anchors: DataFrame) -> DataFrame:
        """Every block of rows beside every block of anchors; a number of partitions, as the work is long and the rows few."""
        own = packed(anchors, anchor_blocks).drop("block")
        own = own.select(*(F.col(c).alias(f"a_{c}") for c in own.columns), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        return row_blocks.repartition(many, "block").join(own.repartition(many, "block"), "block")

    anchors = lean.where("is_anchor").select("row", "id", "label", "x")
    near = _read(cells(anchors.withColumn("limits", F.expr("CAST(NULL AS ARRAY<BIGINT>)"))), width, lambda *of: _nearest_alike(*of, most=positives))
    found = staged(_ranked(near, positives).select("anchor", F.col("rank").alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = found.groupBy("anchor").agg(F.expr("transform(array_sort(collect_list(struct(list, positive_score))), p -> p.positive_score)").alias("limits"))
    limited = anchors.join(limits.withColumnRenamed("anchor", "row"), "row")
    below = _ranked(_read(cells(limited), width, lambda *of: _below_limits(*of, most=negatives, percent=percent)), negatives)
    named = found.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return below.join(named, ["anchor", "list"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding against all rows, labels changed at every seventh id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: The same by windows over all pairs of an anchor and a row.
ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label = b.label AS alike, b.id AS id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5
"""
