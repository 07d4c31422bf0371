"""Sharding by jump consistent hashing, in DataFrame expressions only.

A key walks a pseudo-random chain of ever larger shard numbers and stays at the
last one below the shard count.  There is no ring table, and adding a shard
moves only the keys whose chain reaches exactly that shard.  The generator is
the published 64-bit linear congruence x -> 2862933555777941757 x + 1, computed
in 16- and 32-bit limbs because ANSI arithmetic does not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, staged, table

SHARDS = 16
_LOW, _HIGH = 2862933555777941757 & 0xFFFFFFFF, 2862933555777941757 >> 32
_FAST_STEPS = 96


def _step(s: str) -> str:
    """SQL for the chain's next state; s has h, l (halves of x), b (shard), j (next)."""
    m = "4294967295L"
    p1 = f"(shiftright({s}.l, 16) * {_LOW}L)"
    low = f"(({s}.l & 65535L) * {_LOW}L + shiftleft({p1} & 65535L, 16))"
    one = f"(({low} & {m}) + 1L)"
    cross = f"{s}.h * {_LOW & 65535}L + shiftleft(({s}.h * {_LOW >> 16}L) & 65535L, 16) + {s}.l * {_HIGH & 65535}L + shiftleft(({s}.l * {_HIGH >> 16}L) & 65535L, 16)"
    h = f"((shiftright({low}, 32) + shiftright({p1}, 16) + {cross} + shiftright({one}, 32)) & {m})"
    jump = f"CAST(floor(({s}.j + 1L) * (2147483648D / (shiftright({h}, 1) + 1L))) AS BIGINT)"
    return f"named_struct('h', {h}, 'l', {one} & {m}, 'b', {s}.j, 'j', {jump})"


def jump_state(key: str, shards: int) -> Column:
    """struct(b: the key's shard among `shards`, j: the next shard of its chain).

    The chain has about ln(shards) steps.  _FAST_STEPS of them are unrolled by
    aggregate(); a key that needs more goes on for as long as it takes.
    """
    start = f"named_struct('h', shiftrightunsigned({key}, 32), 'l', {key} & 4294967295L, 'b', -1L, 'j', 0L)"
    move = f"(s, i) -> IF(s.j < {shards}L, {_step('s')}, s)"
    fast = f"aggregate(sequence(1, {min(shards, _FAST_STEPS)}), {start}, {move})"
    if shards <= _FAST_STEPS:
        return F.expr(fast)
    return F.expr(f"aggregate(array({fast}), {start}, (a, f) -> IF(f.j >= {shards}L, f, aggregate(sequence(1, {shards}), f, {move})))")


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """df with `shard` and `grown_shard` (with one more shard), both int.

    Law `key`: the key and the shard count alone decide.  A null key counts as
    0; repeated keys share their shard; other columns pass through.  `shards`
    must be 1 or more.  Key: an integer column.  Columns named shard and
    grown_shard are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    number, chain = fresh(df, "__key", "__jump")
    own = F.col(chain)
    return (
        df.withColumn(number, F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint")))
        .withColumn(chain, jump_state(number, shards))
        .withColumns({"shard": own["b"].cast("int"), "grown_shard": F.when(own["j"] == shards, F.lit(shards)).otherwise(own["b"]).cast("int")})
        .drop(number, chain)
    )


def slots(df: DataFrame, group: str = "shard", order: str = "doc_id") -> DataFrame:
    """df with slot, numbered from 0 without gaps inside each value of `group`.

    Rows are numbered inside (group, input split) and each split starts where
    the splits before it end, so no task ever holds a group.  df is staged in
    the shared folder first: both passes must see the same splits.  Ties of
    `order` (repeated rows, nulls, which come first) take places of their own.
    A column `slot` is replaced; rows without a group are numbered like a group of their own.
    """
    part, start, place, own_group, own_part = fresh(df, "__part", "__start", "__place", "__of_group", "__of_part")
    lean = staged(df.withColumn(part, F.spark_partition_id()), "slots")
    within = Window.partitionBy(group, part).orderBy(order)
    before = Window.partitionBy(group).orderBy(part)
    starts = lean.groupBy(group, part).agg(F.count("*").alias(place)).select(group, part, (F.sum(place).over(before) - F.col(place)).alias(start))
    # Null groups join, too.
    starts = starts.toDF(own_group, own_part, start)
    rows = lean.withColumn(place, F.row_number().over(within) - 1).join(starts, F.col(group).eqNullSafe(F.col(own_group)) & (F.col(part) == F.col(own_part)))
    return rows.select(*(c for c in df.columns if c != "slot"), (F.col(start) + F.col(place)).cast("bigint").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, law `key`.  Null text: size 1, CRC of nothing.

    See shard() for null ids and slots() for ties and repeated rows.
    """
    docs = table(spark, sf_dir, "documents")
    lean = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return slots(shard(lean)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
