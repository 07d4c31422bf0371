"""k-mer counts of a stream of reads, kept as a table of partial counts.

Each batch of the stream is counted by itself and written to a folder named by
its number, so a batch that is run again after a failure replaces its own
result.  Every so many batches the partial counts are summed up into one table
(`upto=N`); what the one before it covers is then deleted.  Nothing is kept in
memory between batches, neither on the driver nor as state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from helixmill.operators.kmers import check_k, count_kmers, reduce_counts

#: Batches between two summations.
EVERY = 20
_SCHEMA = "kmer string, n bigint"


def _complete(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Number -> folder of the complete results of a kind."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    folders = [f.getPath().getParent() for f in found]
    return {int(f.getName().partition("=")[2]): f.toString() for f in folders}


def _parts(spark: SparkSession, path: str, before: int | None = None) -> tuple[list[str], int]:
    """The folders that together hold all counts (of batches before `before`), and the last sum's number (-1: none)."""
    sums = {n: f for n, f in _complete(spark, path, "upto").items() if before is None or n < before}
    last = max(sums, default=-1)
    batches = [f for n, f in sorted(_complete(spark, path, "batch").items()) if n > last and (before is None or n < before)]
    return [*([sums[last]] if sums else []), *batches], last


def counted(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, n): the counts of all batches that are complete by now; empty before the first one."""
    folders, _ = _parts(spark, path)
    return reduce_counts(spark.read.schema(_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], _SCHEMA), "n")


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stream_counts(reads: DataFrame, k: int, path: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Add the k-mers of a streaming DataFrame of reads (seq) to the table at `path`, to be read by counted().

    Started again with the same checkpoint it goes on where it stopped, and
    gives what an undisturbed run would have given.
    """
    check_k(k)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        count_kmers(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % every == 0:
            folders, last = _parts(spark, path, before=number + 1)
            if last == number:
                return
            older = [f for kind in ("upto", "batch") for n, f in _complete(spark, path, kind).items() if n < last or n == last and kind == "batch"]
            reduce_counts(spark.read.schema(_SCHEMA).parquet(*folders), "n").write.mode("overwrite").parquet(f"{path}/upto={number}")
            for folder in older:
                _delete(spark, folder)

    return reads.select("seq").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
