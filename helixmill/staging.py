"""Cutting lineage: results that several steps read are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master; on a cluster
    an unset folder is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="helixmill-")
    return _LOCAL[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: a lost executor costs no more than reading it again."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()
