"""Make the package importable in Python workers wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers, once for each application.

    Nothing is sent where the workers' PYTHONPATH has them anyway.  Rows go to
    Python in smaller batches than by default, as whole texts are long.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="helixmill-"), "helixmill.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(os.path.join(_ROOT, "helixmill")):
            for name in names:
                if name.endswith(".py"):
                    out.write(full := os.path.join(top, name), os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
    return spark
