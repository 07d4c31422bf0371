"""PCA whitening of whole-number vectors by a randomised range finder.

A pass over all rows multiplies the covariance, never formed, with a thin
basis: each task centres its rows and adds up its share, and Spark sums the
shares entry by entry.  The product serves twice: for the Rayleigh-Ritz step on
the basis it was made with, and, orthonormalised, as the next basis.  If the
wanted components are not exact after the power passes, which is so where the
spectrum falls slowly, the basis grows to the full dimension and one more pass
decides.  On the driver there are width x width numbers at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, staged, table
from .vectors import finite, matrix, padded, whole

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns of the basis beyond the components, and products with the covariance before it grows.
OVERSAMPLING, POWER_PASSES = 16, 5
#: |V w - e w| of each component, as a share of its eigenvalue e.
TOLERANCE = 1e-12
_SEED = 12


@dataclass
class Whitening:
    """Fitted components: column c of `vectors` has the variance values[c]; all of one sign for all rows."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    grown: bool
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def _times(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact; in Python's integers where 64 bits might not do."""
    most = int(np.abs(x).max(initial=0)) * n + max((abs(int(s)) for s in sums), default=0)
    return x * n - sums if most < 2**63 else x.astype(object) * n - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_times(x, n, sums) / n).astype(np.float64)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    d = _times(x, n, sums)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) >= 2**63:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def _summed(rows: DataFrame, width: int, size: int, share: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of share(matrix of x) over all rows: `size` numbers, summed by Spark entry by entry."""
    number = np.int64 if kind == "bigint" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(size, dtype=number), False
        for batch in batches:
            if batch.num_rows:
                total, any_ = total + share(matrix(batch.column(0), width)), True
        if any_:
            yield pa.RecordBatch.from_pydict({"entry": pa.array(np.arange(size, dtype=np.int32)), "value": pa.array(total)})

    out = np.zeros(size, dtype=number)
    for entry, value in rows.select("x").mapInArrow(run, f"entry int, value {kind}").groupBy("entry").agg(F.sum("value")).collect():
        out[entry] = value
    return out


def whole_vectors(rows: DataFrame, vector: str, name: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Usable rows with `name`, array<bigint>: floor(scale * c) + shift for each component c."""
    return finite(rows, vector).withColumn(name, whole(vector, scale, shift))


def fit(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = POWER_PASSES, shift: int = SHIFT, tolerance: float = TOLERANCE) -> Whitening:
    """Components of the different vectors in the column x (array<bigint>), each counted once.

    A shorter vector counts as if zeros followed (x = shift).  There are fewer
    components than asked for where the vectors have fewer dimensions or span
    fewer: variances within rounding of 0 give none, so neither does an empty
    table or a single vector.
    """
    ends = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).head()
    width = ends[0] or 0
    if ends[0] != ends[1]:
        rows = rows.withColumn("x", padded("x", width, shift))
    listed = staged(rows.select("x").distinct(), "fit-list")
    n = listed.count()
    sums = _summed(listed, width, width, lambda x: x.sum(axis=0), "bigint")
    if n < 2 or not width:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, False)

    def product(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """(V basis, trace of V)"""

        def share(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.append((c.T @ (c @ basis)).ravel(), (c * c).sum())

        out = _summed(listed, width, width * basis.shape[1] + 1, share, "double") / n
        return out[:-1].reshape(width, -1), float(out[-1])

    basis = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((width, min(width, components + oversampling))))[0]
    grown, before = False, np.inf
    for turn in range(passes + 1):
        image, trace = product(basis)
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:components]
        values, vectors = values[best], basis @ turned[:, best]
        left = np.linalg.norm(image @ turned[:, best] - vectors * values, axis=0)
        if (left <= tolerance * values).all() or basis.shape[1] == width:
            break
        error, more = float((left / np.maximum(values, np.finfo(float).tiny)).max()), passes - 1 - turn
        # The residuals fail if the passes that are left, each as good as the last one, won't do.
        grown = more <= 0 or turn > 0 and error * min(1.0, error / before) ** more > tolerance
        basis, before = np.eye(width) if grown else np.linalg.qr(image)[0], error
    there = values > width * np.finfo(float).eps * max(values[0], 0)
    model = Whitening(n, sums, vectors[:, there], values[there], trace, grown)
    k = len(model.values)
    if k:

        def spread(x: np.ndarray) -> np.ndarray:
            w = model.scores(x)
            return (w.T @ w).ravel()

        model.identity_error = float(np.abs(_summed(listed, width, k * k, spread, "double").reshape(k, k) / n - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitening, x: str = "x", shift: int = SHIFT, whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """rows with whitened (array<double>, a number a component) and deviation (bigint) in place of x.

    deviation is the sum of (n * x - sums)^2, exact; one beyond 64 bits is an
    error.  Each row counts, repeated or not; columns of these names are
    replaced, others pass through.
    """
    kept = [c for c in rows.columns if c.lower() not in (x.lower(), whitened.lower(), deviation.lower())]
    vector = fresh(rows, "__x")[0]
    lean = rows.withColumn(vector, padded(x, model.width, shift)).select(*kept, vector)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema if f.name != vector), f"`{whitened}` array<double>", f"`{deviation}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(len(kept)), model.width)
            scores = model.scores(v)
            ends = np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32) if scores.shape[1] else np.zeros(len(v) + 1, dtype=np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found, pa.array(_deviation(v, model.n, model.sums), pa.int64())], names=[*kept, whitened, deviation])

    return lean.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened numbers of every usable embedding, a row a component; see fit() and whiten()."""
    rows = whole_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "x").select("vec_id", "x")
    model = fit(rows)
    found = whiten(rows, model).select(F.col("vec_id").cast("bigint").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(v) for v in model.explained)) if len(model.values) else F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
