"""Embedding columns: which rows are usable, whole-number components, numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds no null, NaN or infinite component; an empty vector stays."""
    return rows.where(f"`{vector}` IS NOT NULL AND NOT exists(`{vector}`, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")


def whole(vector: str, scale: int, shift: int = 0) -> Column:
    """array<bigint> of floor(scale * c) + shift for each component c, taken as double."""
    return F.expr(f"transform(`{vector}`, c -> floor({scale} * CAST(c AS DOUBLE)) + {shift}L)")


def padded(vector: str, width: int, value: int = 0) -> Column:
    """The array with `value` behind its end up to `width` components."""
    return F.expr(f"concat(`{vector}`, array_repeat({value}L, {width} - size(`{vector}`)))")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """An int64 matrix of a list<int64> column without nulls; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets)
    values = np.asarray(column.values)[ends[0] : ends[-1]] if len(ends) else np.zeros(0, dtype=np.int64)
    if len(values) == len(column) * width:
        return values.reshape(len(column), width)
    out, sizes = np.zeros((len(column), width), dtype=np.int64), np.diff(ends)
    out[np.arange(width) < sizes[:, None]] = values
    return out
