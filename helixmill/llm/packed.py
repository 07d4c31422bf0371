"""Arrays of 64-bit numbers as small byte strings, for rows that carry many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack_numbers(values: np.ndarray, ascending: bool) -> bytes:
    """Differences where the numbers ascend, then byte by byte, compressed; the count comes first."""
    v = np.ascontiguousarray(values).astype(np.uint64)
    if ascending:
        v = np.diff(v, prepend=np.uint64(0))
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(v).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack_numbers(data: bytes, ascending: bool) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), dtype=np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if ascending else v
