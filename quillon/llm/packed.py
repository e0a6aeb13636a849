"""Arrays of numbers as compressed bytes, for sending many in one row."""

from __future__ import annotations

import numpy as np
import zstandard


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, so that zeros and small ranges compress."""
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Of an ascending array of uint64."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def loosen_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(loosen(data, "<u8"), dtype=np.uint64)
