"""Sorted runs of keys and their values, packed into rows for a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

PACKED = "level int, shard int, block long, keys binary, values binary"
PACKED_NAMES = ["level", "shard", "block", "keys", "values"]
PACKED_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, compressed: the planes of zeros cost nothing."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_keys(b: bytes) -> np.ndarray:
    planes = unsqueeze(b, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
