"""A filter of fixed size for keys of a table: no key is missed, few others pass while it isn't full."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import mix64

#: Four megabytes, whatever the table; with more keys than ROOM it would let too much pass and isn't used.
BITS, SLICES = 1 << 25, 16
ROOM = BITS // 8


def _places(keys: np.ndarray, salt: int) -> np.ndarray:
    h = mix64(keys.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate((h >> np.uint64(39), (h << np.uint64(25)) >> np.uint64(39))).astype(np.int64)


def _whole(keys: list | pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Keys as integers; null is a key like others."""
    column = keys if isinstance(keys, (pa.Array, pa.ChunkedArray)) else pa.array(keys, pa.int64())
    return np.asarray(column.fill_null(-(2**63)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.fill_null(-(2**63)).to_numpy()).astype(np.int64)


def build(keys: DataFrame) -> np.ndarray:
    """The filter of keys(key long, salt int); parts of it are joined where they are, one filter reaches the driver."""
    schema = "slice int, part int, bits binary"
    width = BITS // 8 // SLICES

    def mark(rows):
        from pyspark import TaskContext

        flags = np.zeros(BITS, bool)
        for batch in rows:
            values, salts = _whole(batch.column("key")), batch.column("salt").to_numpy()
            for salt in np.unique(salts):
                flags[_places(values[salts == salt], int(salt))] = True
        if flags.any():
            part = TaskContext.get().partitionId()
            cut = np.packbits(flags, bitorder="little").reshape(SLICES, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in cut])], names=["slice", "part", "bits"])

    def join(key, t):
        total = np.zeros(width, np.uint8)
        for x in t["bits"].to_pylist():
            total |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"slice": t["slice"].slice(0, 1), "part": pa.array([0], pa.int32()), "bits": pa.array([zlib.compress(total.tobytes(), 1)])})

    near = keys.mapInArrow(mark, schema).groupBy("slice", F.floor(F.col("part") / 64).alias("some")).applyInArrow(lambda key, t: join(key, t), schema)
    out = np.zeros((SLICES, width), np.uint8)
    for row in near.groupBy("slice").applyInArrow(join, schema).toLocalIterator():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out.reshape(-1)


def holds(bits: np.ndarray, keys, salt: int) -> np.ndarray:
    """Whether each key may be one of the table's."""
    at = _places(_whole(keys), salt)
    hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    n = len(at) // 2
    return (hit[:n] & hit[n:]).astype(bool)
