"""A table of counters of fixed size, filled by all tasks and added up by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix

#: Counters (a power of two) and the rows that they travel in.
COUNTERS, SLICES = 1 << 24, 32


def counter_of(values: np.ndarray) -> np.ndarray:
    return (mix(values + np.uint64(1)) & np.uint64(COUNTERS - 1)).astype(np.int32)


def counted(rows: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator], largest: bool = False) -> np.ndarray:
    """How often each counter was hit by the values that values_of gives for rows; its size does not grow with rows.

    With `largest`, values_of gives (values, numbers below 65536), and a counter holds the largest number it was hit with.
    """
    schema = "slice int, counts binary"

    def batch_of(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, part in sums.items():
            some = np.flatnonzero(part).astype(np.int32)
            if 8 * len(some) < part.nbytes // 2:  # few: their places and counts
                raw = b"\0" + some.tobytes() + part[some].astype(np.uint32).tobytes()
            else:
                own = part.astype(np.uint16 if part.max() < 65536 else np.uint32)
                raw = bytes([own.itemsize]) + zlib.compress(own.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["slice", "counts"])

    def read(raw: bytes) -> np.ndarray:
        if raw[0]:
            return np.frombuffer(zlib.decompress(raw[1:]), np.uint16 if raw[0] == 2 else np.uint32).astype(np.uint32)
        n = (len(raw) - 1) // 8
        part = np.zeros(COUNTERS // SLICES, np.uint32)
        part[np.frombuffer(raw, np.int32, n, 1)] = np.frombuffer(raw, np.uint32, n, 1 + 4 * n)
        return part

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTERS, np.uint16)  # a task counts to 65535
        for batch in batches:
            for values in values_of(batch):
                if largest:
                    np.maximum.at(own, counter_of(values[0]), values[1].astype(np.uint16))
                    continue
                at = np.sort(counter_of(values))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                n = np.diff(np.append(first, len(at)))
                own[at[first]] += np.minimum(n, 65535 - own[at[first]].astype(np.int64)).astype(np.uint16)
        yield from batch_of({k: part for k, part in enumerate(np.split(own, SLICES)) if part.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = read(raw)
                if k in sums:
                    sums[k] = np.maximum(sums[k], part) if largest else np.minimum(sums[k].astype(np.uint64) + part, 2**31).astype(np.uint32)
                else:
                    sums[k] = part
        yield from batch_of(sums)

    total, width = np.zeros(COUNTERS, np.uint32), COUNTERS // SLICES
    for k, raw in rows.mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect():
        total[k * width : (k + 1) * width] += read(raw)  # one row for each slice
    return total


def bitmap_of(rows: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator]) -> np.ndarray:
    """The counters that were hit, a bit for each."""
    return np.packbits(counted(rows, values_of) > 0)


def inside(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    c = counter_of(values)
    return (bitmap[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
