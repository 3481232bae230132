"""Which tokens occur in more than one set, told by a bitmap of fixed size.

Tokens (64-bit hashes) are dealt by hash to slices, as sorted and delta-coded runs of 32-bit values;
each slice is counted by one task and gives its part of the bitmap, and of a smaller table of how
frequent tokens are. A token that occurs twice is never missed. Others pass with the share of bits
that are set, so the bitmap only saves work.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, shuffle_width

#: log2 of the bits of the bitmap and of the entries of the frequency table; tokens that a task holds before it sends them.
BITS, LEVELS, HELD = 27, 22, 1_000_000
_U = np.uint64


def spread(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ _U(0x5851F42D4C957F2D))


class Shared:
    """The bitmap and the frequency table."""

    def __init__(self, bitmap: np.ndarray, levels: np.ndarray):
        self.bitmap, self.levels = bitmap, levels

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """Level of each token: 0 if no other set has it, else 1 or more, growing with its frequency."""
        at = spread(tokens)
        bit = (at >> _U(64 - BITS)).astype(np.int64)
        found = (self.bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
        return found * (1 + self.levels[(at >> _U(64 - LEVELS)).astype(np.int64)])


def shared_tokens(rows: DataFrame, tokens_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Shared:
    """Shared of the tokens that tokens_of gives for rows: the elements of their sets, each once for a set."""
    log = max(4, min(16, (shuffle_width(rows.sparkSession) - 1).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                at = np.sort(np.concatenate(held))
                held.clear()
                cuts = np.searchsorted(at, np.arange(1, 1 << log, dtype=_U) << _U(64 - log))
                for k, part in enumerate(np.split(at, cuts)):
                    if len(part):
                        value = ((part << _U(log)) >> _U(32)).astype(np.uint32)
                        raw = np.diff(value, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()  # high bytes together: mostly zeros
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["slice", "run"])

        size = 0
        for batch in batches:
            for tokens in tokens_of(batch):
                held.append(spread(tokens))
                size += len(tokens)
                if size >= HELD:
                    yield from send()
                    size = 0
        yield from send()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                runs.setdefault(k, []).append(np.cumsum(own, dtype=np.uint32))
        for k, own in runs.items():
            value, n = np.unique(np.concatenate(own), return_counts=True)
            value, n = value[n > 1].astype(np.int64), n[n > 1]
            bits = np.zeros(1 << (BITS - log), bool)
            bits[value >> (32 - BITS + log)] = True
            levels = np.zeros(1 << (LEVELS - log), np.uint8)
            often = n >= 4
            np.maximum.at(levels, value[often] >> (32 - LEVELS + log), np.ceil(2 * np.log2(n[often])).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary()), pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())], ["slice", "bits", "levels"])

    bitmap, levels = np.zeros(1 << (BITS - 3), np.uint8), np.zeros(1 << LEVELS, np.uint8)
    parts = rows.mapInArrow(deal, "slice int, run binary").repartition(1 << log, "slice").mapInArrow(count, "slice int, bits binary, levels binary")
    for k, bits, own in parts.toLocalIterator():  # the tables: of fixed size
        n, m = len(bitmap) >> log, len(levels) >> log
        bitmap[k * n : (k + 1) * n] = np.frombuffer(zlib.decompress(bits), np.uint8)
        levels[k * m : (k + 1) * m] = np.frombuffer(zlib.decompress(own), np.uint8)
    return Shared(bitmap, levels)
