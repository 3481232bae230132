"""Arrow batches inside tasks: whole groups of sorted rows, and list columns as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows at which the first `keys` columns change, and the number of rows."""
    n = batch.num_rows
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for k in range(keys):
        c = batch.column(k)
        new[1:n] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by their first `keys` columns (none null), a group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield pa.concat_batches(held)
            held = []
        cuts = starts(batch, keys)
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.concat_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.concat_batches(held)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each list begins, with the end; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def listed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list column over one flat array."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def summed_vectors(rows: DataFrame, key: str, scale: Column, vector: str, width: int) -> DataFrame:
    """(key, vector): for each key the sum of scale times vector, which has `width` components; keys are not null.

    Tasks add up what a batch holds of a key before it moves, so a key with very many rows sends one row
    for each batch; the rest is added as rows stream in by key.
    """
    kind = rows.schema[key].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"{key} {kind}, {vector} array<double>"

    def out(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, listed(sums.ravel(), np.arange(len(sums) + 1) * width)], [key, vector])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.dictionary_encode(batch.column(0))
            code = own.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            x = flat(batch.column(2))[0].astype(np.float64).reshape(batch.num_rows, width) * batch.column(1).to_numpy()[:, None]
            first = np.searchsorted(code[order], np.arange(len(own.dictionary)))
            yield out(own.dictionary, np.add.reduceat(x[order], first, axis=0) if len(first) else x)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Array, np.ndarray] | None = None  # the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = starts(batch, 1)
            keys = batch.column(0).take(pa.array(cuts[:-1]))
            sums = np.add.reduceat(flat(batch.column(1))[0].reshape(batch.num_rows, width), cuts[:-1], axis=0)
            if held is not None:
                if held[0][0] == keys[0]:
                    sums[0] += held[1][0]
                else:
                    yield out(*held)
            if len(keys) > 1:
                yield out(keys.slice(0, len(keys) - 1), sums[:-1])
            held = keys.slice(len(keys) - 1), sums[-1:]
        if held is not None:
            yield out(*held)

    some = rows.select(key, scale.cast("double").alias("scale"), F.col(vector).cast("array<double>").alias(vector))
    return some.mapInArrow(partial, schema).repartition(parts, key).sortWithinPartitions(key).mapInArrow(total, schema)
