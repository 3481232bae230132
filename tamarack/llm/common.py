"""What the text operators share: row keys, checkpoints, and word hashes over whole Arrow batches.

Every helper works on Arrow batches inside Spark tasks; nothing here gathers rows on the driver.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into word hashes at a time, unless one text alone is longer.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_BYTE = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB53)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, which all executors share, and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names in spark.checkpoint.dir; only a local session may get one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches hold `rows` whole texts at most, unless the session already asks for fewer: they bound a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has, whatever the case of its letters: working columns named with it clash with none."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_key(id_col: str, text_col: str, a: str = "a", b: str = "b") -> list[Column]:
    """Two columns, named a and b, never null, that tell rows apart: the id, and a hash of the text.

    Rows that agree in both have the same text and get the same result, so repeated rows are safe.
    """
    return [
        F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(-(2**63))).alias(a),
        F.coalesce(F.xxhash64(F.col(quoted(text_col))), F.lit(0)).alias(b),
    ]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- numpy over Arrow ----------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd base and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            a = np.full(size, base, _U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = (out[0], out[1])
        if size <= 2 * BLOCK_BYTES:
            _POWERS[which] = have
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[s:e] for each s, e: a polynomial in the base, by differences of its running sum."""
    power, inverse = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix(((total[ends] - total[starts]) * inverse[starts]) ^ mix((ends - starts).astype(_U)))


class Words:
    """Words of a block of texts: hash, first and last byte (exclusive), and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, breaks: np.ndarray | None = None):
        n = len(data)
        space = (data == 0x20) | ((data - np.uint8(9)) < 5)
        edge = np.zeros(n + 1, bool)
        np.not_equal(space[1:], space[:-1], out=edge[1:n])
        edge[offsets] = True
        edge[[0, n]] = True
        if breaks is not None:
            edge[breaks] = True
        solid = ~space
        self.starts = np.flatnonzero(edge[:n] & solid)
        self.ends = np.flatnonzero(edge[1:] & solid) + 1
        self.hashes = range_hashes((_FOLDED if fold else _BYTE)[data], self.starts, self.ends, 0)
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the end of the last


def blocks(array: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null counts as the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    n = len(array)
    if not n:
        return
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, raw = array.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; those that start at the last k - 1 are left out."""
    at = np.arange(max(0, len(words) - k + 1))
    return range_hashes(words, at, at + k, 1)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column over one flat array."""
    flat = pa.array(values if values.dtype != np.uint64 else values.view(np.int64), kind or pa.int64())
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), flat)


def list_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column without nulls, and offsets into them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    offsets = array.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = array.values.to_numpy(zero_copy_only=False)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]
