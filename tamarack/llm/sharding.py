"""Byte-balanced sharding by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts are neighbours. Splitters of that order, one
less than there are shards, are found by probing: each round counts, over all partitions, the exact
bytes below every candidate boundary, keeps for each splitter the bracket that holds its target and puts
new probes into it, until the bytes below a candidate are within tolerance of the target. Where one
hash alone spans a target by more than that (a large group of equal texts), the probing goes on over
the ids within it; otherwise equal texts stay in one shard. Rows then move once: within a shard they
are dealt by a hash into parts of about PART_BYTES, whose first slots come from counts of rows. Only
the probes of the splitters and their counts are on the driver, a number that depends on the shards alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_prefix, quoted

#: New probes of each open splitter in a round.
PROBES = 32
#: Bytes of a part of a shard, about, which one task numbers after the exchange.
PART_BYTES = 64 << 20
_LOW, _HIGH = -(2**63), 2**63 - 1


def below(rows: DataFrame, col: str, probes: list[int]) -> np.ndarray:
    """Exact bytes of the rows whose col is less than each probe (ascending), and of all rows at the end."""
    cut = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cut) + 1, np.int64)
        for b in batches:
            np.add.at(total, np.searchsorted(cut, b.column(0).to_numpy(), "right"), b.column(1).to_numpy())
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], ["bucket", "bytes"])

    got = np.zeros(len(cut) + 1, np.int64)
    for bucket, size in rows.select(col, "size").mapInArrow(count, "bucket int, bytes long").groupBy("bucket").agg(F.sum("bytes")).collect():
        got[bucket] = size
    return np.cumsum(got)


def probe(rows: DataFrame, col: str, targets: list[float], tolerance: float) -> list[tuple[int, int | None]]:
    """For each target number of bytes, (boundary, None) within tolerance, or (value, bytes below it) of the one value that spans it."""
    brackets = {k: (_LOW, 0, _HIGH, None) for k in range(len(targets))}  # boundary, bytes below it; the same above
    found: dict[int, tuple[int, int | None]] = {}
    while len(found) < len(targets):
        probes: set[int] = set()
        for k, (lo, _, hi, _) in brackets.items():
            if k not in found:
                step = max(1, (hi - lo) // (PROBES + 1))
                probes |= set(range(lo + step, hi, step)) | {hi}
        own = sorted(probes)
        sums = below(rows, col, own)
        for k, target in enumerate(targets):
            if k in found:
                continue
            lo, lo_bytes, hi, hi_bytes = brackets[k]
            for p, s in zip(own, sums[:-1].tolist(), strict=True):
                if lo < p <= hi:
                    if s <= target:
                        lo, lo_bytes = p, s
                    else:
                        hi, hi_bytes = p, s
                        break
            near = min(((abs(b - target), at) for at, b in ((lo, lo_bytes), (hi, hi_bytes)) if b is not None))
            if near[0] <= tolerance:
                found[k] = (near[1], None)
            elif hi - lo <= 1 or lo == _HIGH:
                found[k] = (lo, lo_bytes)
            brackets[k] = (lo, lo_bytes, hi, hi_bytes)
    return [found[k] for k in range(len(targets))]


def splitters(rows: DataFrame, count: int, tolerance: float) -> list[tuple[int, int]]:
    """count - 1 boundaries (hash, id) of rows(hash, id, size): a row below one lies left of it."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return [(_HIGH, _HIGH)] * (count - 1)
    slack = tolerance * total / count
    targets = [k * total / count for k in range(1, count)]
    out: list[tuple[int, int]] = []
    spanned: dict[int, list[tuple[int, float]]] = {}
    for k, (at, base) in enumerate(probe(rows, "hash", targets, slack)):
        out.append((at, _LOW))
        if base is not None:
            spanned.setdefault(at, []).append((k, targets[k] - base))
    for at, own in spanned.items():
        for (k, _), (row, _) in zip(own, probe(rows.where(F.col("hash") == at), "id", [t for _, t in own], slack), strict=True):
            out[k] = (at, row)
    return sorted(out)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes of the text, null: none, plus 1), shard and slot.

    Sizes of shards differ by `tolerance` of a shard, or by single rows larger than that. Slots count
    from 0 in each shard without gaps. A null id sorts first; rows that agree in id and text may swap
    slots, and share a shard. An empty table gives an empty result. Columns of those names are
    replaced, all others kept, whatever they are called.
    """
    p = free_prefix(docs)
    text, row_id = F.col(quoted(text_col)), F.col(quoted(id_col))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    keyed = docs.withColumns({p + "hash": F.coalesce(F.xxhash64(text), F.lit(0)), p + "id": F.coalesce(row_id.cast("long"), F.lit(_LOW)), p + "size": size})
    narrow = checkpointed(keyed.select(*[F.col(p + c).alias(c) for c in ("hash", "id", "size")]))
    cuts = splitters(narrow, shards, tolerance)
    parts = max(1, -(-(narrow.agg(F.sum("size")).first()[0] or 0) // (shards * PART_BYTES)))

    def placed(rows: DataFrame, q: str) -> DataFrame:
        right = [(F.col(q + "hash") > h) | ((F.col(q + "hash") == h) & (F.col(q + "id") >= i)) for h, i in cuts]
        at = sum((c.cast("int") for c in right), F.lit(0))
        return rows.withColumns({q + "shard": at, q + "part": F.pmod(F.xxhash64(q + "hash", q + "id"), F.lit(parts))})

    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed(narrow, "").groupBy("shard", "part").agg(F.count("*").alias("rows"))
    base = counts.select(F.col("shard").alias(p + "shard"), F.col("part").alias(p + "part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(p + "base"))
    own = [p + "shard", p + "part"]
    row = F.row_number().over(Window.partitionBy(*own).orderBy(p + "hash", p + "id")) - 1
    out = placed(keyed, p).join(base.hint("shuffle_merge"), own).withColumn(p + "row", row)
    return out.select(
        *[F.col(quoted(c)) for c in docs.columns if c not in ("size", "shard", "slot")],
        F.col(p + "size").alias("size"),
        F.col(p + "shard").alias("shard"),
        (F.col(p + "base") + F.col(p + "row")).cast("long").alias("slot"),
    )
