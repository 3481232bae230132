"""How a set of filters interact: what each removes in every order in which they can be applied.

A row's failures are a mask, a bit for each filter. What happens to a row of that mask in every order
and at every step is fixed, so each mask has one big integer with a field for each of the n! n step
outcomes (600 for five filters), 1 where the row is removed, and one more field that counts rows. Sums
of these integers hold all counts of a part at once: a task adds up its rows, sums of tasks are added
in two rounds, and fields are read at the end. A field has 64 bits, so none overflows into the next
before 2**64 rows. Two more integers for each part count only rows that are labelled good, or toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, shuffle_width

#: Bytes of a field; parts whose sums a task holds at once; log2 of the tasks whose sums are added first.
FIELD, PARTS, LANE_BITS = 8, 1024, 5
LETTERS = "ABCDE"
UPPER, SPACES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\t\n\x0b\x0c\r"
_SUMS = "part string, lane int, sums array<binary>"


def step_outcomes(letters: str) -> list[int]:
    """For each mask its big integer: field order * n + step is 1 if a row of that mask is removed there, the last field is always 1."""
    n, orders = len(letters), list(permutations(range(len(letters))))
    out = []
    for mask in range(1 << n):
        total = 1 << (8 * FIELD * len(orders) * n)
        for k, order in enumerate(orders):
            step = next((s for s, f in enumerate(order) if mask >> f & 1), None)
            if step is not None:
                total |= 1 << (8 * FIELD * (k * n + step))
        out.append(total)
    return out


def fields(total: int, count: int) -> np.ndarray:
    """The fields of a sum."""
    return np.frombuffer(total.to_bytes(FIELD * count, "little"), "<u8").astype(np.int64)


def failures(docs: DataFrame, id_col: str, text_col: str, part: Column) -> DataFrame:
    """(id, part, mask, sha, bytes): failures A to D of each row, and what tells its text from others.

    Words are maximal runs of anything but ASCII white space. A: under 200 words; B: fewer than half
    of the words are different ones; C: over 3 per cent of the code points are A to Z; D: the text
    holds one of #$%&*|. A null text is an empty one and fails A alone.
    """
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), part.alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), ""))
    words, chars = F.size("words"), F.char_length("text")
    fails = (words < 200, 100 * F.size(F.array_distinct("words")) < 50 * words, 100 * (chars - F.char_length(F.translate("text", UPPER, ""))) > 3 * chars, F.col("text").rlike("[#$%&*|]"))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.octet_length("text").alias("bytes"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows by failures A to E and labels; several rows may share all but n.

    E: the text is identical to that of a smaller id, anywhere in the table. Null parts count as the
    empty string. A row without an id has no smaller one, is no one's, and has no label; rows of one
    id do not fail E by one another. An id is good (quality = 1) or toxic (toxic = 1) if any of its
    labels says so.
    """
    part = F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit(""))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    # Copies are counted before anything else moves; then ids, which the counts are of, meet their labels.
    one = failures(docs, id_col, text_col, part).groupBy("id", "part", "mask", "sha", "bytes").agg(F.count("*").alias("n"))
    rows = one.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    has = F.col("id").isNotNull()
    same = rows.groupBy("sha", "bytes", "part", "mask", "good", "toxic").agg(F.min(F.when(has, F.struct("id", "n"))).alias("first"), F.sum("n").alias("n"), F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("no_id"))
    same = same.withColumn("least", F.min("first.id").over(Window.partitionBy("sha", "bytes")))  # a text has a row for each part and label at most
    stands = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    e = 1 << LETTERS.index("E")
    either = F.array(F.struct(F.col("mask"), stands.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - stands).alias("n")))
    return same.select("part", "good", "toxic", F.inline(either)).where("n > 0")


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, of counts (part, mask, n, good, toxic).

    Columns: part, filter_order, step (from 1), and long counts within the part: kept (after the
    step), removed (there), redundant (failing the step's filter, but removed earlier), unique_fails
    (failing that filter only), good_lost and toxic_lost (removed there), shapley (removed by the
    filter in all orders together). Bit k of a mask is a failure of filter letters[k]. Rows with a
    null part belong to the part ''. No rows give no parts.
    """
    width, n = shuffle_width(counts.sparkSession), len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    steps = len(orders) * n
    size = FIELD * (steps + 1)
    outcomes = step_outcomes(letters)

    def row_batch(parts: dict[str, list[int]], lane: int) -> pa.RecordBatch:
        raw = [[v.to_bytes(size, "little") for v in sums] for sums in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), pa.array([lane] * len(parts), pa.int32()), pa.array(raw, pa.list_(pa.binary()))], ["part", "lane", "sums"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held = TaskContext.get().partitionId() >> LANE_BITS, {}
        for batch in batches:
            part = pc.dictionary_encode(batch.column(0))
            names = part.dictionary.to_pylist()
            mask, number, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            key = (part.indices.to_numpy() * len(outcomes) + mask).astype(np.int64)
            for which, some in enumerate((slice(None), good, toxic)):
                own, back = np.unique(key[some], return_inverse=True)
                rows = np.zeros(len(own), np.int64)
                np.add.at(rows, back, number[some])
                for k, count in zip(own.tolist(), rows.tolist(), strict=True):
                    sums = held.setdefault(names[k // len(outcomes)], [0, 0, 0])
                    sums[which] += count * outcomes[k % len(outcomes)]
            if len(held) >= PARTS:
                yield row_batch(held, lane)
                held = {}
        if held:
            yield row_batch(held, lane)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int]]]:
        """The sums of each part, whose rows come one after the other."""
        name, sums = None, [0, 0, 0]
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != name:
                    if name is not None:
                        yield name, sums
                    name, sums = part, [0, 0, 0]
                sums = [s + int.from_bytes(r, "little") for s, r in zip(sums, raw, strict=True)]
        if name is not None:
            yield name, sums

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sums in added(batches):
            yield row_batch({part: sums}, 0)

    filters = np.array([[letters.index(c) for c in order] for order in orders])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sums in added(batches):
            every, good, toxic = (fields(s, steps + 1) for s in sums)
            removed, rows = every[:-1].reshape(-1, n), every[-1]
            kept = rows - np.cumsum(removed, axis=1)
            fails = np.array([removed[filters[:, 0] == f, 0][0] for f in range(n)])  # applied first, a filter removes all that fail it
            alone = np.array([removed[filters[:, -1] == f, -1][0] for f in range(n)])  # applied last, those that fail it only
            all_orders = np.array([removed[filters == f].sum() for f in range(n)])
            before = fails[filters] - removed
            cols = [kept, removed, before, alone[filters], good[:-1], toxic[:-1], all_orders[filters]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * steps), pa.array(np.repeat(orders, n).tolist()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))), *[pa.array(c.ravel().astype(np.int64)) for c in cols]],
                ["part", "filter_order", "step", *COUNTS],
            )

    rows = counts.select(F.coalesce("part", F.lit("")).alias("part"), F.col("mask").cast("int"), F.col("n").cast("long"), "good", "toxic")
    first = rows.mapInArrow(pack, _SUMS).repartition(width, "part", "lane").sortWithinPartitions("part").mapInArrow(add, _SUMS)
    return first.repartition(width, "part").sortWithinPartitions("part").mapInArrow(unpack, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
