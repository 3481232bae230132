"""Removal of word sequences that occur more than once, by prefix-partitioned suffix trees.

A suffix (of a text, from one of its words on) matters here only as far as `window` words, so trees are
cut at that depth: their internal nodes there, with two leaves or more, are the repeats; adjacent
repeats of one text join to maximal ones. A suffix whose first `window` words occur nowhere else is a
leaf that hangs higher up. A bitmap of fixed size, filled by an exact count in slices, keeps those back.

The other suffixes are dealt into groups by prefixes of variable length. A group has the first of the
LADDER numbers of words at which it holds 2**GROUP_LEVEL suffixes or fewer, by counts of all prefixes
of these lengths in a table of fixed size (a counter that several prefixes share only lengthens them);
beyond the ladder the prefix is the window. A suffix travels as its path, 24 bits of its prefix and 40
of its window, and each task builds the trees of its groups by sorting paths: neighbours that agree
in the prefix's bits branch off below the prefix, neighbours that agree in all have `window` words or
more in common and are leaves of one deep node. Leaves go back to their texts as bits.

A node needs two leaves. A task that meets a window for the third time ships it no more, as it knows
the answer, so a passage that a third of all texts share brings two leaves from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, checkpointed, free_prefix, grams, mix, quoted, shuffle_width, text_batches
from .shared_tokens import shared_tokens
from .sketch import bitmap_of, counted, counter_of, inside

#: Words of prefixes, one after the other, and log2 of the suffixes of a group before its prefix grows.
LADDER = (8, 16, 24, 32)
GROUP_LEVEL = 14
#: Suffixes, about, that a task gets.
SUFFIXES = 4_000_000
#: log2 of the windows that a task remembers.
MEMORY = 17
_U = np.uint64


def windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix of `window` words or more: its text, its first word in the block, the hash of its window."""
    at = np.arange(max(0, len(words.hashes) - window + 1))
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[: len(at)]
    inside = at + window <= words.first[text + 1]
    return text[inside], at[inside], grams(words.hashes, window)[inside]


def prefix_hashes(words: Words, at: np.ndarray, length: int) -> np.ndarray:
    return grams(words.hashes, length)[at] ^ _U(length) if len(at) else np.zeros(0, _U)


def row_hash(id_col: str, text_col: str) -> Column:
    """64 bits of a row's id and text together: rows that agree have, but for a collision of hashes, the same of both and the same result."""
    return F.xxhash64(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(-(2**63))), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))


class Seen:
    """How often a task met the windows that it met of late, in a table of fixed size."""

    def __init__(self):
        self.label, self.times = np.zeros(1 << MEMORY, _U), np.zeros(1 << MEMORY, np.uint8)

    def shipped(self, label: np.ndarray) -> np.ndarray:
        """Which of the windows must travel: the first two of each; the others are repeats."""
        order = np.argsort(label, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]])) if len(label) else order
        n = np.diff(np.append(new, len(label)))
        own = label[order][new]
        slot = (own >> _U(64 - MEMORY)).astype(np.int64)
        before = np.where(self.label[slot] == own, self.times[slot], 0)
        out = np.zeros(len(label), bool)
        out[order] = np.arange(len(label)) - np.repeat(new, n) < np.repeat(2 - np.minimum(2, before), n)
        self.label[slot], self.times[slot] = own, np.minimum(2, before + n)
        return out


def find_repeats(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(row, spans): for each row, by its row_hash, (block, mask) pairs; set bits are repeated windows that start at word 64 block + bit."""
    spark = docs.sparkSession
    text_batches(spark)
    keyed = docs.select(row_hash(id_col, text_col).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))
    ladder = [n for n in LADDER if n < window]

    def labels(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in blocks(batch.column(0)):
            yield windows(Words(data, offsets), window)[2]

    shared = spark.sparkContext.broadcast(shared_tokens(keyed.select("text"), labels))

    def repeating(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, at, label = windows(words, window)
        some = shared.value(label) > 0
        return text[some], at[some], label[some]

    def prefixes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in blocks(batch.column(0)):
            words = Words(data, offsets)
            at = repeating(words)[1]
            for n in ladder:
                yield prefix_hashes(words, at, n)

    counts = counted(keyed.select("text"), prefixes)
    suffixes = int(counts.sum(dtype=np.uint64)) // max(1, len(ladder))
    large = spark.sparkContext.broadcast(np.packbits(counts > 1 << GROUP_LEVEL))
    width = max(shuffle_width(spark), -(-suffixes // SUFFIXES))

    def path(words: Words, at: np.ndarray, label: np.ndarray) -> np.ndarray:
        prefix, open_ = label.copy(), np.ones(len(at), bool)
        for n in ladder:
            own = prefix_hashes(words, at, n)
            c = counter_of(own)
            prefix = np.where(open_, own, prefix)
            open_ &= (large.value[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        prefix = np.where(open_, label, prefix)  # no length of the ladder will do
        return (mix(prefix) & ~_U(2**40 - 1)) | (mix(label ^ prefix) & _U(2**40 - 1))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves, and the bits of windows known to be repeats; place is twice the block of 64 words, and odd where they are known."""
        seen = Seen()
        for batch in batches:
            row = batch.column(0).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets)
                text, at, label = repeating(words)
                start, go = at - words.first[text], seen.shipped(label)
                bits = _U(1) << (start & 63).astype(_U)
                # What is known already leaves as one row for each 64 words.
                known = np.flatnonzero(~go)
                key = (text[known] << 32) | (start[known] >> 6)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else known
                mask = np.bitwise_or.reduceat(bits[known], first) if len(first) else bits[:0]
                of = np.concatenate([np.flatnonzero(go), known[first]])
                block, own = start[of] >> 6, row[lo + text[of]]
                paths = np.zeros(len(of), _U)
                paths[: go.sum()] = path(words, at[go], label[go])
                paths[go.sum() :] = mix((own.view(_U) ^ block.astype(_U))[go.sum() :])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths.view(np.int64)), pa.array(own), pa.array(block << 1 | (np.arange(len(of)) >= go.sum())), pa.array(np.concatenate([bits[go], mask]).view(np.int64))],
                    ["path", "row", "place", "mask"],
                )

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves of deep nodes among the groups that this task holds; a partition is sized to fit its memory."""
        leaves: list[tuple[np.ndarray, ...]] = []
        names = ["row", "place", "mask"]
        for batch in batches:
            known = batch.column(2).to_numpy() & 1 == 1
            own = tuple(batch.column(k).to_numpy() for k in range(4))
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in own[1:]], names)
            if not known.all():
                leaves.append(tuple(c[~known] for c in own))
        if not leaves:
            return
        paths, *places = (np.concatenate(c) for c in zip(*leaves, strict=True))
        leaves.clear()
        order = np.argsort(paths)
        same = paths[order][1:] == paths[order][:-1]  # neighbours with the whole window in common
        deep = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        for i in range(0, len(deep), 100_000):
            some = deep[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in places], names)

    shipped = keyed.mapInArrow(ship, "path long, row long, place long, mask long")
    marked = shipped.repartition(width, F.shiftrightunsigned("path", 40)).mapInArrow(trees, "row long, place long, mask long")
    masks = marked.groupBy("row", F.shiftright("place", 1).alias("block")).agg(F.bit_or("mask").alias("mask"))
    return masks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("block", "mask"))).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text, n_words, n_removed and repeats (array of [first word, end word)).

    Words are runs of anything but ASCII white space. Every word is removed that lies in a window of
    `window` consecutive words which also starts anywhere else, the same text included. Kept words are
    joined by one space; a null text gives an empty one. Columns of those names are replaced, all
    others kept, whatever they are called. Rows that repeat an id and text are each judged as they
    are: repeats of one another. An empty table gives an empty result.
    """
    if window <= LADDER[0]:
        raise ValueError(f"window must be more than {LADDER[0]} words")
    made = ("kept_text", "n_words", "n_removed", "repeats")
    p = free_prefix(docs)
    row, text, spans = (p + x for x in ("row", "text", "spans"))
    found = checkpointed(find_repeats(docs, window, id_col, text_col)).withColumnsRenamed({"row": row, "spans": spans})
    others = [f for f in docs.schema.fields if f.name not in made]

    # Only rows that a bitmap of fixed size lets through move for the join; the others lose nothing.
    asked = docs.sparkSession.sparkContext.broadcast(bitmap_of(found.select(row), lambda batch: iter([batch.column(0).to_numpy().view(_U)])))

    def may_lose(rows: pa.Array) -> pa.Array:
        return pa.array(inside(asked.value, rows.to_numpy().view(_U)))

    may_lose.__annotations__ = {"rows": pa.Array, "return": pa.Array}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("repeats", pa.list_(pa.list_(pa.int64())))])
        for batch in batches:
            kept, own_spans = batch.num_columns - 2, batch.column(batch.num_columns - 1)
            for lo, hi, data, offsets in blocks(batch.column(kept)):
                words = Words(data, offsets)
                gone = np.zeros(len(words.hashes) + 1, np.int32)
                some = own_spans.slice(lo, hi - lo)
                n = np.where(np.asarray(some.is_null()), 0, some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = some.flatten()
                first = 64 * flat.field(0).to_numpy() + words.first[np.repeat(np.arange(hi - lo), n)]
                mask = flat.field(1).to_numpy()
                for k in range(64 if len(mask) else 0):
                    at = first[(mask >> k) & 1 == 1] + k
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                raw = data.tobytes()
                texts, removed, ranges = [], [], []
                for i in range(hi - lo):
                    f, e = int(words.first[i]), int(words.first[i + 1])
                    own = gone[f:e]
                    texts.append(b" ".join([raw[s:t] for s, t in zip(words.starts[f:e][~own].tolist(), words.ends[f:e][~own].tolist(), strict=True)]).decode())
                    removed.append(int(own.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    ranges.append(edge.reshape(-1, 2).tolist())
                new = [pa.array(texts, pa.string()), pa.array(np.diff(words.first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(ranges, schema.field("repeats").type)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(kept)] + new, [batch.schema.field(i).name for i in range(kept)] + schema.names)

    names = [f"{p}{i}" for i in range(len(others))]
    # Other columns go through Python under plain names, whatever they are called.
    plain = [F.col(quoted(f.name)).alias(f"{p}{i}") for i, f in enumerate(others)]
    rows = docs.select(*plain, row_hash(id_col, text_col).alias(row), F.col(quoted(text_col)).cast("string").alias(text))
    rows = rows.withColumn(p + "may", F.arrow_udf(may_lose, "boolean")(row))
    untouched = rows.where(~F.col(p + "may")).select(*names, text, F.lit(None).cast(found.schema[spans].dataType).alias(spans))
    touched = rows.where(p + "may").join(found, row, "left").select(*names, text, spans)
    fields = "".join(f"{p}{i} {f.dataType.simpleString()}, " for i, f in enumerate(others))
    out = untouched.unionByName(touched).mapInArrow(cut, f"{fields}kept_text string, n_words long, n_removed long, repeats array<array<long>>")
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, others, strict=True)], *made)
