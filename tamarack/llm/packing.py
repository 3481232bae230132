"""Packing of token pieces into sequences by a configuration linear program over the histogram of lengths.

Full pieces have sequences of their own. The lengths of the others are grouped into CLASSES classes of
about as many pieces each; a class counts as long as its mean. A configuration is a multiset of
classes that fits one sequence. The covering program, least sum of x_c such that the configurations
hold each class's pieces, is solved fractionally by multiplicative weights: a class weighs the less the
more of it is covered, a small step of the configuration of greatest weight is added to x, and the
weights of what it covers shrink. Configurations are priced by an unbounded knapsack over the capacity
(dynamic programming), every PRICED steps; in between, the best of those already priced is taken.
Each pricing also bounds the program from below by duality.

Then x is rounded down. The slots of a configuration take pieces of their classes, the last two a
pair that fills the room exactly where there is one, else the longest pieces that fit. What rounding leaves over is put by best fit,
longest first, into the rooms of those sequences, or new ones. Where that needs over WORSE more
sequences than plain best fit of the whole histogram (few pieces, where rounding costs most), the plan
of the latter is kept.

Only the histogram (one number for each length up to the capacity) and the plan made from it are on
the driver: both are bounded by the capacity and the constants below, whatever the number of rows. Rows
then get their places by joins: a piece's rank among those of its length picks its slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, checkpointed, free_prefix, quoted, shuffle_width, text_batches

#: Classes of lengths in the program, and the tokens that its knapsack counts as one.
CLASSES, UNIT = 40, 8
#: How fast weights shrink with coverage, and the largest share of a class that a step covers.
RATE, STEP = 400.0, 0.001
#: Share of a sequence that a filled configuration leaves free at most.
SLACK = 1 / 512
#: Share of the solution that is rounded down; the rest stays for best fit, which needs short pieces to fill rooms with.
PART = 0.97
#: By how much the program's plan may exceed plain best fit.
WORSE = 1 / 1000
#: Steps between two knapsacks, and steps at most.
PRICED, STEPS = 60, 30_000
#: Words that each of the two dictionaries of a Python worker holds, and their bytes with those of their ids, about.
CACHE_ENTRIES, CACHE_BYTES = 150_000, 16 << 20
#: Bytes of texts that are tokenized together, unless one text alone is longer.
BLOCK_BYTES = 4 << 20


#: Words of letters that the tokenizer takes as one pre-token each, perhaps with a run of marks after them.
_PLAIN = "^(?P<word>[a-z\u00df-\u00f6\u00f8-\u00ff]+)(?P<marks>[.,!?;:#$%&*]*)$"
#: How byte-level tokenizers write those bytes of such letters that Latin-1 has no visible character for.
_BYTES = {b: 0xA2 + b for b in range(0x80, 0xA1)} | {0xAD: 0x143}


class WordIds:
    """Ids of texts by a `tokenizers` file whose pieces never cross white space.

    The different parts between ASCII white space of a block of texts are taken once each. Most are plain words, with
    marks perhaps: for those the model is asked alone, and ids are kept in two dictionaries. When one is full it becomes the
    older one and a new one is begun, to which words that come again move: so what is frequent stays.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_entries, self.held = cache_entries, 0

    def plain(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)]) if word else b""

    def learned(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, or of runs of marks, as little-endian unsigned 32-bit numbers."""
        if len(self.recent) > self.cache_entries or self.held > CACHE_BYTES:
            self.recent, self.older, self.held = {}, self.recent, 0
        recent, older = self.recent, self.older
        for w in words:
            if w not in recent:
                ids = older.get(w)
                recent[w] = ids = self.plain(w) if ids is None else ids
                self.held += len(w) + len(ids)
        return [recent[w] for w in words]

    def ids_of(self, parts: pa.Array) -> pa.Array:
        """Ids of different parts without white space."""
        cut = pc.extract_regex(pc.ascii_lower(parts), _PLAIN)
        sides = [cut.field(k).dictionary_encode() for k in (0, 1)]
        made = [pa.array(self.learned([x or "" for x in s.dictionary.to_numpy(zero_copy_only=False).tolist()]), pa.binary()).take(s.indices) for s in sides]
        other = cut.is_null()
        rest = self.tokenizer.encode_batch_fast(parts.filter(other).to_numpy(zero_copy_only=False).tolist(), add_special_tokens=False)
        ids = pc.binary_join_element_wise(*made, b"")
        return pc.replace_with_mask(ids, other, pa.array([np.array(e.ids, "<u4").tobytes() for e in rest], pa.binary()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets into them; null counts as empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        parts = words.flatten().dictionary_encode()
        ids = self.ids_of(parts.dictionary).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 4
        data = ids.buffers()[2]
        flat = np.frombuffer(data, "<u4", ends[-1]) if ends[-1] else np.zeros(0, "<u4")
        return flat, ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])].astype(np.int64)


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32 bits) of each text.

    A text's ids end with end_id, so a null or empty text has one. Only texts of more than
    `capacity` ids are cut, into pieces of that many, the last shorter. Repeated rows each give
    their pieces; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer_path)
        for batch in batches:
            for lo, hi, *_ in blocks(batch.column(1), BLOCK_BYTES):
                flat, ends = own.encode(batch.column(1).slice(lo, hi - lo))
                flat = np.insert(flat, ends[1:], end_id).astype("<u4", copy=False)
                ends += np.arange(len(ends))
                many = -(-np.diff(ends) // capacity)
                of = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(ends)[of] - start)
                cuts = np.append((ends[of] + start) * 4, len(flat) * 4).astype(np.int32)
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    text_batches(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest weight, as a number for each length: an unbounded knapsack over the capacity. lengths ascend."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        gain = best[c - lengths[:k]] + weights[:k]
        j = int(gain.argmax())
        if gain[j] > best[c - 1]:
            best[c], took[c] = gain[j], j
        else:
            best[c] = best[c - 1]
    out = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        out[took[c]] += 1
        c -= int(lengths[took[c]])
    return out


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, steps: int = STEPS) -> tuple[dict[tuple[int, ...], float], float]:
    """({configuration: amount}, lower bound of the program): multiplicative weights. lengths ascend.

    The amounts cover all demand. The bound, by duality, holds for every fractional solution.
    """
    covered = np.zeros(len(lengths))
    columns: list[np.ndarray] = []
    amounts: list[float] = []
    known: dict[tuple[int, ...], int] = {}
    shares, bound = np.zeros((0, len(lengths))), float(lengths @ demand) / capacity
    for t in range(steps):
        w = np.exp(-RATE * (covered - covered.min()))
        if t % PRICED == 0:
            y = w / demand
            config = price(y, lengths, capacity)
            bound = max(bound, float(w.sum() / (config * y).sum()))
            if tuple(config.tolist()) not in known:
                known[tuple(config.tolist())] = len(columns)
                columns.append(config)
                amounts.append(0.0)
                shares = np.vstack([shares, config / demand])
        c = int((shares @ w).argmax())
        amount = STEP / float(shares[c].max())
        covered += amount * shares[c]
        amounts[c] += amount
        if covered.min() >= 1:
            break
    least = covered.min()
    if least <= 0:  # steps ran out before every class was met
        return {}, bound
    return {tuple(k.tolist()): v / least for k, v in zip(columns, amounts, strict=True) if v}, bound


def classes_of(histogram: dict[int, int], classes: int) -> list[list[tuple[int, int]]]:
    """The lengths, ascending, as classes of (length, pieces), each of about as many pieces."""
    share = sum(histogram.values()) / classes
    out: list[list[tuple[int, int]]] = []
    held = 0
    for n, k in sorted(histogram.items()):
        if not out or held + k / 2 > share * len(out):
            out.append([])
        out[-1].append((n, k))
        held += k
    return out


def program(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> tuple[list[list[tuple[int, int]]], dict[tuple[int, ...], float], float]:
    """(classes, fractional solution, its lower bound) of the covering program of a histogram."""
    groups = classes_of(histogram, CLASSES)
    demand = np.array([float(sum(k for _, k in g)) for g in groups])
    means = np.array([sum(n * k for n, k in g) for g in groups]) / demand
    unit = UNIT if capacity >= 64 * UNIT else 1
    return groups, *fractional(np.maximum(1, np.rint(means / unit)).astype(int), demand, capacity // unit, steps)


def configurations(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """(lengths with their numbers, number of sequences that hold them), which together hold the whole histogram."""
    left = {int(n): int(k) for n, k in histogram.items() if k > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    out: list[tuple[dict[int, int], int]] = []
    if full := left.pop(capacity, 0):
        out.append(({capacity: 1}, full))
    if not left:
        return out
    plain = best_fit_decreasing(dict(left), capacity)
    started = rounded(left, capacity, steps)
    solved = best_fit_decreasing(left, capacity, started)
    used = lambda plan: sum(times for _, times in plan)
    return out + (solved if used(solved) <= (1 + WORSE) * used(plain) else plain)


def rounded(left: dict[int, int], capacity: int, steps: int) -> list[tuple[dict[int, int], int]]:
    """The program's solution rounded down and filled with pieces, which are taken out of `left`."""
    groups, x, _ = program(left, capacity, steps)
    of = {n: i for i, g in enumerate(groups) for n, _ in g}
    open_ = np.zeros(capacity + 1, bool)  # lengths of which pieces are left
    open_[list(left)] = True
    spans = [(g[0][0], g[-1][0]) for g in groups]
    out: list[tuple[dict[int, int], int]] = []

    def longest(least: int, most: int) -> int:
        """The longest length left between the two, or 0."""
        found = np.flatnonzero(open_[least : most + 1]) if most >= least else ()
        return least + int(found[-1]) if len(found) else 0

    def pair(span: tuple[int, int], room: int) -> tuple[int, ...]:
        """A length left of the class whose complement to the room is left too, with that; else the longest that fits."""
        some = np.flatnonzero(open_[span[0] : min(span[1], room) + 1]) + span[0] if room >= span[0] else np.zeros(0, int)
        exact = some[open_[room - some] & (some < room)]
        if len(exact):
            return int(exact[-1]), int(room - exact[-1])
        return (int(some[-1]),) if len(some) else ()

    for config, amount in sorted(x.items(), key=lambda e: (-e[1], e[0])):
        times = int(PART * amount + 1e-9)
        classes = [i for i in range(len(groups) - 1, -1, -1) for _ in range(config[i])]
        while times > 0:
            held: dict[int, int] = {}
            room = capacity
            for i in classes[:-2]:  # pieces of their classes, as long as they fit
                n = longest(spans[i][0], min(spans[i][1], room))
                while n and held.get(n, 0) >= left[n]:
                    n = longest(spans[i][0], n - 1)
                if n:
                    held[n] = held.get(n, 0) + 1
                    room -= n
            for n in pair(spans[classes[-2]], room) if len(classes) > 1 else ():
                if held.get(n, 0) < left[n]:
                    held[n] = held.get(n, 0) + 1
                    room -= n
            n = longest(1, room)
            while n and held.get(n, 0) >= left[n]:
                n = longest(1, n - 1)
            if n:
                held[n] = held.get(n, 0) + 1
                room -= n
            if not held or room > SLACK * capacity:
                break  # its classes are used up; best fit gets what is left of them
            block = min(times, *(left[n] // a for n, a in held.items()))
            for n, a in held.items():
                left[n] -= a * block
                open_[n] = left[n] > 0
            out.append((held, block))
            times -= block
    for n in of:
        if not left[n]:
            del left[n]
    return out


def best_fit_decreasing(histogram: dict[int, int], capacity: int, started: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of the whole histogram into the started sequences and new ones: sequences with equal contents are one group."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = np.zeros(capacity + 1, bool)  # which have groups

    def put(config: dict[int, int], times: int, room: int) -> None:
        by_room.setdefault(room, []).append((config, times))
        rooms[room] = True

    for config, times in started:
        put(config, times, capacity - sum(n * a for n, a in config.items()))
    for n in sorted(histogram, reverse=True):
        k = histogram[n]
        while k > 0:
            at = n + int(rooms[n:].argmax()) if rooms[n:].any() else -1
            if at < 0:  # new sequences, each filled with as many as fit
                fit = min(k, capacity // n)
                put({n: fit}, k // fit, capacity - n * fit)
                k -= fit * (k // fit)
                continue
            config, times = by_room[at].pop()
            if not by_room[at]:
                del by_room[at]
                rooms[at] = False
            fit = min(k, at // n)
            use = min(times, k // fit)
            if use < times:
                put(config, times - use, at)
            put(config | {n: config.get(n, 0) + fit}, use, at - n * fit)
            k -= fit * use
    return [x for groups in by_room.values() for x in groups]


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in each sequence, first sequence, offset) for each length of each configuration."""
    rows, ranks, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for n in sorted(config, reverse=True):
            a = config[n]
            first = ranks.get(n, 0)
            ranks[n] = first + a * times
            rows.append((n, first, first + a * times, a, sequence, offset))
            offset += n * a
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), steps: int = STEPS) -> DataFrame:
    """pieces with `sequence_id` and `offset`: places in as few sequences of `capacity` tokens as found.

    Within a sequence offsets are gapless from 0. Lengths must lie between 1 and the capacity; an
    empty table gives an empty result. Ties among rows of equal order columns are broken by nothing
    but their number, so such rows may swap places; every row gets a place of its own.
    """
    spark = pieces.sparkSession
    p = free_prefix(pieces)
    n, bucket, row, rank = F.col(quoted(length_col)), p + "bucket", p + "row", p + "rank"
    order = [quoted(c) for c in order_cols]
    # Ranks within a length, without bringing all rows of a length together: rows are dealt into buckets first.
    kept = checkpointed(pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(4 * shuffle_width(spark)))))
    counts = kept.groupBy(n.alias(p + "n"), F.col(bucket).alias(p + "k")).agg(F.count("*").alias(p + "count"))
    histogram = {r[0]: r[1] for r in counts.groupBy(p + "n").agg(F.sum(p + "count")).collect()}  # at most `capacity` rows
    rows = plan_rows(configurations(histogram, capacity, steps))
    plan = spark.createDataFrame(rows, ", ".join(f"{p}{c} {t}" for c, t in (("len", "int"), ("from", "long"), ("to", "long"), ("each", "int"), ("seq", "long"), ("off", "long"))))
    before = counts.withColumn(p + "before", F.sum(p + "count").over(Window.partitionBy(p + "n").orderBy(p + "k").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        kept.withColumn(row, F.row_number().over(Window.partitionBy(n, bucket).orderBy(*order)) - 1)
        .join(before, (n == F.col(p + "n")) & (F.col(bucket) == F.col(p + "k")))
        .withColumn(rank, F.col(row) + F.coalesce(p + "before", F.lit(0)))
    )
    at = F.col(rank) - F.col(p + "from")
    placed = ranked.join(F.broadcast(plan), (n == F.col(p + "len")) & (F.col(rank) >= F.col(p + "from")) & (F.col(rank) < F.col(p + "to")))
    return placed.select(
        *[F.col(quoted(c)) for c in pieces.columns if c not in ("sequence_id", "offset")],
        (F.col(p + "seq") + F.floor(at / F.col(p + "each"))).cast("long").alias("sequence_id"),
        (F.col(p + "off") + F.pmod(at, F.col(p + "each")) * n).cast("long").alias("offset"),
    )
