"""Removal of lines that nearly repeat an earlier line: an exact set-similarity join of lines.

A line's tokens are its distinct runs of SHINGLE words; a shorter line has one, its whole sequence. (Single
words were tried and measured: where a corpus uses most of its words often, a line's rarest words are
shared by many unrelated lines, and what meets grows faster than the input.) Lines of equal words are
found by a hash of their sequence; the earliest stands for all in the rest.

Tokens are ordered by rarity, by an exact count in slices that ends in tables of fixed size; tokens of
one line alone come first and lead nowhere, and a line with too many of them has no partner. Two sets of
Jaccard similarity t or more share a token among the first |x| - ceil(t |x|) + 1 of each, the prefix.
Lines meet at these tokens. Length, positional and bitmap filters (bits are parities of the tokens that
hash to them, so differing bits are at most as many as tokens that only one of the sets has) drop most
pairs of lines that share one, the others are verified on their whole sets.

A line goes once one earlier line matches. So at each token a line is paired with CLOSE candidates of
few differing bits, or PARTNERS in all, and lines that share one are compared HELD at a time, as Spark's
sort brings them. Lines that were not compared with all others of a token for these reasons, and
matched nothing, are then joined with all of them by a Spark join, which adaptive execution splits
where a token is hot. So no task holds all lines of a token, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, checkpointed, free_prefix, list_parts, lists, mix, quoted, range_hashes, row_key, shuffle_width, text_batches
from .shared_tokens import Shared, shared_tokens
from .sketch import bitmap_of, counted, inside

#: Words of a token.
SHINGLE = 5
#: Candidates of a line at each of its tokens before the rest are joined in full: those that are surely near, and all.
CLOSE, PARTNERS = 2, 16
#: Lines of one token that are compared with each other at a time, and rows that a task gathers first.
HELD, GATHERED = 4096, 200_000
#: Words of 64 parity bits of a set, at most.
SKETCH = 64
#: Tokens of lines that a block's sort keys can tell apart.
_LINES = 1 << 20
_U = np.uint64
_ID = "a long, b long, line int"


def lines_of(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that has words: its text, its number there, its first word in the block and the number of its words."""
    breaks = np.flatnonzero(data == 10)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    number = np.searchsorted(breaks, words.starts)
    line = number + text  # ascends, and tells the lines of all texts apart
    new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
    return text[new], number[new] - np.searchsorted(breaks, offsets[:-1])[text[new]], new, np.diff(np.append(new, len(line)))


class Lines:
    """Lines of a block of texts that have `least` words or more, with their tokens in order of rarity.

    With `pick`, a function of arrays (text, line number, hash of the line's words), only lines that it lets through are made.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, shared: Shared | None = None, pick=None):
        words = Words(data, offsets, fold=True)
        of_text, of_number, new, n = lines_of(words, data, offsets)
        keep = n >= least
        if pick is not None:
            keep[keep] = pick(of_text[keep], of_number[keep], range_hashes(words.hashes, new[keep], (new + n)[keep], 0))
        self.text, self.number, new, n = of_text[keep], of_number[keep], new[keep], n[keep]
        # Each line's tokens: a run from each of its first n - SHINGLE + 1 words, or the whole if it has fewer.
        many = np.maximum(1, n - SHINGLE + 1)
        of = np.repeat(np.arange(len(n)), many)
        start = np.repeat(new, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        token = range_hashes(words.hashes, start, start + np.minimum(n, SHINGLE)[of], 1) if len(of) else np.zeros(0, _U)
        level = np.minimum(shared(token), 63) if shared is not None else np.zeros(len(token), np.uint8)
        order = self._sorted(of, mix(token), level)
        of, token, level = of[order], token[order], level[order]
        one = np.concatenate([[True], (of[1:] != of[:-1]) | (token[1:] != token[:-1])]) if len(of) else np.zeros(0, bool)
        self.of, self.token, self.level = of[one], token[one], level[one]
        self.n = np.bincount(self.of, minlength=len(n)) if len(n) else n
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.place = np.arange(len(self.of)) - self.ends[self.of]
        self.common = self.reduced(np.add, (self.level > 0).astype(np.int64))  # tokens that other lines may have

    def _sorted(self, of: np.ndarray, spread: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Tokens by line, then by level and hash."""
        if len(self.text) >= _LINES:  # one text of very many lines
            return np.lexsort((spread, level, of))
        key = (of.astype(_U) << _U(44)) | (level.astype(_U) << _U(38)) | (spread >> _U(26))
        order = np.argsort(key)
        key = key[order]
        tie = np.flatnonzero(key[1:] == key[:-1])
        if len(tie) and (spread[order[tie]] != spread[order[tie + 1]]).any():  # different tokens that share 38 bits
            return np.lexsort((spread, level, of))
        return order

    def reduced(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values, self.ends[:-1]) if len(self.n) else values[:0]

    def prefix(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of the prefixes are, and the tokens; none of lines that lack tokens which others may have."""
        some = (self.place < (self.n + (-percent * self.n // 100) + 1)[self.of]) & (100 * self.common >= percent * self.n)[self.of] & (self.level > 0)
        at = np.flatnonzero(some)
        return at, self.token[at]

    def parities(self, some: np.ndarray) -> pa.Array:
        """A list of words for each of some lines: bits that are parities of the tokens that hash to them, as many as the line has tokens or more."""
        n = self.n[some]
        size = np.minimum(SKETCH, 1 << np.ceil(np.log2(np.maximum(1, n / 64))).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.ends[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bit = (mix(self.token[at] + _U(3)) & np.repeat((64 * size - 1).astype(_U), n)).astype(np.int64) + np.repeat(64 * ends[:-1], n)
        raw = np.packbits(np.bincount(bit, minlength=64 * ends[-1]) & 1 == 1, bitorder="little")
        return lists(np.frombuffer(raw.tobytes(), np.int64), ends)


def signatures(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number and hash of the words of each line of `least` words or more."""
    words = Words(data, offsets, fold=True)
    text, number, new, n = lines_of(words, data, offsets)
    keep = n >= least
    return text[keep], number[keep], range_hashes(words.hashes, new[keep], (new + n)[keep], 0)


def ids(batch_a: np.ndarray, batch_b: np.ndarray, lo: int, text: np.ndarray, number: np.ndarray) -> list[pa.Array]:
    return [pa.array(batch_a[lo + text]), pa.array(batch_b[lo + text]), pa.array(number.astype(np.int32))]


def row_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(np.int64).view(_U)) ^ b.astype(np.int64).view(_U) ^ _U(0x452821E638D01377))


def lines_bitmap(lines: DataFrame) -> np.ndarray:
    """A bitmap of lines (a, b, line), and of the rows that they are lines of."""

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        a, b, line = (batch.column(k).to_numpy() for k in range(3))
        yield line_hash(a, b, line)
        yield row_hash(a, b)

    return bitmap_of(lines, values)


def sought(bitmap: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (a, b, text) of the batch that may have lines in the bitmap: the texts of all others need no look."""
    return batch.filter(pa.array(inside(bitmap, row_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()))))


def line_hash(a: np.ndarray, b: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(np.int64).view(_U)) ^ b.astype(np.int64).view(_U)) + line.astype(_U)


def find_matches(docs: DataFrame, percent: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, line): lines that an earlier line matches."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    keyed = docs.select(*row_key(id_col, text_col), F.col(quoted(text_col)).cast("string").alias("text"))
    share = spark.sparkContext.broadcast

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                text, number, s1 = signatures(data, offsets, least)
                yield pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), *ids(a, b, lo, text, number)], ["s1", "a", "b", "line"])

    # Lines of equal words: all but the earliest go. Of those that a bitmap of the repeated ones lets through, only the earliest line is kept on.
    lines = checkpointed(keyed.mapInArrow(sign, f"s1 long, {_ID}"))
    sets = checkpointed(lines.groupBy("s1").agg(F.min(F.struct("a", "b", "line")).alias("first"), F.count("*").alias("n")))
    repeated = sets.where("n > 1")
    tokens = (keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5  # a word has about that many bytes
    equal = lines.join(repeated, "s1").where("struct(a, b, line) > first").select("a", "b", "line")
    twice = share(bitmap_of(repeated.select("s1"), lambda t: iter([t.column(0).to_numpy().view(_U)])))

    def leading(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        s1, a, b, line = (c.to_numpy() for c in batch.columns)
        some = inside(twice.value, s1.view(_U))
        yield line_hash(a[some], b[some], line[some])

    leaders = share(bitmap_of(sets.select("s1", "first.*"), leading))

    def kept(a: np.ndarray, b: np.ndarray, lo: int, data: np.ndarray, offsets: np.ndarray, shared: Shared | None) -> Lines:
        """The lines of a block that stand for all of equal words."""
        return Lines(data, offsets, least, shared, lambda t, k, s1: ~inside(twice.value, s1) | inside(leaders.value, line_hash(a[lo + t], b[lo + t], k)))

    def tokens_of_all(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, _, data, offsets in blocks(batch.column(2)):
            yield kept(a, b, lo, data, offsets, None).token

    # Prefixes hold about so many of all tokens at most: as many tasks as keep each one's share small.
    width = max(shuffle_width(spark), tokens * (100 - percent) // 100 // 3_000_000 + 1)
    shared = share(shared_tokens(keyed, tokens_of_all))

    def postings(tokens: np.ndarray | None) -> DataFrame:
        """The tokens at which lines may meet: all, or those in a bitmap."""
        asked = share(tokens)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for lo, _, data, offsets in blocks(batch.column(2)):
                    own = kept(a, b, lo, data, offsets, shared.value)
                    at, token = own.prefix(percent)
                    if asked.value is not None:
                        some = inside(asked.value, token)
                        at, token = at[some], token[some]
                    of = own.of[at]
                    some, row = np.unique(of, return_inverse=True)
                    size = (own.n[of] << 32) | own.place[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token.view(np.int64)), *ids(a, b, lo, own.text[of], own.number[of]), pa.array(size), own.parities(some).take(pa.array(row))],
                        ["token", "a", "b", "line", "size", "bits"],
                    )

        return keyed.mapInArrow(post, f"token long, {_ID}, size long, bits array<long>")

    schema = "xa long, xb long, xline int, ya long, yb long, yline int, kind int"
    rows = postings(None).repartition(width, "token").sortWithinPartitions("token", F.shiftright("size", 32), "a", "b", "line")
    # Kinds: 0 a pair, 1 a pair of a line that has more candidates, 3 a line not compared with all.
    met = rows.mapInArrow(lambda batches: meet(batches, percent), schema).groupBy("xa", "xb", "xline", "ya", "yb", "yline").agg(F.max("kind").alias("kind"))
    met = checkpointed(met)
    x = [F.col(f"x{c}").alias(c) for c in ("a", "b", "line")]
    found = checkpointed(verified(met.where("kind < 2"), keyed, percent, least))
    rest = checkpointed(met.where("kind in (1, 3)").select(*x).distinct().join(found, ["a", "b", "line"], "left_anti"))
    if not rest.isEmpty():
        lost = share(lines_bitmap(rest.select("a", "b", "line")))

        def tokens_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            batch = sought(lost.value, batch)
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                yield Lines(data, offsets, least, shared.value, lambda t, k, _: inside(lost.value, line_hash(a[lo + t], b[lo + t], k))).prefix(percent)[1]

        posted = checkpointed(postings(np.packbits(counted(keyed, tokens_of) > 0))).withColumns({"n": F.shiftright("size", 32), "place": F.col("size").bitwiseAND(0xFFFFFFFF)}).drop("size")
        seekers = posted.join(rest, ["a", "b", "line"], "left_semi").alias("x")
        found = found.union(verified(checkpointed(candidates(seekers, posted.alias("y"), percent)), keyed, percent, least))
    return found.union(equal).distinct()


def candidates(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """(xa, xb, xline, ya, yb, yline): lines of x with each earlier one of y that passes the filters at a shared token."""
    need = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))
    fold = lambda s: F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.when(F.size(f"{s}.bits") > words, F.col(f"{s}.bits")[i].bitwiseXOR(F.col(f"{s}.bits")[i + words])).otherwise(F.col(f"{s}.bits")[i]))
    words = F.least(F.size("x.bits"), F.size("y.bits"))
    differ: Column = F.aggregate(F.zip_with(fold("x"), fold("y"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, c: total + c)
    on = (
        (F.col("x.token") == F.col("y.token"))
        & (F.struct("y.a", "y.b", "y.line") < F.struct("x.a", "x.b", "x.line"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= need)
        & (differ <= F.col("x.n") + F.col("y.n") - 2 * need)
    )
    return x.join(y, on).select(*[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in ("a", "b", "line")]).distinct()


def meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of lines at the tokens of this task, whose rows come sorted by token, size of the set, and id."""
    names = ["xa", "xb", "xline", "ya", "yb", "yline", "kind"]
    held: list[tuple[np.ndarray, ...]] = []

    def rows_of(own: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own[c][k]) for k in (x, y) for c in (1, 2, 3)] + [pa.array(kind.astype(np.int32))], names)

    def compare(cols: tuple[np.ndarray, ...], cut_before: bool, cut_after: bool) -> Iterator[pa.RecordBatch]:
        """Rows of whole tokens, but for the first or the last if they are cut: lines of those are left open."""
        token, a, b, line, size, words, bits = cols
        n, place = size >> 32, size & 0xFFFFFFFF
        first = np.cumsum(words) - words
        bits = bits.view(_U)  # bits of signed numbers are counted without their sign

        def differing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both = np.minimum(words[i], words[j])
            out = np.zeros(len(i), np.int64)
            for w in range(int(both.max(initial=0))):
                at = np.flatnonzero(both > w)
                p, q, k = i[at], j[at], both[at]
                fold = lambda r: bits[first[r] + w] ^ np.where(words[r] > k, bits[np.minimum(first[r] + w + k, len(bits) - 1)], _U(0))  # noqa: B023, E731
                out[at] += np.bitwise_count(fold(p) ^ fold(q))
            return out

        edge = np.concatenate([[True], token[1:] != token[:-1]])
        group = np.cumsum(edge) - 1
        many = np.bincount(group)[group] > HELD
        many |= (cut_before & (group == 0)) | (cut_after & (group == group[-1]))
        left = np.flatnonzero(many)
        if len(left):
            yield rows_of(cols, left, left, np.full(len(left), 3))
        # Oversized tokens are compared in stretches of HELD lines, which have near sizes.
        part = (np.arange(len(token)) - np.searchsorted(group, group)) // HELD
        stretch = np.cumsum(edge | np.concatenate([[True], part[1:] != part[:-1]]))
        close, had, more = np.zeros(len(token), np.int32), np.zeros(len(token), np.int32), np.zeros(len(token), bool)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        j, lag = np.arange(len(token)), 1
        while len(j):
            j = j[j >= lag]
            i = j - lag
            near = (stretch[i] == stretch[j]) & (100 * n[i] >= percent * n[j])  # sizes ascend: what fails now fails at larger lags
            i, j = i[near], j[near]
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            p = np.flatnonzero(np.minimum(n[i] - place[i], n[j] - place[j]) >= need)
            p = p[(a[i[p]] != a[j[p]]) | (b[i[p]] != b[j[p]]) | (line[i[p]] != line[j[p]])]  # not the line of a repeated row
            u, v = i[p], j[p]
            most = n[u] + n[v] - 2 * need[p]
            after = (a[v] > a[u]) | ((a[v] == a[u]) & ((b[v] > b[u]) | ((b[v] == b[u]) & (line[v] > line[u]))))
            x, y = np.where(after, v, u), np.where(after, u, v)
            open_ = (close[x] < CLOSE) & (had[x] < PARTNERS)
            differ = np.full(len(p), -1)
            differ[open_] = differing(u[open_], v[open_])
            more[x[~open_]] = True
            ok = open_ & (differ <= most)
            x, y, differ, most = x[ok], y[ok], differ[ok], most[ok]
            if len(x):
                np.add.at(had, x, 1)
                np.add.at(close, x[2 * differ <= most], 1)
                out.append((x, y))
            lag += 1
        if out:
            x, y = (np.concatenate(z) for z in zip(*out, strict=True))
            yield rows_of(cols, x, y, more[x])

    def cut_at(own: tuple[np.ndarray, ...], lo: int, hi: int) -> tuple[np.ndarray, ...]:
        ends = np.concatenate([[0], np.cumsum(own[5])])
        return (*[c[lo:hi] for c in own[:6]], own[6][ends[lo] : ends[hi]])

    def whole(last: bool, before: bool) -> Iterator[pa.RecordBatch]:
        """Compares what is held, up to its last token unless that is all, and keeps the rest."""
        cols = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        to = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))
        cut = not last and to == 0  # one token fills all
        if cut:
            to = len(cols[0])
        yield from compare(cut_at(cols, 0, to), before, cut)
        if to < len(cols[0]):
            held.append(cut_at(cols, to, len(cols[0])))

    size, cut_token = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bits, ends = list_parts(batch.column(5))
        held.append((*[c.to_numpy() for c in batch.columns[:5]], np.diff(ends), bits))
        size += batch.num_rows
        if size >= GATHERED:
            before, end = held[0][0][0] == cut_token if cut_token is not None else False, held[-1][0][-1]
            yield from whole(False, bool(before))
            size = sum(len(h[0]) for h in held)
            cut_token = end if not held else None
    if held:
        yield from whole(True, cut_token is not None and bool(held[0][0][0] == cut_token))


def verified(pairs: DataFrame, keyed: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b, line) of the later lines of pairs whose sets are similar enough.

    Sets are made anew for the lines in question only: a bitmap of fixed size keeps most others back,
    and the joins below drop what it lets through.
    """
    either = [F.array(*[F.struct(F.col(f"{s}a").alias("a"), F.col(f"{s}b").alias("b"), F.col(f"{s}line").alias("line")) for s in "xy"])]
    shared = keyed.sparkSession.sparkContext.broadcast(lines_bitmap(pairs.select(F.explode(*either).alias("l")).select("l.*").distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = sought(shared.value, batch)
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                own = Lines(data, offsets, least, None, lambda text, number, _: inside(shared.value, line_hash(a[lo + text], b[lo + text], number)))  # noqa: B023
                yield pa.RecordBatch.from_arrays([*ids(a, b, lo, own.text, own.number), lists(own.token, own.ends)], ["a", "b", "line", "tokens"])

    # Equal rows have equal lines. Both sides of the join below read what is made here once.
    found = checkpointed(keyed.mapInArrow(sets, f"{_ID}, tokens array<long>").groupBy("a", "b", "line").agg(F.first("tokens").alias("tokens")))
    side = lambda s: found.select(*[F.col(c).alias(f"{s}{c}") for c in ("a", "b", "line", "tokens")])
    joined = pairs.join(side("x"), ["xa", "xb", "xline"]).join(side("y"), ["ya", "yb", "yline"])
    both = F.size(F.array_intersect("xtokens", "ytokens"))
    return joined.where(100 * both >= percent * (F.size("xtokens") + F.size("ytokens") - both)).select(F.col("xa").alias("a"), F.col("xb").alias("b"), F.col("xline").alias("line")).distinct()


def remove_repeated_lines(docs: DataFrame, percent: int = 80, least_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text and removed_lines (numbers of the removed lines, from 0).

    A line (between line feeds) goes if an earlier one, by (id, line number), has a set of SHINGLE-word
    runs of Jaccard similarity percent / 100 or more, whether or not that one goes itself. Words are
    runs of anything but ASCII white space, A-Z folded. A line shorter than a run matches lines of the
    same words only. Lines of fewer words than `least_words` stay and match nothing; by default those
    are the blank ones. A null text stays null and has no lines. A
    null id sorts first; among rows of one id, order is by a hash of the text; rows that repeat an id
    and text count as one. `percent` is more than 50. An empty table gives an empty result. Columns of the two names are replaced,
    all others kept, whatever they are called.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be more than 50, at most 100")
    made = ("kept_text", "removed_lines")
    p = free_prefix(docs)
    a, b, text, lost, may = (p + x for x in ("a", "b", "text", "lost", "may"))
    gone = checkpointed(find_matches(docs, percent, least_words, id_col, text_col).groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(F.sort_array(F.collect_set("line")).alias(lost)))
    others = [F.col(quoted(c)) for c in docs.columns if c not in made]

    # Only rows that a bitmap of fixed size lets through move for the join; the others lose no line.
    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(batch.column(0).to_numpy().view(_U)) ^ batch.column(1).to_numpy().view(_U)

    asked = docs.sparkSession.sparkContext.broadcast(bitmap_of(gone.select(a, b), values))

    def may_lose(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(inside(asked.value, mix(a.to_numpy().view(_U)) ^ b.to_numpy().view(_U)))

    may_lose.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    rows = docs.select(*others, *row_key(id_col, text_col, a, b), F.col(quoted(text_col)).cast("string").alias(text)).withColumn(may, F.arrow_udf(may_lose, "boolean")(a, b))
    untouched = rows.where(~F.col(may)).select(*others, F.col(text).alias("kept_text"), F.array().cast("array<int>").alias("removed_lines"))
    touched = rows.where(may).join(gone, [a, b], "left")
    numbers = F.coalesce(lost, F.array().cast("array<int>"))
    cut = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(numbers, i)), "\n")
    kept = F.when(F.size(numbers) == 0, F.col(text)).otherwise(cut)
    return untouched.unionByName(touched.select(*others, kept.alias("kept_text"), numbers.alias("removed_lines")))
