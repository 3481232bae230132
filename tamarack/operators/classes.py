"""Queries against a catalog whose items often share their vectors: products are taken once for each class of items of one vector.

A task holds a block of queries and all classes, so a rank among all items is exact in one pass. Of a
class, items go along as far as a query can reach them: the first k by their own part of the score and
then by id, and as many more as a query leaves out of one class. Figures over all items need only the
numbers of items that also share their own part. CLASSES bounds what a task holds; catalogs with more
distinct vectors are for best.py's blocks of items.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import flat, listed
from ..session import checkpointed
from . import best

#: Classes that a task may hold, queries of a task, and scores that it computes at once.
CLASSES, QUERIES, SCORES = 1 << 20, 65_536, 1 << 22
#: Values of sparse and of dense vectors that a task may hold; queries by lists whose vectors it makes at once.
HELD, DENSE, LISTED = 1 << 24, 40_000_000, 1024
#: Ranges of scores by which ranks are bounded, and classes from which on they are.
BINS, MANY = 4096, 8192


def classes_of(items: DataFrame, columns: Sequence[str], most: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(cls, n, vectors), a row for each distinct vector, and items(item, ...) with cls, the least item of its vector; None if there are more than `most`."""
    own = items.withColumn("__h", F.xxhash64(*columns))
    keys = checkpointed(own.groupBy("__h", *columns).agg(F.min("item").alias("cls"), F.count("*").alias("n")))
    size = keys.agg(F.count("*").alias("n"), *[F.sum(F.size(c)).alias(c) for c in columns]).first()
    held = sum(size[c] or 0 for c in columns if c.startswith("x"))
    if size["n"] > (CLASSES if most is None else most) or held > (HELD if any(c.startswith("t") for c in columns) else DENSE):
        return None
    right = keys.select(F.col("__h").alias("__k"), "cls", *[F.col(c).alias(f"__{c}") for c in columns])
    same = F.col("__h") == F.col("__k")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return keys.drop("__h"), own.join(right, same).drop("__h", "__k", *columns, *[f"__{c}" for c in columns])


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """queries with a block `b`: enough blocks for all cores, none above QUERIES or so."""
    n = queries.count()
    blocks = max(1, -(-n // QUERIES), min(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-n // 256)))
    return best.renewed(queries).withColumn("b", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), blocks


def scaled_classes(own: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """The average rank of each class's score among `total` items, n of a class, scaled to 0 to 1; 0 if all are equal. Zeros, often most, are not sorted."""
    some = np.flatnonzero(own)
    value, at = np.unique(own[some], return_inverse=True)
    count = np.bincount(at, n[some], len(value))
    zero = total - count.sum()
    if len(value) + (zero > 0) <= 1:
        return np.zeros(len(own))
    upto = np.cumsum(count) + np.where(value > 0, zero, 0)
    over = 2.0 * max(total - 1, 1)
    out = np.full(len(own), (2 * count[value < 0].sum() + zero - 1) / over)
    out[some] = ((2 * upto - count - 1) / over)[at]
    return out


class Ranks:
    """What scaled_classes() gives, for many classes: bounds of all by ranges of scores, and the values of some."""

    def __init__(self, own: np.ndarray, n: np.ndarray, total: int):
        self.own, self.n, self.over = own, n, 2.0 * max(total - 1, 1)
        least, most = own.min(), own.max()
        self.flat = least == most
        if not self.flat:
            self.bin = ((own - least) * (BINS / (most - least))).astype(np.int32)
            self.bin += own > least  # the least has a range of its own, as it often is 0 for many
            count = np.bincount(self.bin, n, BINS + 2)
            self.upto = np.cumsum(count)
            self.below = self.upto - count

    def most(self) -> np.ndarray:
        """An upper bound for each class."""
        if self.flat:
            return np.zeros(len(self.own))
        high = 2 * self.upto - 2
        high[0] = self.upto[0] - 1
        return (high / self.over)[self.bin]

    def of(self, some: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.zeros(len(some))
        own, bins, wanted = self.own[some], self.bin[some], np.zeros(BINS + 2, bool)
        wanted[bins] = True
        near = np.flatnonzero(wanted[self.bin])
        near = near[np.argsort(self.own[near], kind="stable")]
        value, upto = self.own[near], np.concatenate([[0], np.cumsum(self.n[near])])
        first = upto[np.searchsorted(self.bin[near], bins, "left")]
        below, above = (upto[np.searchsorted(value, own, side)] - first + self.below[bins] for side in ("left", "right"))
        return (below + above - 1) / self.over


class Block:
    """All classes and a block of queries: scores by part, a query at a time."""

    def __init__(self, left: pa.Table, right: pa.Table, suffixes: Sequence[str], rounded: bool = True):
        self.left, self.n, self.rounded = left, right["n"].to_numpy().astype(np.float64), rounded
        self.total = int(self.n.sum())
        self.query = left["query"].to_numpy()
        self.lists = None
        if "liked" in left.column_names:
            cls = right["cls"].to_numpy()
            order = np.argsort(cls)
            own, ends = flat(left["liked"])
            self.lists = order[np.searchsorted(cls[order], own)].astype(np.int64), ends
        self.made = [best.Products(right, None if self.lists else left, s) for s in suffixes]

    def __iter__(self):
        step = max(1, min(best.AT_ONCE, SCORES // max(1, len(self.n))))
        ahead = LISTED if self.lists else max(1, len(self.query))
        for first in range(0, len(self.query), ahead):
            last = min(first + ahead, len(self.query))
            if self.lists:
                own, ends = self.lists
                for m in self.made:
                    m.asked(own[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
            back = first if self.lists else 0  # what the products' first query is
            for lo in range(first, last, step):
                hi = min(lo + step, last)
                scores = [m.of(lo - back, hi - back, self.rounded) for m in self.made]
                for i in range(hi - lo):
                    self.at = lo + i - back
                    yield lo + i, [s[i] for s in scores]


def listed_queries(history: DataFrame, members: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(query, liked, seen, most) of history(query, item, liked): classes of a query's liked items, a class once for each; all its items; and the most of them in one class.

    Items that are not among members(item, cls) are left out, queries without any too unless users(query) has them. A row moves twice, as ids.
    """
    rows = history.repartition("item").groupBy("item", "query").agg(F.max("liked").alias("liked"))
    rows = rows.join(members.select("item", "cls").distinct(), "item").where("query is not null").repartition("query")
    by = rows.groupBy("query", "cls").agg(F.collect_list("item").alias("own"), F.count_if("liked").cast("int").alias("likes"))
    lists = by.groupBy("query").agg(F.flatten(F.collect_list(F.array_repeat("cls", F.col("likes")))).alias("liked"), F.flatten(F.collect_list("own")).alias("seen"), F.max(F.size("own")).alias("most"))
    return checkpointed(lists if users is None else users.select("query").distinct().join(lists, "query", "left"))


def reaching(lead: np.ndarray, raws: list[np.ndarray], n: np.ndarray, total: int, weights: Sequence[float], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the classes that may hold one of the k largest of lead plus the weighted scaled ranks, and the scaled ranks of those.

    Those of the largest bounds are ranked first, and give a limit to the others.
    """
    parts = [Ranks(r, n, total) for r in raws]
    high = lead.copy()
    for part, w in zip(parts, weights, strict=True):
        high += w * part.most()
    if len(high) > 4 * k:
        first = np.argpartition(high, len(high) - 2 * k)[len(high) - 2 * k :]
        score = lead[first] + sum(w * part.of(first) for part, w in zip(parts, weights, strict=True))
        limit = np.partition(score, k)[k]  # of 2 k
        some = np.flatnonzero(high >= (limit - best.SLACK if np.isfinite(limit) else -np.inf))
    else:
        some = np.arange(len(high))
    return some, [part.of(some) for part in parts]


def best_by_classes(queries: DataFrame, found: tuple[DataFrame, DataFrame], weights: Sequence[float] | None, suffixes: Sequence[str], k: int, seen: DataFrame | None, positive: bool = False) -> DataFrame:
    """(query, item, score, rank, raw, scaled): the k best items, ties to the smaller one, of found = classes_of(items(item, static, ...)).

    The score is static plus the weighted scaled ranks of all parts; without weights it is the product itself.
    Queries have vectors, or are listed_queries(), which have what they leave out.
    """
    keys, members = found
    columns = [c for c in keys.columns if c not in ("cls", "n")]
    more = 0
    if "liked" in queries.columns:
        more = queries.agg(F.max("most")).first()[0] or 0
        queries = queries.drop("most")
    elif seen is not None:
        hide = seen.select("query", "item").distinct().join(members.select("item", "cls"), "item").groupBy("query", "cls").agg(F.collect_list("item").alias("own"))
        hide = checkpointed(hide.groupBy("query").agg(F.flatten(F.collect_list("own")).alias("seen"), F.max(F.size("own")).alias("most")))
        more = hide.agg(F.max("most")).first()[0] or 0
        queries = queries.join(hide.select("query", "seen"), "query", "left")
    else:
        queries = queries.withColumn("seen", F.array().cast("array<bigint>"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("static"), "item"))
    first = members.withColumn("place", place).where(F.col("place") <= k + more)
    lists = first.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("place", "item", "static"))).alias("m"))
    right = keys.join(lists, "cls").select("cls", "n", F.col("m.item").alias("item"), F.col("m.static").alias("static"), *columns)
    asked, blocks = query_blocks(queries)
    count = len(suffixes)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            block = Block(left, right, suffixes)
            (item, ends), (static, _) = flat(right["item"]), flat(right["static"])
            start, size = ends[:-1], np.diff(ends)
            by_id, top = np.argsort(item), static[start]
            sorted_ids, cls = item[by_id], np.repeat(np.arange(len(size)), size)
            hide, cuts = flat(left["seen"])
            gone, everything = np.zeros(len(item), bool), np.arange(len(size))
            for i, raws in block:
                own = hide[cuts[i] : cuts[i + 1]]
                at = np.minimum(np.searchsorted(sorted_ids, own), len(item) - 1)
                out_of = by_id[at[sorted_ids[at] == own]]
                gone[out_of] = True
                lead = top.copy()
                for c in np.unique(cls[out_of[start[cls[out_of]] == out_of]]):  # classes whose first item is left out
                    rest = np.flatnonzero(~gone[start[c] : ends[c + 1]])
                    lead[c] = static[start[c] + rest[0]] if len(rest) else -np.inf
                near, scaled = everything, raws
                if weights is not None and len(block.n) >= MANY and min(weights) >= 0 and all(np.isfinite(r.sum()) for r in raws):
                    near, scaled = reaching(lead, raws, block.n, block.total, weights, k)
                elif weights is not None:
                    scaled = [scaled_classes(r, block.n, block.total) for r in raws]
                value = sum(w * s for w, s in zip(weights if weights is not None else [1.0], scaled, strict=True))
                reach = lead[near] + value
                reach[~np.isfinite(reach) | (positive & (value <= 0))] = -np.inf
                limit = np.partition(reach, len(reach) - k)[len(reach) - k] if len(reach) > k else -np.inf
                some = np.flatnonzero((reach >= limit - best.SLACK) & (reach > -np.inf))
                sizes, first = size[near[some]], start[near[some]]
                of = np.repeat(some, sizes)
                places = np.arange(len(of)) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(some) else np.zeros(0, np.int64)
                left_in = ~gone[places]
                places, of = places[left_in], of[left_in]
                score = np.round(static[places] + value[of], best.DIGITS)
                order = np.lexsort((item[places], -score))[:k]
                gone[out_of] = False
                of = of[order]
                for col, x in zip(out, (np.full(len(order), block.query[i]), item[places[order]], score[order], np.arange(1, len(order) + 1), np.array([r[near[of]] for r in raws]).T.ravel(), np.array([x[of] for x in scaled]).T.ravel()), strict=True):
                    col.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        ends = np.arange(len(cols[0]) + 1) * count
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.table([*(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds, strict=False)), *(listed(c.astype(np.float64), ends) for c in cols[4:])], ["query", "item", "score", "rank", "raw", "scaled"])

    right = right.withColumn("b", best.every(blocks))
    return asked.groupBy("b").cogroup(right.groupBy("b")).applyInArrow(run, "query long, item long, score double, rank int, raw array<double>, scaled array<double>")


def sums_by_classes(queries: DataFrame, found: tuple[DataFrame, DataFrame], weights: Sequence[float] | None, suffixes: Sequence[str], weight: Column) -> DataFrame:
    """(query, items, total, weighted): the number of scores of all items, their sum, and their sum times `weight`, a whole number that follows from the item.

    Scores are as in best_by_classes. Without weights only items that share a term with the query count.
    """
    keys, members = found
    columns = [c for c in keys.columns if c not in ("cls", "n")]
    by = members.groupBy("cls", "static").agg(F.count("*").alias("m"), F.sum(weight).cast("long").alias("w"))
    lists = by.groupBy("cls").agg(F.collect_list(F.struct("static", "m", "w")).alias("g"))
    right = keys.join(lists, "cls").select("cls", "n", *[F.col(f"g.{c}").alias(c) for c in ("static", "m", "w")], *columns)
    asked, blocks = query_blocks(queries)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = Block(left, right, suffixes, weights is not None)
            (static, ends), (m, _), (w, _) = (flat(right[c]) for c in ("static", "m", "w"))
            cls = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            m, w = m.astype(np.float64), w.astype(np.float64)
            items, heavy = np.bincount(cls, m, len(ends) - 1), np.bincount(cls, w, len(ends) - 1)
            for i, raws in block:
                if weights is None:
                    made = block.made[0]
                    shared = raws[0] > 0 if made.above else made.shared(block.at)
                    score = np.where(shared, np.round(raws[0], best.DIGITS), 0.0)
                    rows.append((block.query[i], int(items @ shared), float(score @ items), float(score @ heavy)))
                else:
                    value = sum(a * scaled_classes(r, block.n, block.total) for a, r in zip(weights, raws, strict=True))
                    score = np.round(static + value[cls], best.DIGITS)
                    rows.append((block.query[i], block.total, float(score @ m), float(score @ w)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["query", "items", "total", "weighted"])

    right = right.withColumn("b", best.every(blocks))
    return asked.groupBy("b").cogroup(right.groupBy("b")).applyInArrow(run, "query long, items long, total double, weighted double")
