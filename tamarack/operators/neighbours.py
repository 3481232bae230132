"""Nearest items: by users in common, and by terms in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import flat, listed, starts
from ..functions.vectors import unit
from ..session import checkpointed
from .best import SLACK, best_products, numbered_terms, sparse
from .classes import CLASSES, best_by_classes, classes_of
from .prepare import dense_ids

#: Items of a group; positives of a user beyond which they are dealt out by group; pairs that a task gathers before it adds them up.
GROUP, HEAVY, GATHERED = 2048, 512, 2_000_000
#: Items with a term, at most, that are joined by it.
RARE = 64
#: Items of a class, on average, from which on classes are ranked instead of items.
SHARED = 2
_CELLS = "g int, h int, s int, user long, a array<long>, na array<long>, b array<long>, nb array<long>, c array<long>"


class Counts:
    """Sums of pairs (i, j), i < j, that come in any order and any number."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        self.keys.append((np.minimum(i, j) << 31) | np.maximum(i, j))
        self.counts.append(c)
        self.size += len(c)
        if self.size >= GATHERED:
            self.size = len(self.sums()[0]) // 2  # what is summed already counts half, so that a large sum isn't made anew at every step

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, back, np.concatenate(self.counts))
        self.keys, self.counts = [keys], [counts]
        return keys, counts


def item_knn(positives: DataFrame, neighbours: int = 20) -> DataFrame:
    """(movieId, otherId, similarity, place): cosine of co-occurrence over users, the nearest of each item.

    positives(userId, movieId) holds each pair once. Co-occurrence is a sparse product that is cut into
    cells, a cell for each pair of groups of items. Users with few positives send the pairs of these,
    added up in their task, to the cells; a user with more than HEAVY sends lists of items, one for each
    group, to the cells that need them, and pairs are made there. So a heavy user's work is spread over
    all cells and makes no rows of pairs. A cell streams what comes, keeps sums, and sends on the
    nearest of its items only. Where there are fewer cells than tasks, users are spread over several
    tasks of a cell, whose sums are added before anything is left out. Ids are longs.
    """
    spark = positives.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = checkpointed(dense_ids(positives, "movieId", start=0, out="d").join(positives.groupBy("movieId").agg(F.count("*").alias("n")), "movieId"))
    groups = max(1, -(-numbers.count() // GROUP))
    cells = groups * (groups + 1) // 2
    spread = max(1, -(-width // cells))
    rows = positives.join(numbers, "movieId").select(F.col("userId").cast("long").alias("user"), "d", "n")
    sizes = rows.groupBy("user").agg(F.count("*").alias("size"))
    heavy = checkpointed(sizes.where(F.col("size") > HEAVY).select("user"))

    def cell_rows(counts: Counts, n: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, c = counts.sums()
        if not len(keys):
            return
        i, j = keys >> 31, keys & 0x7FFFFFFF
        swap = i % groups > j % groups  # the lower group comes first
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        place = (((a % groups) * groups + b % groups) * spread) + (i + j) % spread
        order = np.argsort(place, kind="stable")
        a, b, c, place = a[order], b[order], c[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        cuts = np.append(first, len(place))
        cell = place[first] // spread
        ids, known = n["ids"], n["n"]
        of = lambda x: known[np.searchsorted(ids, x)]
        cols = [pa.array((cell // groups).astype(np.int32)), pa.array((cell % groups).astype(np.int32)), pa.array((place[first] % spread).astype(np.int32)), pa.array(np.full(len(first), -1))]
        yield pa.RecordBatch.from_arrays([*cols, *[listed(x, cuts) for x in (a, of(a), b, of(b), c)]], ["g", "h", "s", "user", "a", "na", "b", "nb", "c"])

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of users whose items come in one list."""
        counts, ids, ns, size = Counts(), [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            known, at = np.unique(np.concatenate(ids), return_index=True)
            yield from cell_rows(counts, {"ids": known, "n": np.concatenate(ns)[at]})

        for batch in batches:
            (d, cuts), (n, _) = flat(batch.column(0)), flat(batch.column(1))
            ids.append(d)
            ns.append(n)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, y = np.triu_indices(b - a, 1)
                counts.add(d[a:b][x], d[a:b][y], np.ones(len(x), np.int64))
                size += len(x)
            if size >= GATHERED:
                yield from send()
                counts, ids, ns, size = Counts(), [], [], 0
        if ids:
            yield from send()

    few = rows.join(heavy, "user", "left_anti").groupBy("user").agg(F.collect_list(F.struct("d", "n")).alias("v")).where(F.size("v") > 1).select("v.d", "v.n")
    pairs = few.mapInArrow(light, _CELLS)
    # A heavy user's list of a group goes to every cell of that group, as its first side or its second, or both.
    lists = rows.join(heavy, "user", "left_semi").groupBy("user", (F.col("d") % groups).cast("int").alias("x")).agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("v"))
    lists = lists.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    none = F.array().cast("array<bigint>")
    side = lambda on, f: F.when(on, F.col(f)).otherwise(none)
    first, second = F.col("x") <= F.col("y"), F.col("x") >= F.col("y")
    lists = lists.select(F.least("x", "y").alias("g"), F.greatest("x", "y").alias("h"), F.pmod(F.xxhash64("user"), F.lit(spread)).cast("int").alias("s"), "user", *[side(on, f).alias(name) for on, f, name in ((first, "v.d", "a"), (first, "v.n", "na"), (second, "v.d", "b"), (second, "v.n", "nb"))], none.alias("c"))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, ns = None, Counts(), {}
        last_user, side_a, side_b = None, [], []

        def note(ids: np.ndarray, n: np.ndarray) -> None:
            ids, at = np.unique(ids, return_index=True)
            ns.update(zip(ids.tolist(), n[at].tolist(), strict=True))

        def user_done() -> None:
            if side_a and side_b:
                a, b = np.concatenate(side_a), np.concatenate(side_b)
                for k in range(0, len(a), max(1, GATHERED // len(b))):
                    own = a[k : k + max(1, GATHERED // len(b))]
                    i, j = np.repeat(own, len(b)), np.tile(b, len(own))
                    keep = i < j if now[0] == now[1] else np.ones(len(i), bool)
                    counts.add(i[keep], j[keep], np.ones(keep.sum(), np.int64))
            side_a.clear()
            side_b.clear()

        def done() -> Iterator[pa.RecordBatch]:
            user_done()
            keys, c = counts.sums()
            i, j = keys >> 31, keys & 0x7FFFFFFF
            of = lambda x: np.array([ns[v] for v in x.tolist()], np.int64)
            n, m = of(i), of(j)
            if spread == 1:
                i, j, n, m, c = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([n, m]), np.concatenate([m, n]), np.concatenate([c, c])
                order = np.lexsort((j, -np.round(c / np.sqrt(n * m.astype(np.float64)), 10), i))
                begin = np.searchsorted(i[order], i[order], "left")
                order = order[np.arange(len(order)) - begin < neighbours]
                i, j, n, m, c = (x[order] for x in (i, j, n, m, c))
            for k in range(0, len(i), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (i, j, n, m, c)], ["i", "j", "n", "m", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = starts(batch, 4)
            keys = list(zip(*(batch.column(k).take(pa.array(cuts[:-1])).to_pylist() for k in range(4)), strict=True))
            parts = [flat(batch.column(k)) for k in range(4, 9)]
            for key, lo, hi in zip(keys, cuts[:-1], cuts[1:], strict=True):
                if key[:3] != now:
                    if now is not None:
                        yield from done()
                    now, counts, last_user = key[:3], Counts(), None
                    ns.clear()
                if key[3] != last_user:
                    user_done()
                    last_user = key[3]
                a, na, b, nb, c = (v[e[lo] : e[hi]] for v, e in parts)
                note(a, na)
                note(b, nb)
                if len(c):
                    counts.add(a, b, c)
                    continue
                for own, side in ((a, side_a), (b, side_b)):
                    if len(own):
                        side.append(own)
        if now is not None:
            yield from done()

    met = pairs.unionByName(lists).repartition(max(width, min(cells * spread, 20 * width)), "g", "h", "s").sortWithinPartitions("g", "h", "s", "user")
    found = met.mapInArrow(cell, "i long, j long, n long, m long, c long")
    if spread > 1:
        total = found.groupBy("i", "j").agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
        found = total.select(F.inline(F.array(F.struct("i", "j", "n", "m", "c"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("m").alias("n"), F.col("n").alias("m"), "c"))))
    near = found.withColumn("similarity", F.round(F.col("c") / F.sqrt(F.col("n") * F.col("m")), 10))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "j"))).where(F.col("place") <= neighbours)
    name = lambda d, out: numbers.select(F.col("d").alias(d), F.col("movieId").alias(out))
    return near.join(name("i", "movieId"), "i").join(name("j", "otherId"), "j").select("movieId", "otherId", "similarity", "place")


def sparse_products(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with `product` of their vectors(item, t, x), whose terms ascend; 0 where one has none."""
    named = lambda s: vectors.select(F.col("item").alias(s), F.col("t").alias(f"t_{s}"), F.col("x").alias(f"x_{s}"))
    rows = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    kept = rows.columns[: len(rows.columns) - 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sides = []
            for s in "ab":
                (t, ends), (x, _) = (flat(batch.column(batch.schema.get_field_index(f"{c}_{s}"))) for c in "tx")
                sides.append((np.repeat(np.arange(n), np.diff(ends)) * np.int64(1 << 40) + t.astype(np.int64), x))
            (p, x), (q, y) = sides
            at = np.minimum(np.searchsorted(q, p), max(len(q) - 1, 0))
            same = q[at] == p if len(q) else np.zeros(len(p), bool)
            product = np.bincount((p[same] >> 40).astype(np.int64), x[same].astype(np.float64) * y[at[same]].astype(np.float64), n) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(product.astype(np.float64))], [*kept, "product"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return rows.mapInArrow(run, f"{schema}, product double")


def similar_by_terms(weights: DataFrame, top_k: int = 10) -> DataFrame:
    """movieId, otherId, score, place: the most similar items by cosine over shared terms; items that share none are not similar.

    Items are joined by their rare terms, those of RARE items or fewer, which weigh most; what frequent
    terms add to such a pair is looked up in both vectors. An item without a rare term in common has at
    most the product of both vectors' lengths over frequent terms. If that is less than an item's worst
    place, its list is complete. The items for which it isn't are multiplied with all others, block by
    block, so frequent terms never make rows of pairs. Ids are longs.

    If items share few distinct vectors (a class for every SHARED items or more), each class is ranked once,
    one place further, and its items take that list without themselves.
    """
    numbers = numbered_terms(weights)
    vectors = checkpointed(sparse(weights, "movieId", "w", numbers).select(F.col("movieId").cast("long").alias("item"), "t", unit(F.col("x")).alias("x"), F.lit(0.0).alias("static")))
    found = classes_of(vectors, ("t", "x"), min(CLASSES, vectors.count() // SHARED))
    if found is not None:
        keys, members = found
        lists = best_by_classes(keys.select(F.col("cls").alias("query"), "t", "x"), found, None, ("",), top_k + 1, None, positive=True)
        own = members.select(F.col("item").alias("movieId"), F.col("cls").alias("query")).join(lists.select("query", F.col("item").alias("otherId"), "score"), "query").where("movieId <> otherId")
        place = F.row_number().over(Window.partitionBy("movieId").orderBy(F.desc("score"), "otherId"))
        return own.withColumn("place", place).where(F.col("place") <= top_k).select("movieId", "otherId", "score", "place")
    df = weights.groupBy("term").agg(F.count("*").alias("df"))
    terms = numbers
    # Cosine: vectors of length 1, whatever they come as.
    length = weights.groupBy("movieId").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    rows = weights.join(df, "term").join(terms, "term").join(length, "movieId")
    rows = checkpointed(rows.select(F.col("movieId").cast("long").alias("item"), F.col("number").alias("t"), (F.col("w") / F.greatest("l", F.lit(1e-12))).alias("x"), (F.col("df") <= RARE).alias("rare")))
    packed = lambda some: some.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("v")).select("item", F.col("v.t").alias("t"), F.col("v.x").alias("x"))
    rare = rows.where("rare")
    frequent = checkpointed(packed(rows.where("not rare")))
    a, b = (rare.select(F.col("item").alias(s), "t", F.col("x").alias(f"x{s}")) for s in "ab")
    met = a.join(b, "t").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("met"))
    scored = sparse_products(met, frequent).select(F.col("a").alias("movieId"), F.col("b").alias("otherId"), F.round(F.col("met") + F.col("product"), 10).alias("score"))
    place = F.row_number().over(Window.partitionBy("movieId").orderBy(F.desc("score"), "otherId"))
    near = checkpointed(scored.withColumn("place", place).where(F.col("place") <= top_k))
    # The length of each item's frequent part, and the largest of all: a bound on what no rare term finds.
    unseen = rows.groupBy("item").agg(F.sqrt(F.sum(F.when(F.col("rare"), 0.0).otherwise(F.col("x") * F.col("x")))).alias("f"))
    most = unseen.agg(F.max("f").alias("most"))
    worst = near.where(F.col("place") == top_k).select(F.col("movieId").alias("item"), F.col("score").alias("worst"))
    open_ = unseen.crossJoin(F.broadcast(most)).join(worst, "item", "left").where(F.col("f") > 0).where(F.col("worst").isNull() | (F.col("f") * F.col("most") >= F.col("worst") - SLACK))
    open_ = checkpointed(open_.select("item"))
    everything = packed(rows)
    itself = open_.select(F.col("item").alias("query"), "item")
    rest = best_products(everything.join(open_, "item", "left_semi").withColumnRenamed("item", "query"), everything, top_k, itself, positive=True)
    rest = rest.select(F.col("query").alias("movieId"), F.col("item").alias("otherId"), "score", F.col("rank").alias("place"))
    return near.join(open_.withColumnRenamed("item", "movieId"), "movieId", "left_anti").unionByName(rest)
