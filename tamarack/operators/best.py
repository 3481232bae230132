"""The best items of every query (a user, a profile, an item), without a row for every pair.

Queries and items lie in blocks. A task multiplies one block of each and sends on only what the
question needs of the product, so it holds two blocks, and rows grow with queries times blocks of
items. Vectors are dense (column x) or sparse (columns t, ascending numbers of terms, and x).

best_products: blocks of items are in order of length, the longest first. All queries meet the first
block; what they find there bounds the blocks that can still add to it, as a product is at most the
product of both lengths. Lists of blocks are merged at the end.

best_hybrids: a weighted sum of parts that are scaled by their rank among a query's scores of all items.
A part that ranks items alike for all queries is scaled once, over the catalog. For the others each
block gives points of its distribution; together these bound every rank from both sides, and so the
sum. Items whose upper bound reaches the k-th best lower bound are candidates, of which blocks then
count the exact ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import flat, listed, whole_groups
from ..functions.vectors import dot, norm
from ..session import checkpointed

#: Queries and items of a block; queries multiplied at once.
QUERIES, ITEMS, AT_ONCE = 8192, 16384, 64
#: Components of a dense vector, of which a block of best_products() has ITEMS; of shorter ones it has more.
WIDTH = 64
#: Points of a block's distribution, and of all blocks' together.
POINTS, GRID = 64, 256
DIGITS, SLACK = 10, 1e-9
#: Values of a dense table of frequent terms, at most; a term's share of items, as 1 in so many, from which it lies there; items from which there is a table.
HEAD, OFTEN, HEAD_ITEMS = 1 << 24, 64, 1024
#: Ids that are sent to every task, at most.
LOOKED_UP = 1_000_000
LEAST = -1.7e308


def finite(x: Column) -> Column:
    """Scores as they are ranked: rounded, so that noise makes no difference; null and non-finite ones least."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(LEAST)).otherwise(F.round(x, DIGITS))


def catalog_scaled(items: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): the average rank of value among all items, scaled to 0 to 1; 0 if all are equal.

    Distinct values are counted in ranges, and ranges placed by their sizes, so no task sorts them all.
    """
    rows = items.select(key, finite(F.col(value)).alias("__v"))
    by = rows.groupBy("__v").agg(F.count("*").alias("__c"))
    parts = checkpointed(by.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()))  # ranges are drawn from a sample: keep them
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("__part").agg(F.sum("__c").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy()))  # a row for each range
    within = F.coalesce(F.sum("__c").over(Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    less = parts.withColumn("__less", within).join(F.broadcast(before), "__part")
    scaled = F.when(F.col("__c") == F.col("__all"), 0.0).otherwise((F.col("__before") + F.col("__less") + (F.col("__c") - 1) / 2.0) / F.greatest(F.col("__all") - 1, F.lit(1)))
    return rows.join(less.select("__v", scaled.alias(out)), "__v").select(key, out)


def sparse(weights: DataFrame, key: str, value: str, terms: DataFrame) -> DataFrame:
    """(key, t, x) of weights(key, term, value), by the numbers in terms(term, number)."""
    by = weights.join(terms, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("number").alias("t"), F.col(value).cast("double").alias("x")))).alias("v"))
    return by.select(key, F.col("v.t").alias("t"), F.col("v.x").alias("x"))


def numbered_terms(weights: DataFrame) -> DataFrame:
    from .prepare import dense_ids

    return checkpointed(dense_ids(weights, "term", start=0, out="number"))


class Products:
    """The products of queries with a block of items, some queries at a time.

    Sparse items lie by term. The most frequent terms, those of a share of the items or more, also lie in a dense table,
    as their products are cheaper than lists of items.
    """

    def __init__(self, items: pa.Table, queries: pa.Table | None, suffix: str = ""):
        self.sparse, self.n = "t" + suffix in items.column_names, items.num_rows
        values, ends = flat(items["x" + suffix])
        if self.sparse:
            terms = flat(items["t" + suffix])[0]
            self.known, code = np.unique(terms, return_inverse=True)
            self.code, self.rows, self.values = code.astype(np.int32), ends, values.astype(np.float64, copy=False)
            order = np.argsort(self.code, kind="stable")
            self.item = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends))
            self.x, self.row = self.values[order], self.item[order]
            size = np.bincount(self.code, minlength=len(self.known))
            self.start = np.concatenate([[0], np.cumsum(size)])
            often = np.argsort(-size, kind="stable")[: HEAD // max(1, self.n)]
            often = often[size[often] * OFTEN >= self.n] if self.n >= HEAD_ITEMS else often[:0]
            self.place = np.full(len(self.known), -1)
            self.place[often] = np.arange(len(often))
            self.head = np.zeros((len(often), self.n))
            for k, t in enumerate(often):
                some = slice(self.start[t], self.start[t + 1])
                self.head[k] = np.bincount(self.row[some], self.x[some], self.n)
            self.rest, self.above = int(size[self.place < 0].sum()), bool((self.values > 0).all())
            if queries is not None:
                own, self.ends = flat(queries["x" + suffix])
                own_terms = flat(queries["t" + suffix])[0]
                at = np.minimum(np.searchsorted(self.known, own_terms), max(len(self.known) - 1, 0))
                there = self.known[at] == own_terms if len(self.known) else np.zeros(len(own_terms), bool)
                self.own_codes, self.own = np.where(there, at, -1), own.astype(np.float64)
                self.above = self.above and bool((self.own > 0).all())  # then products are 0 only without a common term
        else:
            self.x = values.astype(np.float64).reshape(self.n, -1)
            if queries is not None:
                own, self.ends = flat(queries["x" + suffix])
                self.own = own.astype(np.float64).reshape(queries.num_rows, -1)

    def asked(self, lists: np.ndarray, ends: np.ndarray) -> None:
        """From now on the queries are sums of items: each the sum of a list of rows, of length 1."""
        size = self.rows[lists + 1] - self.rows[lists]
        at = np.arange(size.sum()) + np.repeat(self.rows[lists] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(lists) else np.zeros(0, np.int64)
        who = np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), size)
        pair, back = np.unique(who * max(len(self.known), 1) + self.code[at], return_inverse=True)
        own, of = np.bincount(back, self.values[at], len(pair)), pair // max(len(self.known), 1)
        length = np.sqrt(np.bincount(of, own * own, len(ends) - 1))
        self.own_codes, self.own = pair % max(len(self.known), 1), own / np.maximum(length[of], 1e-12)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ends) - 1))])

    def of(self, lo: int, hi: int, rounded: bool = True) -> np.ndarray:
        """[queries lo to hi, items]: products, rounded as they are ranked."""
        if not self.sparse:
            out = self.own[lo:hi] @ self.x.T
            return np.round(out, DIGITS) if rounded else out
        head = np.zeros((hi - lo, len(self.head)))
        rest = []
        for k in range(lo, hi):
            codes, own = self.own_codes[self.ends[k] : self.ends[k + 1]], self.own[self.ends[k] : self.ends[k + 1]]
            codes, own = codes[codes >= 0], own[codes >= 0]
            place = self.place[codes]
            np.add.at(head[k - lo], place[place >= 0], own[place >= 0])
            rest.append((codes[place < 0], own[place < 0]))
        out = head @ self.head if len(self.head) else np.zeros((hi - lo, self.n))
        for mine, (codes, own) in zip(out, rest, strict=True):
            left = self.start[codes]
            size = self.start[codes + 1] - left
            if 4 * size.sum() > self.rest:  # a query of frequent terms: all items' terms, looked up in the query's
                given = np.zeros(len(self.known))
                np.add.at(given, codes, own)
                mine += np.bincount(self.item, self.values * given[self.code], self.n)
            elif len(codes):
                at = np.arange(size.sum()) + np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                mine += np.bincount(self.row[at], self.x[at] * np.repeat(own, size), self.n)
        return np.round(out, DIGITS) if rounded else out

    def shared(self, k: int) -> np.ndarray:
        """Of sparse vectors: which items have a term of query k."""
        codes = self.own_codes[self.ends[k] : self.ends[k + 1]]
        out = np.zeros(self.n, bool)
        for t in codes[codes >= 0]:
            out[self.row[self.start[t] : self.start[t + 1]]] = True
        return out


def dealt(df: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """df in blocks of about `size` rows, numbered in the column `name`, by a hash of the key; and the number of blocks."""
    n = df.count()
    blocks = max(1, -(-n // size), min(df.sparkSession.sparkContext.defaultParallelism, n // 1024) if name == "b" else 1)
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks


def renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be cogrouped with what it was made from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def taking_part(seen: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of seen(query, item) of these queries and items, so that others don't move; ids are looked up in every task where they are few."""
    for side, key in ((items, "item"), (queries, "query")):
        ids = side.select(key)
        seen = seen.join(F.broadcast(ids) if ids.count() <= LOOKED_UP else ids, key, "left_semi")
    return seen


def seen_in_blocks(seen: DataFrame, items: DataFrame) -> DataFrame:
    """(query, c, seen): ids of the items of block c that the query leaves out; a list is no longer than a block."""
    return seen.select("query", "item").distinct().join(items.select("item", "c"), "item").groupBy("query", "c").agg(F.collect_list("item").alias("seen"))


def hidden(scores: np.ndarray, ids: np.ndarray, seen: np.ndarray, ends: np.ndarray, lo: int) -> np.ndarray:
    """scores with minus infinity where the item is left out; ids ascend."""
    for k in range(len(scores)):
        own = seen[ends[lo + k] : ends[lo + k + 1]]
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        scores[k, at[ids[at] == own]] = -np.inf
    return scores


def best_of_row(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest finite scores, ties to the first; all places with a score above the k-th are kept by a partition before the sort."""
    if len(score) > 4 * k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= limit)
        some = some[np.argsort(-score[some], kind="stable")][:k]
    else:
        some = np.argsort(-score, kind="stable")[:k]
    return some[np.isfinite(score[some])]


def best_products(queries: DataFrame, items: DataFrame, k: int = 10, seen: DataFrame | None = None, positive: bool = False) -> DataFrame:
    """(query, item, score, rank): the k items with the largest products, ties to the smaller item.

    queries(query, x or t and x), items(item, ...); ids are longs and not repeated. seen(query, item) are
    pairs to leave out. With `positive`, only products above 0. Queries without items give no rows.
    """
    from .prepare import dense_ids

    if "t" in items.columns:  # sparse vectors often are those of many items
        from .classes import best_by_classes, classes_of

        found = classes_of(items.select("item", F.lit(0.0).alias("static"), "t", "x"), ("t", "x"))
        if found is not None:
            return best_by_classes(queries.select("query", "t", "x"), found, None, ("",), k, seen, positive).select("query", "item", "score", "rank")
    sized = items.withColumn("__norm", norm(F.col("x")))
    place = dense_ids(sized, "item", start=0, order=F.struct((-F.col("__norm")).alias("l"), F.col("item").alias("i")), out="__place")
    width = 0 if "t" in items.columns else items.agg(F.max(F.size("x"))).first()[0] or 0
    size = ITEMS * max(1, WIDTH // width) if width > 0 else ITEMS
    items = checkpointed(sized.join(place, "item").withColumn("c", F.floor(F.col("__place") / size).cast("int")).drop("__place"))
    longest = np.array([r[1] for r in sorted(items.groupBy("c").agg(F.max("__norm")).collect())])  # one number for each block
    asked, _ = dealt(renewed(queries).withColumn("__own", norm(F.col("x"))), "query", QUERIES, "b")
    hide = seen_in_blocks(taking_part(seen, queries, items), items) if seen is not None else None
    sparse_ = "t" in items.columns

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("item")
        ids = right["item"].to_numpy()
        queries_, (hide_, ends) = left["query"].to_numpy(), flat(left["seen"])
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and len(queries_):
            made = Products(right, left)
            for lo in range(0, len(queries_), AT_ONCE):
                scores = hidden(made.of(lo, min(lo + AT_ONCE, len(queries_))), ids, hide_, ends, lo)
                if positive:
                    scores[scores <= 0] = -np.inf
                for row, q in zip(scores, queries_[lo:], strict=False):
                    best = best_of_row(row, k)
                    for col, own in zip(out, (np.full(len(best), q), ids[best], row[best]), strict=True):
                        col.append(own)
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(cols, ["query", "item", "score"])

    def multiplied(rows: DataFrame) -> DataFrame:
        rows = rows.join(hide, ["query", "c"], "left") if hide is not None else rows.withColumn("seen", F.array().cast("array<bigint>"))
        vector = ["t", "x"] if sparse_ else ["x"]
        need = rows.select((F.col("b") + 0).alias("b"), (F.col("c") + 0).alias("c")).distinct()  # columns of their own
        right = items.join(need, "c").select("b", "c", "item", *vector)
        return rows.select("b", "c", "query", "seen", *vector).groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(product, "query long, item long, score double")

    def ranked(lists: DataFrame) -> DataFrame:
        return lists.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)

    first = checkpointed(multiplied(asked.withColumn("c", F.lit(0))))
    if len(longest) < 2:
        return ranked(first)
    reached = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("limit"))
    shared = queries.sparkSession.sparkContext.broadcast(-longest)

    def blocks_left(limit: pd.Series, own: pd.Series) -> pd.Series:
        """Blocks whose longest item may still reach the limit; all where there is none."""
        least = (limit - SLACK) / own.clip(lower=1e-300)
        return pd.Series(np.where(least.isna(), len(shared.value), np.searchsorted(shared.value, -least.to_numpy(np.float64, na_value=0), "right"))).astype("int32")

    blocks_left.__annotations__ = {"limit": pd.Series, "own": pd.Series, "return": pd.Series}
    more = asked.join(reached, "query", "left").withColumn("n", F.pandas_udf(blocks_left, "int")("limit", "__own")).where("n > 1")
    rest = multiplied(more.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("n") - 1))))
    return ranked(first.union(rest))


# --- hybrids ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """A part of the sum with a score for each pair: its weight, and what the names of its vector columns end in."""

    weight: float
    suffix: str = ""


def points(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some values of a block's scores, with the numbers of scores below them, and not above them."""
    own = np.sort(scores)
    value = np.unique(own[np.unique(np.linspace(0, len(own) - 1, POINTS).astype(np.int64))])
    return value, np.searchsorted(own, value, "left"), np.searchsorted(own, value, "right")


def bounds(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """[5, GRID]: values of all blocks' points and, for each, bounds of the numbers of scores: at least below, at least not above, at most below, at most not above."""
    value = np.unique(np.concatenate([b[0] for b in blocks]))
    value = value[np.unique(np.linspace(0, len(value) - 1, GRID).astype(np.int64))]
    out = np.zeros((5, len(value)))
    out[0] = value
    for own, below, upto, n in blocks:
        at = np.searchsorted(own, value, "right") - 1  # the last point not above
        same = (at >= 0) & (own[np.maximum(at, 0)] == value)
        known = np.where(at >= 0, upto[np.maximum(at, 0)], 0)
        after = np.minimum(at + 1, len(own) - 1)
        most = np.where(at + 1 < len(own), below[after], n)
        out[1] += np.where(same, below[np.maximum(at, 0)], known)
        out[2] += known
        out[3] += np.where(same, below[np.maximum(at, 0)], most)
        out[4] += np.where(same, known, most)
    return out


def rank_bounds(scores: np.ndarray, grid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scaled average rank of each score among n."""
    value, least_below, least_upto, most_below, most_upto = grid
    if value[0] == value[-1] and least_upto[0] >= n:  # all are equal
        return np.zeros(len(scores)), np.zeros(len(scores))
    at = np.searchsorted(value, scores, "right") - 1
    low, high = np.maximum(at, 0), np.minimum(at + 1, len(value) - 1)
    same = (at >= 0) & (value[low] == scores)
    # Twice the average rank from 0 is the number below plus the number not above, less 1.
    lo = np.where(same, least_below[low] + least_upto[low], np.where(at >= 0, 2 * least_upto[low] + 1, 1)) - 1
    hi = np.where(same, most_below[low] + most_upto[low], np.where(at + 1 < len(value), 2 * most_below[high], 2 * n)) - 1
    return np.maximum(lo, 0) / (2 * max(n - 1, 1)), np.minimum(hi, 2 * (n - 1)) / (2 * max(n - 1, 1))


def every(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def multiplied(rows: DataFrame, right: DataFrame, item_blocks: int, run, schema: str) -> DataFrame:
    """What run(queries, items) makes of each block of queries rows(b, ...) with each block of items right(b, c, ...)."""
    return rows.withColumn("c", every(item_blocks)).groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(run, schema)


def by_query(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query").sortWithinPartitions("query")


def each(left: pa.Table, right: pa.Table, suffixes: Sequence[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each query's place and its products, an array for each part."""
    if left.num_rows and right.num_rows:
        made = [Products(right, left, s) for s in suffixes]
        for lo in range(0, left.num_rows, AT_ONCE):
            scores = [m.of(lo, min(lo + AT_ONCE, left.num_rows)) for m in made]
            for i in range(len(scores[0])):
                yield lo + i, [s[i] for s in scores]


def rank_counts(rows: DataFrame, right: DataFrame, item_blocks: int, suffixes: Sequence[str]) -> DataFrame:
    """(query, below, upto): for each of a query's candidates, and each part, how many of its products are less, and not more.

    rows(b, query, vectors, raws): raws has the candidates' products, a candidate's parts one after the other.
    """
    count = len(suffixes)

    def counts(left: pa.Table, right: pa.Table) -> pa.Table:
        (raw, ends), query = flat(left["raws"]), left["query"].to_numpy()
        below, upto, who, size = [], [], [], []
        for i, scores in each(left, right, suffixes):
            own = raw[ends[i] : ends[i + 1]].reshape(-1, count).T
            for want, have in zip(own, scores, strict=True):
                order = np.sort(have)
                below.append(np.searchsorted(order, want, "left"))
                upto.append(np.searchsorted(order, want, "right"))
            who.append(query[i])
            size.append(own.size)
        cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.table([pa.array(who, pa.int64()), *[listed(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64), cuts) for x in (below, upto)]], ["query", "below", "upto"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of all blocks, by candidate and part."""
        for group in whole_groups(batches):
            sums = [flat(group.column(c))[0].reshape(group.num_rows, -1).sum(axis=0).reshape(count, -1).T for c in (1, 2)]
            lists = [pa.array([s.tolist()], pa.list_(pa.list_(pa.int64()))) for s in sums]
            yield pa.RecordBatch.from_arrays([group.column(0).slice(0, 1), *lists], ["query", "below", "upto"])

    found = multiplied(rows, right, item_blocks, counts, "query long, below array<long>, upto array<long>")
    return by_query(found).mapInArrow(added, "query long, below array<array<long>>, upto array<array<long>>")


def scaled_rank(below: Column, upto: Column, n: int) -> Column:
    """The average rank from 0, over n - 1; 0 if all n scores are equal."""
    return F.when(upto - below == n, F.lit(0.0)).otherwise((below + upto - 1) / (2.0 * max(n - 1, 1)))


def pair_ranks(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query, item, product, scaled) of pairs(query, item), each once: scaled is the product's average rank among the query's products with all items, 0 to 1.

    queries(query, x) and items(item, x) are dense; pairs without a vector on either side are left out.
    """
    items, item_blocks = dealt(items.select("item", "x"), "item", ITEMS, "c")
    items = checkpointed(items)
    n = items.count()
    asked, query_blocks = dealt(renewed(queries.select("query", "x")), "query", QUERIES, "b")
    asked = checkpointed(asked)
    product = F.round(dot(F.col("p"), F.col("q")), DIGITS)
    rows = pairs.join(asked.select("query", F.col("x").alias("p")), "query").join(items.select("item", F.col("x").alias("q")), "item").select("query", "item", product.alias("raw"))
    chosen = checkpointed(rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("item", "raw"))).alias("chosen")))
    sums = rank_counts(asked.join(chosen.select("query", F.col("chosen.raw").alias("raws")), "query"), items.withColumn("b", every(query_blocks)), item_blocks, ("",))
    zipped = chosen.join(sums, "query").select("query", F.explode(F.arrays_zip("chosen", "below", "upto")).alias("z"))
    return zipped.select("query", "z.chosen.item", F.col("z.chosen.raw").alias("product"), scaled_rank(F.col("z.below")[0], F.col("z.upto")[0], n).alias("scaled"))


def best_hybrids(queries: DataFrame, items: DataFrame, parts: Sequence[Part] = (Part(1.0),), k: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """(query, item, score, rank, raw, scaled): the k items with the largest sums, ties to the smaller item.

    items(item, static, and vectors): static is the sum of what does not depend on the query. Each part
    adds its weight times the average rank, scaled to 0 to 1, of an item's product among the query's
    products with all items (0 if all are equal). raw and scaled are arrays, one value for each part:
    products, and scaled ranks. Null vectors give products of 0. seen(query, item) are left out of the
    result, but not of the ranks. Ids are longs and not repeated.
    """
    from .classes import best_by_classes, classes_of

    columns = [c for p in parts for c in ("t" + p.suffix, "x" + p.suffix) if c in items.columns]
    found = classes_of(items.select("item", F.coalesce("static", F.lit(0.0)).cast("double").alias("static"), *columns), columns)
    if found is not None:
        return best_by_classes(queries.select("query", *columns), found, [p.weight for p in parts], [p.suffix for p in parts], k, seen)
    items, item_blocks = dealt(items.select("item", F.coalesce("static", F.lit(0.0)).cast("double").alias("static"), *columns), "item", ITEMS, "c")
    items = checkpointed(items)
    n = items.count()
    asked, query_blocks = dealt(renewed(queries.select("query", *columns)), "query", QUERIES, "b")
    asked = checkpointed(asked)
    right = items.withColumn("b", every(query_blocks))
    suffixes, weights, count = [p.suffix for p in parts], [p.weight for p in parts], len(parts)

    def summary(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"query": [], "part": [], "value": [], "below": [], "upto": [], "n": []}
        query = left["query"].to_numpy()
        for i, scores in each(left, right, suffixes):
            for part, own in enumerate(scores):
                for name, v in zip(rows, (query[i], part, *points(own), len(own)), strict=True):
                    rows[name].append(v)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        return pa.table([pa.array(v, kind) for v, kind in zip(rows.values(), kinds, strict=True)], list(rows))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The grids of a query's parts, one after the other in one array."""
        for group in whole_groups(batches):
            part = group.column(1).to_numpy()
            value, below, upto = (flat(group.column(c)) for c in (2, 3, 4))
            total, grids = group.column(5).to_numpy(), []
            for p in range(count):
                own = [(value[0][value[1][i] : value[1][i + 1]], below[0][value[1][i] : value[1][i + 1]], upto[0][value[1][i] : value[1][i + 1]], int(total[i])) for i in np.flatnonzero(part == p)]
                grid = bounds(own)
                grids.append(np.concatenate([[grid.shape[1]], grid.ravel()]))
            yield pa.RecordBatch.from_arrays([group.column(0).slice(0, 1), pa.array([np.concatenate(grids)])], ["query", "grid"])

    made = multiplied(asked, right, item_blocks, summary, "query long, part int, value array<double>, below array<long>, upto array<long>, n long")
    grids = checkpointed(by_query(made).mapInArrow(together, "query long, grid array<double>"))

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("item")
        ids, static = right["item"].to_numpy(), right["static"].to_numpy()
        query, (hide, ends), (grid, starts) = left["query"].to_numpy(), flat(left["seen"]), flat(left["grid"])
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for i, scores in each(left, right, suffixes):
            lo, hi, at = static.copy(), static.copy(), starts[i]
            for own, weight in zip(scores, weights, strict=True):
                size = int(grid[at])
                a, b = rank_bounds(own, grid[at + 1 : at + 1 + 5 * size].reshape(5, size), n)
                lo, hi, at = lo + weight * a, hi + weight * b, at + 1 + 5 * size
            lo = hidden(lo[None], ids, hide, ends, i)[0]
            least = np.partition(lo, len(lo) - k)[len(lo) - k] if len(lo) > k else -np.inf
            some = np.flatnonzero(np.isfinite(lo) & (hi >= least - SLACK))
            for col, own in zip(out, (np.full(len(some), query[i]), ids[some], static[some], lo[some], hi[some], np.stack(scores)[:, some].T.ravel()), strict=True):
                col.append(own)
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, *[np.float64] * 4), strict=True)]
        return pa.table([*map(pa.array, cols[:5]), listed(cols[5], np.arange(len(cols[0]) + 1) * count)], ["query", "item", "static", "lo", "hi", "raw"])

    rows = asked.withColumn("c", every(item_blocks))
    hide = seen_in_blocks(seen, items) if seen is not None else None
    rows = rows.join(hide, ["query", "c"], "left") if hide is not None else rows.withColumn("seen", F.array().cast("array<bigint>"))
    found = rows.join(grids, "query").groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(candidates, "query long, item long, static double, lo double, hi double, raw array<double>")
    found = checkpointed(found)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lo")))
    limit = found.select("query", "lo", place.alias("place")).where(F.col("place") == k).select("query", F.col("lo").alias("limit"))
    kept = found.join(limit, "query", "left").where(F.col("limit").isNull() | (F.col("hi") >= F.col("limit") - SLACK))
    chosen = checkpointed(kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("item", "static", "raw"))).alias("chosen")))

    sums = rank_counts(asked.join(chosen.select("query", F.flatten("chosen.raw").alias("raws")), "query"), right, item_blocks, suffixes)
    zipped = F.explode(F.arrays_zip("chosen", "below", "upto")).alias("z")
    rows = chosen.join(sums, "query").select("query", zipped).select("query", "z.chosen.*", "z.below", "z.upto")
    rows = rows.withColumn("scaled", F.zip_with("below", "upto", lambda a, b: scaled_rank(a, b, n)))
    total = F.col("static")
    for i, w in enumerate(weights):
        total = total + w * F.col("scaled")[i]
    rows = rows.withColumn("score", F.round(total, DIGITS))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k).select("query", "item", "score", "rank", "raw", "scaled")
