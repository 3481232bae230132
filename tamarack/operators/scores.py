"""Popularity, biases, factor models, graph propagation, losses and negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import flat, starts, summed_vectors, whole_groups
from ..functions.text import clipped
from ..functions.vectors import dot


def movie_scores(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(F.avg("rating").alias("mean"), F.count("*").alias("n"))


def popularity(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """movieId, popularity: (mean / 5) ln(1 + n) / ln(1 + largest n); 0 for unrated movies."""
    scored = movie_scores(ratings)
    top = scored.agg(F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("top"))
    rows = movies.select("movieId").join(scored, "movieId", "left").crossJoin(F.broadcast(top))
    return rows.select("movieId", F.coalesce(F.col("mean") / 5 * F.log1p("n") / F.log1p("top"), F.lit(0.0)).alias("popularity"))


def global_mean(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.coalesce(F.avg("rating"), F.lit(3.0)).alias("mu"))


def shrunk_bias(ratings: DataFrame, key: str, shrinkage: float = 5.0) -> DataFrame:
    """(key, bias): (mean - overall mean) n / (n + shrinkage)."""
    by = ratings.groupBy(key).agg(F.avg("rating").alias("mean"), F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(global_mean(ratings))).select(key, ((F.col("mean") - F.col("mu")) * F.col("n") / (F.col("n") + shrinkage)).alias("bias"))


def known_pairs(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return ratings.join(users, "userId", "left_semi").join(items, "movieId", "left_semi")


def predict(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame, user_bias: DataFrame, item_bias: DataFrame, mu: Column) -> DataFrame:
    """pairs with `prediction` = mu + b_u + b_i + p q, clipped; missing biases and factors count as 0.

    Bias and factors of a side are put together first, so that pairs move once for users and once for items.
    """
    side = lambda bias, factors, key, b, x: bias.withColumnRenamed("bias", b).join(factors.withColumnRenamed("factors", x), key, "full")
    rows = pairs.join(side(user_bias, user_factors, "userId", "bu", "p"), "userId", "left").join(side(item_bias, item_factors, "movieId", "bi", "q"), "movieId", "left")
    raw = mu + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0)) + F.coalesce(dot(F.col("p"), F.col("q")), F.lit(0.0))
    return rows.withColumn("prediction", clipped(raw)).drop("bu", "bi", "p", "q")


def predict_by_bias(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """pairs(userId, movieId, ...) with `prediction`: 3.0 for an item without ratings in train, else mean and biases, a user's if there is one, clipped."""
    bu, bi = (shrunk_bias(train, key).withColumnRenamed("bias", name) for key, name in (("userId", "bu"), ("movieId", "bi")))
    rows = pairs.join(bu, "userId", "left").join(bi, "movieId", "left").crossJoin(F.broadcast(global_mean(train)))
    known = clipped(F.col("mu") + F.coalesce("bu", F.lit(0.0)) + F.col("bi"))
    return rows.withColumn("prediction", F.when(F.col("bi").isNull(), 3.0).otherwise(known)).drop("bu", "bi", "mu")


def mean_profile(user_factors: DataFrame) -> DataFrame:
    """One row, `factors`: the mean vector of all users, as a guest's."""
    by = user_factors.select(F.posexplode("factors").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("factors"))  # as many rows as dimensions


def normalized_edges(pairs: DataFrame) -> DataFrame:
    """src, dst, w of both directions of user-item pairs: 1 / sqrt(degree degree), repeated pairs summed."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    one = pairs.select(node("u", "userId").alias("src"), node("i", "movieId").alias("dst"))
    both = one.union(one.select("dst", "src"))
    degree = both.groupBy("src").agg(F.greatest(F.count("*"), F.lit(1)).alias("d"))
    rows = both.groupBy("src", "dst").agg(F.count("*").alias("k"))
    rows = rows.join(degree, "src").join(degree.withColumnsRenamed({"src": "dst", "d": "e"}), "dst")
    return rows.select("src", "dst", (F.col("k") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def propagate(edges: DataFrame, vectors: DataFrame, width: int, layers: int = 2) -> DataFrame:
    """(node, x): mean of x0 and of `layers` rounds of x <- A x, from vectors(node, x) of `width` components; a missing vector counts as zero."""
    from ..session import checkpointed

    edges = checkpointed(edges)  # every layer meets them
    now = total = vectors.select("node", "x")
    for _ in range(layers):
        met = edges.join(now, edges.dst == now.node).select(F.col("src").alias("node"), "w", "x")
        now = checkpointed(summed_vectors(met, "node", F.col("w"), "x", width))
        total = total.union(now)
    return summed_vectors(total, "node", F.lit(1.0 / (layers + 1)), "x", width)


#: Vectors that a task of pair_scores() holds.
VECTORS = 150_000


def pair_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(userId, movieId) with `score`: the product of the vectors(node, x) of both nodes; pairs without one of them are left out.

    Items are dealt into blocks. A user's vector moves once to each block that has items of the user, with a list of them,
    so no vector moves for each pair; a task holds a block's vectors, and users stream past them.
    """
    side = lambda kind, key: vectors.where(F.col("node").startswith(kind)).select(F.substring("node", 2, 20).cast("long").alias(key), F.col("x").cast("array<double>").alias("x"))
    users, items = side("u", "userId"), side("i", "movieId")
    blocks = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, -(-items.count() // VECTORS))
    block = F.pmod(F.xxhash64(F.col("movieId").cast("long")), F.lit(blocks)).cast("int").alias("c")
    lists = pairs.select("userId", "movieId").where("userId is not null and movieId is not null").repartition("userId").distinct().groupBy("userId", block).agg(F.collect_list(F.col("movieId").cast("long")).alias("m"))
    held = items.select(block, F.lit(0).alias("kind"), F.col("movieId").alias("id"), "x", F.array().cast("array<bigint>").alias("m"))
    rows = held.union(lists.join(users, "userId").select("c", F.lit(1).alias("kind"), F.col("userId").cast("long").alias("id"), "x", "m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, q = None, [], np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = starts(batch, 2)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                some = batch.slice(lo, hi - lo)
                c, kind, own = some.column(0)[0].as_py(), some.column(1)[0].as_py(), some.column(2).to_numpy()
                if c != now:
                    now, held, ids = c, [], np.zeros(0, np.int64)
                x = flat(some.column(3))[0].reshape(len(own), -1)
                if kind == 0:
                    held.append((own, x))
                    continue
                if held:  # the block is complete
                    ids, q = (np.concatenate(z) for z in zip(*held, strict=True))
                    order = np.argsort(ids)
                    ids, q, held = ids[order], q[order], []
                item, ends = flat(some.column(4))
                at = np.minimum(np.searchsorted(ids, item), max(len(ids) - 1, 0))
                there = np.flatnonzero(ids[at] == item) if len(ids) else np.zeros(0, np.int64)
                who = np.repeat(np.arange(len(own)), np.diff(ends))[there]
                yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(item[there]), pa.array(np.einsum("ij,ij->i", x[who], q[at[there]]) if len(there) else np.zeros(0))], ["userId", "movieId", "score"])

    return rows.repartition(4 * blocks, "c").sortWithinPartitions("c", "kind").mapInArrow(run, "userId long, movieId long, score double")


def products_within(users: DataFrame, items: DataFrame, by: str, block: int = 2048, digits: int = 6) -> DataFrame:
    """(userId, movieId, score): the rounded product of each of users(userId, by, x) with each of items(movieId, by, x) of the same value of `by`.

    Every pair is a result. Each value's rows are dealt into blocks, and a task multiplies two blocks at a time, so a
    frequent value is spread over many tasks. Vectors move as they come, a few times each: once for each block of the
    other side. Vectors of different length, or that hold a null, have a null product.
    """
    counts = users.groupBy(by).agg(F.count("*").alias("n")).union(items.groupBy(by).agg(F.count("*").alias("n"))).groupBy(by).agg(F.ceil(F.max("n") / block).cast("int").alias("blocks"))
    whole = F.when(~F.exists("x", lambda v: v.isNull()), F.col("x"))
    own = lambda df, key, at, to: df.join(counts, by).select(F.col(key).cast("long").alias(key), by, whole.alias("x"), F.pmod(F.xxhash64(key), "blocks").cast("int").alias(at), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(to))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left["userId"].to_numpy(), right["movieId"].to_numpy()
        score = np.full((len(ids), len(others)), np.nan)
        if score.size:
            (a, at), (b, bt) = flat(left["x"]), flat(right["x"])
            m, n = ([None if x is None else len(x) for x in side["x"].to_pylist()] if side["x"].null_count else np.diff(ends) for side, ends in ((left, at), (right, bt)))
            m, n = np.array(m, float), np.array(n, float)  # a null vector has no length
            for size in np.intersect1d(m[m == m], n[n == n]).astype(int):
                i, j = np.flatnonzero(m == size), np.flatnonzero(n == size)
                score[np.ix_(i, j)] = a[at[i][:, None] + np.arange(size)].astype(np.float64) @ b[bt[j][:, None] + np.arange(size)].astype(np.float64).T
        flat_score = np.round(score, digits).ravel()
        return pa.table([np.repeat(ids, len(others)), np.tile(others, len(ids)), pa.array(flat_score, mask=np.isnan(flat_score))], ["userId", "movieId", "score"])

    return own(users, "userId", "b", "c").groupBy(by, "b", "c").cogroup(own(items, "movieId", "c", "b").groupBy(by, "b", "c")).applyInArrow(product, "userId long, movieId long, score double")


def bpr_loss(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(-F.log(1 / (1 + F.exp(F.col("neg") - F.col("pos"))) + 1e-12)).alias("bpr_loss"))


def warp_loss(scores: DataFrame, margin: float = 1.0) -> DataFrame:
    return scores.agg(F.avg(F.greatest(F.lit(0.0), margin - F.col("pos") + F.col("neg")) * F.col("weight")).alias("warp_loss"))


def _numbered(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(movieId, dense_id): items with dense numbers from 0; one row, `n`: how many there are."""
    from .prepare import dense_ids

    numbered = dense_ids(items.select("movieId").distinct(), "movieId", start=0)
    return numbered, numbered.agg(F.count("*").alias("n"))


#: Pairs of a user whose draws are looked up together.
PAIRS = 65_536


def drawn_negatives(positives: DataFrame, items: DataFrame, draws: Column, score: DataFrame | None = None, margin: float = float("inf")) -> DataFrame:
    """positives(userId, movieId) with `negative`, `weight`: the first of `draws`, an array of hashes, whose item violates the margin; none: the last with weight 0.

    A draw is taken modulo the number of items that are no positive of the user, and stands for the item in that place
    (from 0) among them: the k-th free number is k plus the positives before it, those whose number less their place among
    the user's positives is k or less. A user's pairs and scores move to one task once, as a few numbers each; draws are made
    and tried there, so that nothing moves for each draw. Users without free items are left out.
    """
    kind = positives.schema["userId"].dataType.simpleString(), positives.schema["movieId"].dataType.simpleString()
    numbered, total = _numbered(items)
    rows = positives.where(F.col("userId").isNotNull()).select("userId", "movieId").distinct().withColumn("positive", F.lit(True))
    if score is not None:
        rows = rows.join(score.where(F.col("userId").isNotNull()).groupBy("userId", "movieId").agg(F.max("score").cast("double").alias("score")), ["userId", "movieId"], "full")
    rows = rows.select("userId", "movieId", F.coalesce("positive", F.lit(False)).alias("positive"), (F.coalesce("score", F.lit(0.0)) if score is not None else F.lit(0.0)).alias("score"))
    rows = rows.join(numbered, "movieId", "left").select("userId", "movieId", "positive", "score", F.coalesce("dense_id", F.lit(-1)).cast("long").alias("number"))
    rows = rows.repartition("userId").crossJoin(F.broadcast(total)).sortWithinPartitions("userId", "number").select("*", F.when(F.col("positive"), draws).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches):
            positive, own_score, number = (group.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            own, rated = number[positive & (number >= 0)], np.flatnonzero(number >= 0)
            free = group.column(5)[0].as_py() - len(own)
            if free <= 0:
                continue
            shift, known = own - np.arange(len(own)), number[rated]  # both ascend
            at = np.flatnonzero(positive)
            for lo in range(0, len(at), PAIRS):
                mine = at[lo : lo + PAIRS]
                asked = group.take(pa.array(mine))
                place = flat(asked.column(6))[0].reshape(len(mine), -1) % free
                found = place + np.searchsorted(shift, place, side="right")
                near = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                other = np.where(known[near] == found, own_score[rated][near], 0.0) if len(known) else np.zeros(found.shape)
                hit = ~(margin - own_score[mine][:, None] + other <= 0)  # NaN is above all
                first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)  # -1: the last
                weight = np.where(first < 0, 0.0, np.log(1 + np.maximum(1.0, np.floor((free - 1) / (first + 1.0 + (first < 0))))))
                yield pa.RecordBatch.from_arrays([asked.column(0), asked.column(1), pa.array(found[np.arange(len(mine)), first]), pa.array(weight)], ["userId", "movieId", "dense_id", "weight"])

    out = rows.mapInArrow(run, f"userId {kind[0]}, movieId {kind[1]}, dense_id long, weight double")
    return out.join(numbered.withColumnRenamed("movieId", "negative"), "dense_id").select("userId", "movieId", "negative", "weight")


def sampled_negatives(positives: DataFrame, items: DataFrame, seed: int = 42) -> DataFrame:
    """positives with `negative`: an item that its user has no positive for, drawn evenly by a hash of the pair.

    Only pairs of users who have every item as a positive are left out: they have no negative.
    """
    return drawn_negatives(positives, items, F.array(F.xxhash64("userId", "movieId", F.lit(seed)))).drop("weight")


def warp_negatives(positives: DataFrame, items: DataFrame, score: DataFrame, margin: float = 1.0, trials: int = 20, seed: int = 42) -> DataFrame:
    """userId, movieId, negative, weight: the first of `trials` drawn negatives that violates the margin; none: the last with weight 0.

    score(userId, movieId, score) gives the scores of pairs; missing ones count as 0. Draws are even
    among the items that the user has no positive for; users without such items are left out.
    """
    draws = F.transform(F.sequence(F.lit(1), F.lit(trials)), lambda d: F.xxhash64("userId", "movieId", d, F.lit(seed)))
    return drawn_negatives(positives, items, draws, score, margin)
