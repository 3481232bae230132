"""The search for hybrid weights: components once, all weights in one pass over them, and a report of the winner."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import flat, whole_groups
from ..session import checkpointed
from . import best, classes
from .content import histories, item_vectors
from .evaluate import METRICS, averaged, rating_errors, relevant, user_metrics, with_segments
from .rank import hybrid, scaled_catalog, top_k
from .scores import predict_by_bias
from .split import segments

#: The weights that are tried for each component, and the order in which means decide.
COLLABORATIVE, CONTENT, POPULARITY = (0.30, 0.45, 0.55, 0.65, 0.75), (0.15, 0.25, 0.35, 0.45, 0.55), (0.0, 0.05, 0.10, 0.15, 0.20)
DECIDE = ("ndcg", "mrr", "recall", "precision")
#: Items of a user that are scored together, and decimals of weights, means and scores.
BLOCK, WEIGHT_DIGITS, MEAN_DIGITS, DIGITS = 65_536, 12, 9, 10


def candidate_weights() -> list[tuple[float, float, float]]:
    """Distinct triples in order, each divided by its sum."""
    return sorted({tuple(round(x / (a + b + c), WEIGHT_DIGITS) for x in (a, b, c)) for a in COLLABORATIVE for b in CONTENT for c in POPULARITY})


def ranked_by_all(components: DataFrame, weights: Sequence[tuple[float, float, float]], k: int = 10) -> DataFrame:
    """(w, userId, movieId, rank): the k best of components(userId, movieId, cf, content, pop) under weights number w, ties to the smaller item.

    A user's items come in blocks, are scored under all weights at once, and only the k best of a block go on.
    """
    grid = np.array(weights, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, 2):
            item = group.column(2).to_numpy()
            parts = [group.column(c).to_numpy()[:, None] for c in (3, 4, 5)]
            score = np.round(sum(p * grid[:, i] for i, p in enumerate(parts)), DIGITS)
            for w in range(len(grid)):
                best = np.argsort(-score[:, w], kind="stable")[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), w, np.int32)), group.column(0).slice(0, 1).take(pa.array(np.zeros(len(best), np.int64))), pa.array(item[best]), pa.array(score[best, w])], ["w", "userId", "movieId", "score"])

    rows = components.select(F.col("userId").cast("long"), F.pmod(F.xxhash64("movieId"), F.ceil(F.lit(components.select("movieId").distinct().count() / BLOCK))).cast("int").alias("b"), F.col("movieId").cast("long"), *[F.col(c).cast("double") for c in ("cf", "content", "pop")])
    lists = rows.repartition("userId", "b").sortWithinPartitions("userId", "b", "movieId").mapInArrow(run, "w int, userId long, movieId long, score double")
    place = F.row_number().over(Window.partitionBy("w", "userId").orderBy(F.desc("score"), "movieId"))
    return lists.withColumn("rank", place).where(F.col("rank") <= k).drop("score")


def tried(components: DataFrame, truth: DataFrame, weights: Sequence[tuple[float, float, float]], k: int = 10) -> DataFrame:
    """(a, b, c, users, precision, recall, ndcg, mrr): means over the users of truth(userId, movieId), for every triple, those without a hit too."""
    spark = components.sparkSession
    grid = spark.createDataFrame([(w, *map(float, t)) for w, t in enumerate(weights)], "w int, a double, b double, c double")
    each = lambda df: df.withColumn("userId", F.struct("w", "userId")).drop("w")  # noqa: E731  metrics are by user: here by weights and user
    by = user_metrics(each(ranked_by_all(components, weights, k)), each(truth.select("userId", "movieId").crossJoin(F.broadcast(grid.select("w")))), k)
    means = averaged(by.withColumn("w", F.col("userId.w")), by=("w",))
    return grid.join(means, "w", "left").drop("w").fillna(0, ["users", *METRICS])


def best_weights(results: DataFrame) -> DataFrame:
    """The row that wins by DECIDE, one after the other; ties to the first weights in order."""
    return results.orderBy(*[F.round(m, MEAN_DIGITS).desc() for m in DECIDE], "a", "b", "c").limit(1)


def tune(components: DataFrame, train: DataFrame, validation: DataFrame, test: DataFrame, weights: Sequence[tuple[float, float, float]] | None = None, k: int = 10, threshold: float = 4.0) -> DataFrame:
    """One row: the winning weights a, b, c, their means on validation, and on test for all, warm and cold items, and the test's rmse.

    components(userId, movieId, cf, content, pop) are those of the users to be measured, from train, scaled
    over the whole catalog; they are kept once and serve every triple and both holdouts. Items of train are left out of a user's ranking.
    Users of a holdout are those that have components. rmse is that of ratings predicted by biases.
    """
    unseen = checkpointed(components.join(train.select("userId", "movieId").distinct(), ["userId", "movieId"], "left_anti"))
    users = checkpointed(components.select("userId").distinct())
    own = lambda holdout: relevant(holdout, threshold).join(users, "userId", "left_semi")
    winner = checkpointed(best_weights(tried(unseen, own(validation), weights or candidate_weights(), k)))
    row = winner.first()
    if row is None:
        return winner
    return report(winner, top_k(hybrid(unseen, (row.a, row.b, row.c)), k), own(test), train, test, k)


def report(winner: DataFrame, ranked: DataFrame, truth: DataFrame, train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """The row of tune(), from the winner's row and its ranked(userId, movieId, rank) for the users of truth."""
    measured = averaged(user_metrics(ranked, with_segments(segments(truth, train)), k, extra=("segment",)), by=("segment",))
    wide = measured.agg(*[F.coalesce(F.max(F.when(F.col("segment") == s, F.col(m))), F.lit(0.0)).alias(f"{name}_{m}") for s, name in (("all", "test"), ("warm", "warm"), ("cold", "cold")) for m in METRICS])
    error = rating_errors(predict_by_bias(test, train)).select(F.col("rmse").alias("test_rmse"))
    return winner.select("a", "b", "c", *[F.col(m).alias(f"validation_{m}") for m in METRICS]).crossJoin(wide).crossJoin(error)


def corners(grid: np.ndarray) -> np.ndarray:
    """Points whose mixtures include all weights: those of a box around them, in a plane if all have the same sum."""
    low, high = grid.min(axis=0), grid.max(axis=0)
    ends = [(x, y) for x in (low[1], high[1]) for y in (low[2], high[2])]
    if np.ptp(grid.sum(axis=1)) < best.SLACK:
        return np.array([(grid[0].sum() - x - y, x, y) for x, y in ends])
    return np.array([(a, x, y) for a in (low[0], high[0]) for x, y in ends])


def in_question(parts: np.ndarray, edges: np.ndarray, hidden: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, of all items that may be among the k best of parts[3, items] without the hidden ones, under some mixture of the edges.

    The k best under the mean of the edges all beat an item under every mixture if the least of them does at each edge.
    """
    score = edges @ parts
    score[:, hidden] = -np.inf
    left = score.shape[1] - len(hidden)
    if left > k:
        middle = score.mean(axis=0)
        first = np.argpartition(middle, len(middle) - k)[len(middle) - k :]
        return np.flatnonzero((score >= score[:, first].min(axis=1)[:, None] - best.SLACK).any(axis=0))
    return np.flatnonzero(np.isfinite(score[0]))


#: Weights that are tried together; the fewer, the closer their box.
TOGETHER = 16


def tried_by_history(queries: DataFrame, found: tuple[DataFrame, DataFrame], weights: Sequence[tuple[float, float, float]], k: int = 10) -> DataFrame:
    """tried() for classes.listed_queries() with `wanted`, the number of a query's true items, and `truth`, their ids; found has items with scaled cf and pop.

    Every user's whole catalog is scored in the task that holds its classes, and only sums by weights leave it.
    """
    spark = queries.sparkSession
    tries = np.array(weights, np.float64)
    order = np.lexsort((tries[:, 2], tries[:, 1]))
    groups = [np.sort(order[i : i + TOGETHER]) for i in range(0, len(order), TOGETHER)]
    keys, members = found
    lists = members.groupBy("cls").agg(F.collect_list(F.struct(F.col("item").alias("item"), F.col("cf").cast("double").alias("cf"), F.col("pop").cast("double").alias("pop"))).alias("m"))
    right = keys.join(lists, "cls").select("cls", "n", *[F.col(f"m.{c}").alias(c) for c in ("item", "cf", "pop")], "t", "x")
    asked, blocks = classes.query_blocks(queries.select("query", "liked", "seen", "wanted", "truth"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sums, users = np.zeros((len(tries), 4)), left.num_rows
        if users and right.num_rows:
            block = classes.Block(left, right, ("",))
            (item, ends), (cf, _), (pop, _) = (flat(right[c]) for c in ("item", "cf", "pop"))
            by_id = np.argsort(item, kind="stable")
            cls = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[by_id]
            item, parts = item[by_id], np.stack([cf[by_id], np.zeros(len(item)), pop[by_id]])
            (hide, cuts), (truth, bounds), wanted = flat(left["seen"]), flat(left["truth"]), left["wanted"].to_numpy()
            gain, boxes = 1 / np.log2(np.arange(k) + 2), [corners(tries[g]) for g in groups]
            ideal = np.cumsum(gain)
            for i, (raw,) in block:
                parts[1] = classes.scaled_classes(raw, block.n, block.total)[cls]
                hidden = np.flatnonzero(np.isin(item, hide[cuts[i] : cuts[i + 1]]))
                good = np.isin(item, truth[bounds[i] : bounds[i + 1]])
                good[hidden] = False
                if not good.any():
                    continue  # no hits under any weights
                for group, box in zip(groups, boxes, strict=True):
                    some = in_question(parts, box, hidden, k)
                    a, b, c = (parts[p][some] * tries[group, p][:, None] for p in range(3))
                    score = np.round(a + b + c, best.DIGITS)
                    hits = good[some[np.argsort(-score, axis=1, kind="stable")[:, :k]]]
                    n, any_ = hits.sum(axis=1), hits.any(axis=1)
                    sums[group] += np.stack([n / max(hits.shape[1], 1), n / wanted[i], hits @ gain[: hits.shape[1]] / ideal[min(wanted[i], k) - 1], np.where(any_, 1 / (hits.argmax(axis=1) + 1), 0.0)], axis=1)
        return pa.table([pa.array(np.arange(len(tries), dtype=np.int32)), pa.array(np.full(len(tries), users)), *[pa.array(x) for x in sums.T]], ["w", "users", *METRICS])

    right = right.withColumn("b", best.every(blocks))
    found_ = asked.groupBy("b").cogroup(right.groupBy("b")).applyInArrow(run, "w int, users long, precision double, recall double, ndcg double, mrr double")
    total = found_.groupBy("w").agg(F.sum("users").alias("users"), *[(F.sum(m) / F.nullif(F.sum("users"), F.lit(0))).alias(m) for m in METRICS])
    grid = spark.createDataFrame([(w, *map(float, t)) for w, t in enumerate(weights)], "w int, a double, b double, c double")
    return grid.join(total, "w", "left").drop("w").fillna(0, ["users", *METRICS])


def tune_by_history(catalog: DataFrame, vectors: DataFrame, train: DataFrame, validation: DataFrame, test: DataFrame, weights: Sequence[tuple[float, float, float]] | None = None, k: int = 10, threshold: float = 4.0) -> DataFrame | None:
    """tune() over all users of train: catalog(movieId, cf, pop) and vectors(movieId, term, w) as in recommend(). None if a task can't hold the catalog's distinct vectors."""
    scaled = scaled_catalog(catalog)
    items = scaled.select(F.col("movieId").cast("long").alias("item"), "cf", "pop").join(item_vectors(vectors), "item", "left")
    found = classes.classes_of(checkpointed(items), ("t", "x"))
    if found is None:
        return None
    users = train.select(F.col("userId").cast("long").alias("query"))
    queries = classes.listed_queries(histories(train, F.col("rating") >= threshold), found[1], users)
    own = lambda holdout: checkpointed(relevant(holdout, threshold).join(train.select("userId").distinct(), "userId", "left_semi"))
    truth = own(validation).groupBy(F.col("userId").cast("long").alias("query")).agg(F.count("*").alias("wanted"), F.collect_list(F.col("movieId").cast("long")).alias("truth"))
    winner = checkpointed(best_weights(tried_by_history(checkpointed(queries.join(truth, "query")), found, weights or candidate_weights(), k)))
    row = winner.first()
    if row is None:
        return winner
    tested = own(test)
    ranked = classes.best_by_classes(queries.join(tested.select(F.col("userId").cast("long").alias("query")), "query", "left_semi"), (found[0], found[1].withColumn("static", row.a * F.col("cf") + row.c * F.col("pop"))), (row.b,), ("",), k, None)
    return report(winner, ranked.select(F.col("query").alias("userId"), F.col("item").alias("movieId"), "rank"), tested, train, test, k)
