"""Factor models fitted in rounds, each scored on a validation part; the best round is what stays.

A round solves all users' factors from the items', then all items' from the users' (alternating least
squares). A key's normal equations are sums over its ratings. Ratings lie packed by either side; a half
round joins the lists of one side with its factors, and what a task then holds of a key of the other side
moves as sums where it is many ratings, else as vectors, which are shorter than their squares. So a key
with very many ratings sends a few rows from each task. Rounds are cut by checkpoints, so a lost executor
costs a part of one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import flat, listed, starts
from ..session import checkpointed
from .evaluate import averaged, rating_errors, relevant, user_metrics
from .scores import global_mean, predict, shrunk_bias

_SUMS = "id long, n long, sums array<double>"
#: Ratings that a task gathers before it sends them on, and rows of a batch that it sends.
GATHERED, SENT = 100_000, 10_000


@dataclass
class Fit:
    """Factors of the best round; history has a row for each round: round, loss (on train), score (on validation, larger is better)."""

    users: DataFrame
    items: DataFrame
    history: list[tuple[int, float, float]]

    @property
    def best_round(self) -> int:
        return max(self.history, key=lambda h: (h[2], -h[0]))[0]


def first_factors(rows: DataFrame, key: str, rank: int, seed: int = 42) -> DataFrame:
    """(key, factors) with small numbers that follow from the id, the place and the seed alone."""
    at = lambda i: (F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(i)), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 2.0**32 + 0.5) / np.sqrt(rank)
    return rows.select(key).distinct().select(key, F.array(*[at(i) for i in range(rank)]).alias("factors"))


def added(ids: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by id."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.add.reduceat(n[order], first) if len(own) else n, np.add.reduceat(sums[order], first, axis=0) if len(own) else sums


def expanded(vectors: np.ndarray, values: np.ndarray, alpha: float | None) -> np.ndarray:
    """What each row adds to its key's normal equations: the upper half of the square, then the right side."""
    up = np.triu_indices(vectors.shape[1])
    square = vectors[:, up[0]] * vectors[:, up[1]]
    return np.hstack([square, values[:, None] * vectors] if alpha is None else [alpha * square, (1 + alpha) * vectors])


def sent(ids: np.ndarray, values: np.ndarray, vectors: np.ndarray, alpha: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, sums) of what a task holds of each id: its sums where they are shorter than its rows, else each row's vector and value, with n = 0."""
    rank = vectors.shape[1]
    order = np.argsort(ids, kind="stable")
    ids, values, vectors = ids[order], values[order], vectors[order]
    _, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    width = rank * (rank + 3) // 2
    summed = (count * (rank + 1) >= width)[place]
    for lo in range(0, len(ids), SENT):
        some = np.arange(lo, min(lo + SENT, len(ids)))
        many, few = some[summed[some]], some[~summed[some]]
        if len(many):
            own, n, sums = added(ids[many], np.ones(len(many), np.int64), expanded(vectors[many], values[many], alpha))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), listed(sums.ravel(), np.arange(len(own) + 1) * width)], ["id", "n", "sums"])
        if len(few):
            both = np.hstack([vectors[few], values[few, None]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[few]), pa.array(np.zeros(len(few), np.int64)), listed(both.ravel(), np.arange(len(few) + 1) * (rank + 1))], ["id", "n", "sums"])


def unpacked(batch: pa.RecordBatch, rank: int, alpha: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, n, sums) of rows that sent() made."""
    ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    numbers, ends = flat(batch.column(2))
    width, alone = rank * (rank + 3) // 2, n == 0
    sums = np.empty((len(ids), width))
    at = lambda rows, size: ends[:-1][rows][:, None] + np.arange(size)
    sums[~alone] = numbers[at(~alone, width)]
    both = numbers[at(alone, rank + 1)]
    sums[alone] = expanded(both[:, :rank], both[:, rank], alpha)
    return ids, np.maximum(n, 1), sums


def lists(rows: DataFrame, by: str, other: str) -> DataFrame:
    """(by, ids, values): rows(by, other, value) packed; a key with very many rows has several lists, in several tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cuts = starts(batch, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts[:-1])), listed(batch.column(1).to_numpy(), cuts), listed(batch.column(2).to_numpy(), cuts)], [by, "ids", "values"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = rows.select(F.col(by).cast("long").alias(by), F.col(other).cast("long").alias(other), F.col("value").cast("double").alias("value"))
    return sides.repartitionByRange(width, by, other).sortWithinPartitions(by).mapInArrow(pack, f"{by} long, ids array<long>, values array<double>")


def solved(rows: DataFrame, key: str, other: str, factors: DataFrame, rank: int, reg: float, alpha: float | None = None) -> DataFrame:
    """(key, factors): least squares of rows(key, other, value), or of their lists(other), on the others' factors, with reg times the number of rows on the diagonal.

    With alpha, rows are positives of weight 1 + alpha among pairs of value 0 and weight 1 (implicit feedback).
    """
    packed = rows if "ids" in rows.columns else lists(rows, other, key)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    up = np.triu_indices(rank)
    base = np.zeros((rank, rank))
    if alpha is not None:
        square = factors.select(F.posexplode(F.flatten(F.transform("factors", lambda x: F.transform("factors", lambda y: x * y)))).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
        for r in square.collect():  # rank x rank numbers
            base[divmod(r["at"], rank)] = r["v"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, ends = flat(batch.column(0))
            q = flat(batch.column(2))[0].astype(np.float64).reshape(batch.num_rows, rank)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            values = flat(batch.column(1))[0]
            for lo in range(0, len(ids), GATHERED):  # a batch of long lists is cut, too
                some = slice(lo, lo + GATHERED)
                held.append((ids[some], values[some], q[row[some]]))
                size += len(held[-1][0])
                if size >= GATHERED:
                    yield from sent(*(np.concatenate(x) for x in zip(*held, strict=True)), alpha)
                    held, size = [], 0
        if held:
            yield from sent(*(np.concatenate(x) for x in zip(*held, strict=True)), alpha)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def out(ids: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            m = len(up[0])
            left = np.zeros((len(ids), rank, rank))
            left[:, up[0], up[1]] = left[:, up[1], up[0]] = sums[:, :m]
            left += base + reg * n[:, None, None] * np.eye(rank)
            x = np.linalg.solve(left, sums[:, m:, None])[:, :, 0]
            return pa.RecordBatch.from_arrays([pa.array(ids), listed(x.ravel(), np.arange(len(ids) + 1) * rank)], ["id", "factors"])

        for batch in batches:  # sorted by id: the last id may go on in the next batch
            if not batch.num_rows:
                continue
            own = unpacked(batch, rank, alpha)
            ids, n, sums = added(*(own if held is None else (np.concatenate([h, o]) for h, o in zip(held, own, strict=True))))
            if len(ids) > 1:
                yield out(ids[:-1], n[:-1], sums[:-1])
            held = ids[-1:], n[-1:], sums[-1:]
        if held is not None:
            yield out(*held)

    joined = packed.join(factors, other).select("ids", "values", "factors")
    sums = joined.mapInArrow(parts, _SUMS).repartition(width, "id").sortWithinPartitions("id")
    return sums.mapInArrow(solve, "id long, factors array<double>").withColumnRenamed("id", key)


def fit_rounds(rows: DataFrame, score: Callable[[DataFrame, DataFrame], float], loss: Callable[[DataFrame, DataFrame], float], rank: int, reg: float, rounds: int, patience: int, seed: int = 42, alpha: float | None = None) -> Fit:
    """The best of at most `rounds` rounds over rows(userId, movieId, value), by score(users, items); stops after `patience` rounds without a better one."""
    by_user = checkpointed(lists(rows, "userId", "movieId"))
    one = by_user.select("userId", F.explode(F.arrays_zip("ids", "values")).alias("z")).select("userId", F.col("z.ids").alias("movieId"), F.col("z.values").alias("value"))
    by_item = checkpointed(lists(one, "movieId", "userId"))
    items, best, history = checkpointed(first_factors(by_item, "movieId", rank, seed)), None, []
    for number in range(1, rounds + 1):
        users = checkpointed(solved(by_item, "userId", "movieId", items, rank, reg, alpha))
        items = checkpointed(solved(by_user, "movieId", "userId", users, rank, reg, alpha))
        history.append((number, loss(users, items), score(users, items)))
        if best is None or history[-1][2] > history[best[2] - 1][2]:
            best = users, items, number
        if number - best[2] >= patience:
            break
    return Fit(best[0], best[1], history)


def fit_ratings(train: DataFrame, validation: DataFrame, rank: int = 24, reg: float = 0.1, rounds: int = 10, patience: int = 2, seed: int = 42) -> Fit:
    """Factors of what shrunk biases leave of train's ratings (a pair's are averaged); loss is the rmse on train, score the negative rmse on validation."""
    bu, bi, mu = (checkpointed(x) for x in (shrunk_bias(train, "userId"), shrunk_bias(train, "movieId"), global_mean(train)))
    mean = train.groupBy("userId", "movieId").agg(F.avg("rating").alias("rating"))
    left = mean.join(bu.withColumnRenamed("bias", "bu"), "userId").join(bi.withColumnRenamed("bias", "bi"), "movieId").crossJoin(F.broadcast(mu))
    rows = left.select("userId", "movieId", (F.col("rating") - F.col("mu") - F.col("bu") - F.col("bi")).alias("value"))

    def rmse(pairs: DataFrame, users: DataFrame, items: DataFrame) -> float:
        return rating_errors(predict(pairs.crossJoin(F.broadcast(mu)), users, items, bu, bi, F.col("mu"))).first().rmse

    return fit_rounds(rows, lambda u, i: -rmse(validation, u, i), lambda u, i: rmse(train, u, i), rank, reg, rounds, patience, seed)


def fit_positives(train: DataFrame, validation: DataFrame, rank: int = 24, reg: float = 0.01, alpha: float = 20.0, rounds: int = 10, patience: int = 2, k: int = 10, threshold: float = 4.0, seed: int = 42) -> Fit:
    """Factors of implicit feedback from train's positives; score is ndcg at k on validation's, loss the mean squared miss of train's."""
    from .rank import best_by_factors

    positives = checkpointed(relevant(train, threshold))
    truth = checkpointed(relevant(validation, threshold).join(positives.select("userId").distinct(), "userId", "left_semi"))
    seen = train.select("userId", "movieId")

    def ndcg(users: DataFrame, items: DataFrame) -> float:
        ranked = best_by_factors(users.join(truth, "userId", "left_semi"), items, k, seen)
        return averaged(user_metrics(ranked, truth, k)).first().ndcg

    def miss(users: DataFrame, items: DataFrame) -> float:
        from ..functions.vectors import dot

        rows = positives.join(users.withColumnRenamed("factors", "p"), "userId").join(items.withColumnRenamed("factors", "q"), "movieId")
        one = F.lit(1.0) - dot(F.col("p"), F.col("q"))
        return rows.agg(F.coalesce(F.avg(one * one), F.lit(0.0))).first()[0]

    return fit_rounds(positives.withColumn("value", F.lit(1.0)), ndcg, miss, rank, reg, rounds, patience, seed, alpha)


def history_rows(spark, fit: Fit) -> DataFrame:
    """(round, loss, score, best), a row for each round."""
    return spark.createDataFrame([(n, float(a), float(b), n == fit.best_round) for n, a, b in fit.history], "round int, loss double, score double, best boolean")
