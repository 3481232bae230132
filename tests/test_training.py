"""Fits in rounds on data that has factors, and the search for weights."""

import numpy as np
from pyspark.sql import functions as F

from tamarack.operators import evaluate, scores, training, tuning

RATINGS = "userId long, movieId long, rating double, timestamp long"


def ratings(spark, seed=1):
    """Two kinds of users who like opposite halves of the items; a user with very many ratings."""
    rng = np.random.default_rng(seed)
    taste, kind = rng.choice((-1, 1), 60), np.where(np.arange(40) < 20, 1, -1)
    rows = []
    for u in range(60):
        for m in rng.permutation(40)[: 40 if u == 0 else 14]:
            rows.append((u, int(m) * 3, float(np.clip(3 + 1.5 * taste[u] * kind[m] + rng.normal() * 0.3, 0.5, 5)), int(rng.integers(10**6))))
    return spark.createDataFrame(rows, RATINGS)


def parts(spark):
    r = ratings(spark).withColumn("h", F.pmod(F.xxhash64("userId", "movieId"), F.lit(5))).cache()
    return r.where("h < 4").drop("h"), r.where("h = 4").drop("h")


def test_factors_beat_biases(spark):
    train, validation = parts(spark)
    fit = training.fit_ratings(train, validation, rank=3, reg=0.05, rounds=6, patience=2)
    base = evaluate.rating_errors(scores.predict_by_bias(validation, train)).first().rmse
    losses = [h[1] for h in fit.history]
    assert losses[-1] < losses[0] and -max(h[2] for h in fit.history) < 0.6 * base
    assert fit.best_round == max(fit.history, key=lambda h: h[2])[0]
    assert fit.users.count() == 60 and fit.items.count() == 40


def test_one_round_against_numpy(spark):
    train, _ = parts(spark)
    rows = train.groupBy("userId", "movieId").agg(F.avg("rating").alias("value"))
    items = training.first_factors(rows, "movieId", 3)
    q = {r.movieId: np.array(r.factors) for r in items.collect()}
    own = {}
    for r in rows.collect():
        own.setdefault(r.userId, []).append((q[r.movieId], r.value))
    for alpha in (None, 5.0):
        out = {r.userId: np.array(r.factors) for r in training.solved(rows, "userId", "movieId", items, 3, 0.1, alpha).collect()}
        assert set(out) == set(own)
        every = np.array(list(q.values()))
        for u, pairs in own.items():
            x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            left, right = (x.T @ x, x.T @ y) if alpha is None else (every.T @ every + alpha * x.T @ x, (1 + alpha) * x.sum(0))
            assert np.allclose(out[u], np.linalg.solve(left + 0.1 * len(x) * np.eye(3), right))


def test_stops_when_validation_gets_no_better(spark):
    train, validation = parts(spark)
    marks = iter([1.0, 3.0, 2.0, 2.5, 9.0])
    fit = training.fit_rounds(train.select("userId", "movieId", F.col("rating").alias("value")), lambda u, i: next(marks), lambda u, i: 0.0, 2, 0.1, 5, 2)
    assert [h[2] for h in fit.history] == [1.0, 3.0, 2.0, 2.5] and fit.best_round == 2
    assert [(r["round"], r.best) for r in training.history_rows(spark, fit).collect()] == [(1, False), (2, True), (3, False), (4, False)]


def test_implicit_fit_finds_the_halves(spark):
    train, validation = parts(spark)
    fit = training.fit_positives(train, validation, rank=2, reg=0.01, alpha=10.0, rounds=4, patience=2)
    assert max(h[2] for h in fit.history) > 0.2 and len(fit.history) <= 4


def test_weights_without_a_hit_count_as_zero(spark):
    components = spark.createDataFrame([(1, m, float(m), float(9 - m), 0.5) for m in range(10)] + [(2, m, 0.0, 0.0, float(m == 4)) for m in range(10)], "userId long, movieId long, cf double, content double, pop double")
    truth = spark.createDataFrame([(1, 9), (2, 4)], "userId long, movieId long")
    grid = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    got = {(r.a, r.b, r.c): (r.users, r.precision, r.mrr) for r in tuning.tried(components, truth, grid, 1).collect()}
    assert got == {grid[0]: (2, 0.5, 0.5), grid[1]: (2, 0.0, 0.0), grid[2]: (2, 0.5, 0.5)}
    best = tuning.best_weights(tuning.tried(components, truth, grid, 1)).first()
    assert (best.a, best.b, best.c) == grid[2]  # the first of equals, in order
    assert len(tuning.candidate_weights()) == len(set(tuning.candidate_weights())) and all(abs(sum(w) - 1) < 1e-9 for w in tuning.candidate_weights())


def test_few_ratings_move_as_vectors(spark):
    rng = np.random.default_rng(3)
    ids, values, vectors = np.concatenate([np.arange(500), np.full(800, 7)]), rng.normal(size=1300), rng.normal(size=(1300, 8))
    sent = list(training.sent(ids, values, vectors, None))
    numbers = sum(len(b.column(2).flatten()) for b in sent)
    assert numbers == 499 * 9 + 44  # not 44 for each of 500 keys
    own, n, sums = training.added(*(np.concatenate(x) for x in zip(*(training.unpacked(b, 8, None) for b in sent), strict=True)))
    want = training.added(ids, np.ones(1300, np.int64), training.expanded(vectors, values, None))
    assert own.tolist() == want[0].tolist() and n.tolist() == want[1].tolist() and np.allclose(sums, want[2])


def test_a_key_with_many_ratings_has_several_lists(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("movieId"), F.col("id").alias("userId"), (F.col("id") % 7).cast("double").alias("value"))
    packed = training.lists(rows, "movieId", "userId").select(F.size("ids").alias("n"), F.spark_partition_id().alias("part")).collect()
    assert sum(r.n for r in packed) == 60_000 and len({r.part for r in packed}) > 1
