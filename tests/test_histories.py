"""Users who come as lists of items, against the same users with their profiles as terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import best, classes, content, rank

USERS, ITEMS = 23, 60


@pytest.fixture(scope="module")
def tables(spark):
    """40 different vectors of 60 items, one item without terms; a user without liked items, one with an item that isn't in the catalog, one who likes a pair twice."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((40, 30)) < 0.2, rng.random((40, 30)), 0)
    x[:, 0] += 0.2
    x = x[np.concatenate([np.arange(40), rng.integers(0, 40, 19)])]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weights = spark.createDataFrame([(int(i) * 2, f"t{t}", float(x[i, t])) for i, t in zip(*np.nonzero(x), strict=True)], "movieId long, term string, w double")
    rows = [(int(u), 2 * int(m), float(rng.integers(1, 11)) / 2) for u in range(USERS) for m in rng.permutation(ITEMS)[: rng.integers(1, 20)]]
    rows = [(u, m, 1.0 if u == 4 else r) for u, m, r in rows] + [(5, 999, 5.0), rows[0], (*rows[0][:2], 5.0), (None, 4, 5.0)]
    ratings = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    catalog = spark.createDataFrame([(2 * i, float(rng.normal()), float(rng.integers(0, 5))) for i in range(ITEMS)], "movieId long, cf double, pop double")
    return ratings, catalog, weights


def by_user(df, *names):
    return sorted((r.userId, *(round(v, 8) if isinstance(v, float) else v for v in (r[n] for n in names))) for r in df.collect() if r.userId is not None and r.userId >= 0)


@pytest.mark.parametrize("many", [10**6, 1])
def test_lists_and_terms_agree(monkeypatch, tables, many):
    monkeypatch.setattr(classes, "MANY", many)  # 1: ranks are bounded before they are taken
    monkeypatch.setattr(best, "HEAD_ITEMS", many)  # 1: frequent terms lie in a table
    monkeypatch.setattr(classes, "LISTED", 5)
    ratings, catalog, weights = tables
    liked, four = ratings.where("rating >= 4"), F.col("rating") >= 4
    users = ratings.where("userId is not null").select("userId").distinct()
    score, place = ("movieId", "score", "rank"), F.col("movieId") % 7 + 1
    want = rank.recommend(users, catalog, content.profiles(liked, weights), weights, 6, seen=ratings)
    assert by_user(rank.recommend_by_history(ratings, four, catalog, weights, 6), *score, "raw_content", "content") == by_user(want, *score, "raw_content", "content")
    sums = ("items", "total", "weighted")
    assert by_user(rank.history_sums(ratings, four, catalog, weights, place), *sums) == by_user(rank.hybrid_sums(users, catalog, content.profiles(liked, weights), weights, place), *sums)
    assert by_user(content.history_sums(liked, weights, place), *sums) == by_user(content.profile_scores(content.profiles(liked, weights), weights).groupBy("userId").agg(F.count("*").alias("items"), F.sum("score").alias("total"), F.sum(F.col("score") * place).alias("weighted")), *sums)
    assert by_user(content.best_by_history(ratings, weights, 6), *score) == by_user(content.best_by_profile(content.profiles(ratings, weights), weights, 6, ratings), *score)


def test_no_terms_move_for_users(tables):
    """A user's row holds ids of classes and items; a catalog of more than 131,072 vectors is no reason for blocks."""
    ratings, _, weights = tables
    found = classes.classes_of(content.item_vectors(weights).withColumn("static", F.lit(0.0)), ("t", "x"))
    rows = classes.listed_queries(content.histories(ratings, F.col("rating") >= 4), found[1])
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "array<bigint>", "array<bigint>", "int"]
    assert {r.query for r in rows.collect()} == set(range(USERS)) and rows.where("query = 4").first().liked == []
    assert classes.CLASSES > 131_072


def test_many_queries_make_few_blocks(spark):
    """All classes move once for each block."""
    queries = spark.range(100_000).withColumnRenamed("id", "query")
    cores = spark.sparkContext.defaultParallelism
    assert classes.query_blocks(queries)[1] == 2 * cores


def test_bounded_ranks(spark):
    rng = np.random.default_rng(5)
    for own in (rng.random(500), np.round(rng.random(500), 1), np.zeros(500), np.where(rng.random(500) < 0.9, 0.0, rng.random(500)), rng.normal(size=500)):
        n = rng.integers(1, 5, 500).astype(float)
        part, want = classes.Ranks(own, n, int(n.sum())), classes.scaled_classes(own, n, int(n.sum()))
        some = rng.permutation(500)[:80]
        assert np.array_equal(part.of(some), want[some]) and (part.most() >= want).all()
        lead = np.round(rng.random(500), 2)
        near, (scaled,) = classes.reaching(lead, [own], n, int(n.sum()), (0.7,), 9)
        assert np.array_equal(scaled, want[near]) and set(np.argsort(-(lead + 0.7 * want), kind="stable")[:9]) <= set(near)


def test_weights_are_tried_on_all_users(monkeypatch, spark, tables):
    """The same means as from rows of every user's whole catalog; no user is left out of the search."""
    from tamarack.operators import tuning
    from tamarack.plans import score_queries

    monkeypatch.setattr(tuning, "TOGETHER", 2)
    ratings, catalog, weights = tables
    ratings = ratings.where("userId is not null")
    scaled = rank.scaled_catalog(catalog)
    found = classes.classes_of(scaled.withColumnRenamed("movieId", "item").join(content.item_vectors(weights), "item", "left"), ("t", "x"))
    queries = classes.listed_queries(content.histories(ratings, F.col("rating") >= 4), found[1])
    truth = spark.createDataFrame([(u, 2 * m) for u in range(USERS) for m in range(ITEMS + 2) if (u + m) % 9 == 0], "userId long, movieId long")
    asked = queries.join(truth.groupBy(F.col("userId").alias("query")).agg(F.count("*").alias("wanted"), F.collect_list("movieId").alias("truth")), "query")
    content_ = content.profile_scores(content.profiles(ratings.where("rating >= 4"), weights), weights).withColumnRenamed("score", "content")
    raw = ratings.select("userId").distinct().crossJoin(scaled).join(content_, ["userId", "movieId"], "left").fillna(0.0, ["content"])
    unseen = rank.with_scaled(raw, "userId", "movieId", "content", "s").select("userId", "movieId", "cf", F.col("s").alias("content"), "pop").join(ratings, ["userId", "movieId"], "left_anti")
    grid = [(0.5, 0.3, 0.2), (0.2, 0.7, 0.1), (0.0, 1.0, 0.0), (0.9, 0.05, 0.05), (0.6, 0.1, 0.9)]
    rows = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.select("a", "b", "c", "users", "precision", "recall", "ndcg", "mrr").collect())
    got = rows(tuning.tried_by_history(asked, found, grid, 5))
    assert got == rows(tuning.tried(unseen, truth, grid, 5)) and got[0][3] == USERS
    assert "limit 20" not in score_queries.TUNED
