"""Literal cases and invariants of the ratings operators."""

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text as X
from tamarack.functions import vectors as V
from tamarack.operators import content, evaluate, leaderboard, prepare, quality, rank, scores, split

RATINGS = "userId long, movieId long, rating double, timestamp long"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_split_sizes(spark):
    rows = [(1, m, 4.0, m) for m in range(5)] + [(2, m, 3.0, m) for m in range(2)]
    out = split.temporal_split(spark.createDataFrame(rows, RATINGS))
    got = {(r.userId, r.split): r.n for r in out.groupBy("userId", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "train"): 3, (1, "validation"): 1, (1, "test"): 1, (2, "train"): 2}


def test_split_of_nothing(spark):
    assert split.temporal_split(spark.createDataFrame([], RATINGS)).count() == 0


def test_warm_and_cold(spark):
    train, test = spark.createDataFrame([(1, 10, 4.0, 1)], RATINGS), spark.createDataFrame([(1, 10, 4.0, 2), (1, 20, 4.0, 3)], RATINGS)
    assert values(split.segments(test, train), "movieId", "segment") == [(10, "warm"), (20, "cold")]


def test_enrichment_precedence(spark):
    movies = spark.createDataFrame([(1, "A (1999)", "(no genres listed)"), (2, "B", "Drama")], "movieId long, title string, genres string")
    enriched = spark.createDataFrame([(1, "Action", "text"), (2, "Comedy", None)], "movieId long, genres string, overview string")
    assert values(prepare.merge_enriched(movies, enriched), "movieId", "genres", "overview") == [(1, "Action", "text"), (2, "Drama", "")]
    assert values(prepare.overlay(movies, enriched), "movieId", "genres") == [(1, "Action"), (2, "Comedy")]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="movieId, rating"):
        prepare.require_columns(spark.createDataFrame([(1,)], "userId long"), ["userId", "movieId", "rating"], "ratings")


def test_titles(spark):
    df = spark.createDataFrame([("Trip, The (2006–2007)", "https://x.org/film/the-trip/"), (None, None)], "t string, u string")
    t = F.col("t")
    got = df.select(X.year_in_title(t).alias("y"), X.slug_of_url(F.col("u")).alias("s"), X.article_first(F.lit("Matrix, The (1999)")).alias("a"), X.slug_of_title(F.lit("The Big  Trip!")).alias("g")).collect()
    assert got[0] == ("2006", "the-trip", "The Matrix (1999)", "big-trip") and got[1].s == ""


def test_stars_and_ratings(spark):
    df = spark.createDataFrame([("x ★★★½ y ★",), ("★★★★★★",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(X.stars(F.col("t"))).collect()] == [3.5, None, None, None]
    df = spark.createDataFrame([("9", None), (None, "yes"), ("x", "no")], "r string, l string")
    assert [r[0] for r in df.select(X.normal_rating(F.col("r"), F.col("l"))).collect()] == [5.0, 5.0, 0.5]


def test_rank_scaling(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, 7.0), (1, 4, float("nan")), (2, 1, 3.0), (2, 2, 3.0)], "userId long, movieId long, s double")
    got = values(df.withColumn("v", V.rank_scaled(F.col("s"), "userId")), "userId", "movieId", "v")
    assert got == [(1, 1, 1 / 3), (1, 2, 2.5 / 3), (1, 3, 2.5 / 3), (1, 4, 0.0), (2, 1, 0.0), (2, 2, 0.0)]


def test_batch_scorer_equals_joins(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    users = spark.createDataFrame([(u, vec(), vec(), [u]) for u in range(5)], "userId long, cf array<double>, content array<double>, seen array<long>")
    items = spark.createDataFrame([(m, vec(), vec()) for m in range(30)], "movieId long, cf array<double>, content array<double>")
    pop = spark.createDataFrame([(m, float(m % 7)) for m in range(30)], "movieId long, popularity double")
    batch = rank.batch_top_k(users, items, pop, 5)
    raw = users.crossJoin(items.withColumnsRenamed({"cf": "icf", "content": "icontent"})).join(pop, "movieId")
    raw = raw.select("userId", "movieId", V.dot(F.col("cf"), F.col("icf")).alias("cf"), V.dot(F.col("content"), F.col("icontent")).alias("content"), F.col("popularity").alias("pop"))
    joined = rank.top_k(rank.hybrid(rank.scaled_components(raw)), 5, users.select("userId", F.explode("seen").alias("movieId")))
    assert values(batch, "userId", "movieId", "rank") == values(joined, "userId", "movieId", "rank")


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "userId long, movieId long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 99), (3, 5)], "userId long, movieId long")
    got = {r.userId: r for r in evaluate.user_metrics(ranked, truth).collect()}
    assert (got[1].precision, got[1].recall, got[1].mrr) == (0.5, 0.5, 0.5) and got[2].recall == got[3].ndcg == 0.0


def test_k_core_bounds(spark):
    rows = [(f"u{u}", f"m{m}", u * 50 + m) for u in range(12) for m in range(u)]
    core = prepare.k_core(spark.createDataFrame(rows, "user_id string, movie_id string, seq long"), 5, 4)
    assert core.count() and core.groupBy("user_id").count().agg(F.min("count")).first()[0] >= 5
    assert core.groupBy("movie_id").count().agg(F.min("count")).first()[0] >= 4


def test_dense_ids(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0)], "k string, seq int")
    assert values(prepare.dense_ids(df, "k"), "k", "dense_id") == [("a", 1), ("b", 2), ("c", 3)]
    assert values(prepare.dense_ids(df, "k", 1, F.col("seq")), "k", "dense_id") == [("a", 3), ("b", 2), ("c", 1)]


def test_best_interaction(spark):
    rows = [("u", "m", "liked", 4.0, 1), ("u", "m", "rating", 4.0, 2), ("u", "m", "watched", 2.5, 3), (None, "m", "rating", 5.0, 4)]
    df = spark.createDataFrame(rows, "user_id string, movie_id string, interaction_type string, implicit_score double, seq long")
    assert values(prepare.best_interactions(df), "seq") == [(2,)]


def test_metric_names(spark):
    raw = spark.createDataFrame([(1, "ndcg_at_k", 0.1), (1, "all_ndcg_at_k", 0.2), (1, "recall_at_k", 0.3), (1, "test_rmse", 0.9), (1, "noise", 5.0)], "run int, metric string, value double")
    assert values(leaderboard.normal_metrics(raw), "metric", "value") == [("ndcg@10", 0.2), ("recall@10", 0.3), ("rmse", 0.9), ("warm_ndcg@10", 0.1)]  # the bare one is the warm one only beside one for all


def test_warp_negatives_violate(spark):
    pos = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "userId long, movieId long")
    items = spark.createDataFrame([(m,) for m in range(20)], "movieId long")
    out = scores.warp_negatives(pos, items, pos.withColumn("score", F.lit(0.5)))
    assert out.where("weight > 0").count() == 3 and out.join(pos.withColumnRenamed("movieId", "negative"), ["userId", "negative"]).count() == 0


def test_tf_idf_rows_have_length_one(spark):
    docs = spark.createDataFrame([(1, "red ring red"), (2, "red dog"), (3, "dog ring")], "movieId long, title string")
    n = docs.agg(F.count("*").alias("n"))
    w = content.tf_idf(content.pruned(content.term_counts(docs, F.col("title"), bigrams=False), n), n)
    assert all(abs(r[0] - 1) < 1e-9 for r in w.groupBy("movieId").agg(F.sum(F.col("w") * F.col("w"))).collect() for r in [(r[1],)])


def test_coverage(spark):
    df = spark.createDataFrame([("a", "0"), (" ", "3"), (None, "x")], "t string, n string")
    assert values(quality.coverage(df, ["t"], ["n"]), "column", "covered", "pct") == [("n", 1, 33.3333), ("t", 1, 33.3333)]
