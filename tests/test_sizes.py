"""What keeps tasks and rows small when tables grow."""

import math
import re

from pyspark.sql import functions as F

from tamarack import session
from tamarack.functions.vectors import rank_scaled
from tamarack.operators import content, rank, scores
from tamarack.operators.split import temporal_split
from tamarack.sources.adapters import Tables


def test_tasks_are_many_and_small(spark):
    number, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(number)
    spark.conf.set(size, "64MB")
    Tables(spark, "/none")
    assert int(spark.conf.get(number)) == session.PARTITIONS and int(spark.conf.get(size)) == session.PARTITION_BYTES
    rows = spark.range(600_000).select((F.xxhash64("id") % 40_000).alias("userId"), F.xxhash64("id", F.lit(1)).alias("movieId"), F.lit(4.0).alias("rating"), F.xxhash64("id", F.lit(2)).alias("timestamp"))
    plan = temporal_split(rows)
    assert plan.count() == 600_000
    spark.conf.set(number, str(2 * session.PARTITIONS))
    spark.conf.set(size, "1m")
    session.bounded_tasks(spark)
    assert int(spark.conf.get(number)) == 2 * session.PARTITIONS and spark.conf.get(size) == "1m"
    spark.conf.unset(number)
    spark.conf.unset(size)


def test_pair_scores_keep_vectors_whole(spark):
    vectors = spark.createDataFrame([("u1", [1.0, 2.0]), ("i1", [3.0, 4.0]), ("i22", [0.5, 0.0]), ("u7", [1.0, 1.0])], "node string, x array<double>")
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 22), (7, 3), (8, 1)], "userId long, movieId long")
    out = scores.pair_scores(pairs, vectors)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 11.0), (1, 22, 0.5)]
    assert "posexplode" not in out._jdf.queryExecution().toString().lower()


def test_predictions_move_pairs_once_for_each_side(spark):
    pairs = spark.createDataFrame([(1, 1, 4.0), (2, 1, 3.0), (3, 9, 1.0)], "userId long, movieId long, rating double")
    factors = lambda key: spark.createDataFrame([(1, [1.0, 2.0]), (3, [0.5, 0.5])], f"{key} long, factors array<double>")
    bias = lambda key: spark.createDataFrame([(1, 0.5), (2, 0.25)], f"{key} long, bias double")
    out = scores.predict(pairs, factors("userId"), factors("movieId").withColumn("factors", F.array(F.lit(0.25), F.lit(0.5))), bias("userId"), bias("movieId"), F.lit(2.0))
    assert sorted((r.userId, r.movieId, r.prediction) for r in out.collect()) == [(1, 1, 4.25), (2, 1, 2.75), (3, 9, 2.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_products_of_a_frequent_label_are_many_tasks(spark):
    rows = [(i, "x" if i % 5 else "y", [float(i), 0.5]) for i in range(50)] + [(50, "x", None), (51, "x", [1.0, None]), (52, "x", [2.0]), (53, None, [1.0, 1.0])]
    side = lambda key: spark.createDataFrame(rows, f"{key} long, label string, x array<float>")
    out = scores.products_within(side("userId"), side("movieId"), "label", block=16).collect()
    vectors = {i: (k, v) for i, k, v in rows}
    want = {}
    for i, (k, a) in vectors.items():
        for j, (m, b) in vectors.items():
            if k is not None and k == m:
                whole = a is not None and b is not None and len(a) == len(b) and None not in a + b
                want[i, j] = round(sum(x * y for x, y in zip(a, b)), 6) if whole else None
    assert len(out) == len(want) and {(r.userId, r.movieId): r.score for r in out} == want
    plan = scores.products_within(side("userId"), side("movieId"), "label", block=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan  # not a join by label


def test_propagation_makes_edges_once(spark, monkeypatch):
    made = []
    kept = session.checkpointed
    monkeypatch.setattr(session, "checkpointed", lambda df: (made.append(df.columns), kept(df))[1])
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "src string, dst string, w double")
    x = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "node string, x array<double>")
    assert sorted((r.node, r.x) for r in scores.propagate(edges, x, 1, 2).collect()) == [("a", [(1 + 1 + 0.25) / 3]), ("b", [(2 + 0.5 + 0.5) / 3])]
    assert made[0] == ["src", "dst", "w"]


def test_draws_of_negatives_stay_in_their_task(spark):
    """The same negatives as by a row for each draw, from a plan that makes no such rows."""
    positives = [(u, m) for u in (1, 2, 3) for m in range(12) if (u * 7 + m * 5) % 4 < u] + [(1, 99), (4, 2)] + [(5, m) for m in range(12)]
    rated = {(u, m): (0.25 * ((u + m) % 9)) for u in range(1, 6) for m in range(0, 12, 2)} | {(3, 0): 9.0}
    pos = spark.createDataFrame(positives, "userId long, movieId long")
    items = spark.createDataFrame([(m,) for m in range(12)], "movieId long")
    score = spark.createDataFrame([(u, m, s) for (u, m), s in rated.items()], "userId long, movieId long, score double")
    hashes = pos.crossJoin(spark.range(1, 21).select(F.col("id").cast("int").alias("d"))).select("userId", "movieId", "d", F.xxhash64("userId", "movieId", "d", F.lit(42)).alias("h"), F.xxhash64("userId", "movieId", F.lit(42)).alias("one"))
    want, one = {}, {}
    for r in sorted(hashes.collect()):
        free = [m for m in range(12) if (r.userId, m) not in positives]
        if free and want.get((r.userId, r.movieId), (0, 0.0))[1] == 0.0:
            negative = free[r.h % len(free)]
            hit = 1.0 - rated.get((r.userId, r.movieId), 0.0) + rated.get((r.userId, negative), 0.0) > 0
            want[r.userId, r.movieId] = (negative, math.log(1 + max(1, (len(free) - 1) // r.d)) if hit else 0.0)
        if free:
            one[r.userId, r.movieId] = free[r.one % len(free)]
    out = scores.warp_negatives(pos, items, score)
    got = {(r.userId, r.movieId): (r.negative, r.weight) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert any(w == 0 for _, w in want.values()) and any(w > 0 for _, w in want.values())
    assert {(r.userId, r.movieId): r.negative for r in scores.sampled_negatives(pos, items).collect()} == one
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each draw


def test_ranks_of_a_user_are_many_tasks(spark):
    """The same ranks as by a window over all rows of a user, from plans without one, for rare and for frequent values."""
    odd = {3: None, 5: float("nan"), 7: float("inf"), 8: -float("inf")}
    rows = [(u, m, odd.get(m, 0.0 if m % 3 else float((m * u) % 11)), float(m), 0.5) for u in (1, 2, 3) for m in range(60)] + [(4, 1, 2.0, 1.0, 0.0)]
    raw = spark.createDataFrame(rows, "userId long, movieId long, cf double, content double, pop double")
    want = raw.select("userId", "movieId", *[rank_scaled(F.col(c), "userId").alias(c) for c in ("cf", "content", "pop")])
    ordered = lambda df: sorted(map(tuple, df.select("userId", "movieId", "cf", "content", "pop").collect()))
    got = rank.scaled_components(raw)
    assert ordered(got) == ordered(want)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    for often in (0, 10):
        some = rank.with_scaled(raw, "userId", "movieId", "cf", "scaled", often=often).select("userId", "movieId", "scaled")
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.select("userId", "movieId", "cf").collect()))


def test_terms_do_not_move_for_each_pair(spark, monkeypatch):
    """Profiles are the same from few vectors, which come to the users, and from many; the first plan moves no terms."""
    history = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (2, 3), (2, 9), (3, 9)], "userId long, movieId long")
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "b", 0.25), (2, "a", 0.5), (3, "c", 1.0), (4, "d", 1.0)], "movieId long, term string, w double")
    want = sorted([(1, "a", 1 / 3), (1, "b", 0.5 / 3), (1, "c", 1 / 3), (2, "c", 0.5)])
    few = content.profiles(history, weights)
    rounded = lambda df: sorted((r.userId, r.term, round(r.p, 12)) for r in df.collect())
    assert rounded(few) == [(u, t, round(p, 12)) for u, t, p in want]
    assert not [line for line in few._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"Exchange hashpartitioning\([^)]*\bterm#", line)]
    monkeypatch.setattr(content, "VALUES", 3)
    assert rounded(content.profiles(history, weights)) == [(u, t, round(p, 12)) for u, t, p in want]
