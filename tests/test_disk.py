"""What keeps files of shuffles small, and lets them go."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_best import frame, got, top, vectors

from tamarack import session
from tamarack.operators import best, scores
from tamarack.sources.adapters import Tables


def test_files_of_a_step_go_when_it_ends(spark):
    Tables(spark, "/none")
    assert spark.conf.get(session.FILES_GO) == "true"
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    kept = session.checkpointed(rows)
    assert rows.count() == rows.count() == kept.count() == 100 and {r.n for r in rows.collect()} == {r.n for r in rows.collect()} == {100}


@pytest.mark.parametrize("width", [1, 64])
def test_blocks_of_short_vectors_are_larger(spark, monkeypatch, width):
    monkeypatch.setattr(best, "ITEMS", 40)
    monkeypatch.setattr(best, "QUERIES", 7)
    monkeypatch.setattr(best, "WIDTH", width)
    rng = np.random.default_rng(1)
    q, x = vectors(rng, 25), vectors(rng, 230)
    hidden = {(3, i) for i in range(230)} | {(i % 25, i) for i in range(230)}
    seen = spark.createDataFrame([(3 * a, 3 * b) for a, b in hidden], "query long, item long")
    made = []
    kept = session.checkpointed
    monkeypatch.setattr(best, "checkpointed", lambda df: (made.append(df), kept(df))[1])
    assert got(best.best_products(frame(spark, q, "query"), frame(spark, x, "item"), 5, seen)) == sorted(top(np.round(q @ x.T, 10), hidden, 5))
    assert made[0].select("c").distinct().count() == (6 if width == 1 else 1)


def test_vectors_do_not_move_for_each_pair(spark, monkeypatch):
    """A user's vector comes once to a block of items, with a list."""
    rng = np.random.default_rng(2)
    x = {f"{kind}{i}": rng.normal(size=3).tolist() for kind in "ui" for i in range(30) if i % 7}
    pairs = [(int(u), int(m)) for u, m in rng.integers(0, 30, (500, 2))] + [(1, 1), (1, 1), (None, 1), (1, None)]
    monkeypatch.setattr(scores, "VECTORS", 2)
    out = scores.pair_scores(spark.createDataFrame(pairs, "userId long, movieId long"), spark.createDataFrame(list(x.items()), "node string, x array<double>"))
    want = {(u, m): round(float(np.dot(x[f"u{u}"], x[f"i{m}"])), 9) for u, m in pairs if f"u{u}" in x and f"i{m}" in x}
    rows = out.collect()
    assert len(rows) == len(want) and {(r.userId, r.movieId): round(r.score, 9) for r in rows} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "collect_list" in plan


def test_vectors_move_as_they_come(spark):
    side = lambda key: spark.createDataFrame([(i, i % 2, [float(i), 0.5]) for i in range(9)], f"{key} long, label int, x array<float>")
    out = scores.products_within(side("userId"), side("movieId"), "label")
    assert {(r.userId, r.movieId): r.score for r in out.collect()} == {(i, j): i * j + 0.25 for i in range(9) for j in range(9) if (i - j) % 2 == 0}
    assert "transform" not in out._jdf.queryExecution().optimizedPlan().toString()  # no doubles are made of floats before they move
