"""Rankings and sums by classes of equal vectors, against all pairs; and the same by blocks of items, for catalogs of too many classes."""

import numpy as np
import pytest
from test_best import got, scaled, sparse_frame, top

from pyspark.sql import functions as F

from tamarack.operators import best, classes, content


@pytest.fixture(scope="module")
def data(spark):
    """60 items of 6 vectors; queries with frequent terms, with a rare one, with none."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((6, 12)) < 0.5, rng.random((6, 12)), 0)[rng.integers(0, 6, 60)]
    q = np.where(rng.random((9, 12)) < 0.6, rng.random((9, 12)), 0)
    q[3], q[4] = 0, np.eye(12)[2]
    static = np.round(rng.random(60), 1)
    items = sparse_frame(spark, x, "item").join(spark.createDataFrame([(3 * i, float(s)) for i, s in enumerate(static)], "item long, static double"), "item")
    hidden = {(q_, i) for q_ in range(9) for i in range(60) if (q_ * 7 + i) % 3 == 0} | {(5, i) for i in range(55)}
    seen = spark.createDataFrame([(3 * a, 3 * b) for a, b in hidden], "query long, item long")
    return q, x, static, sparse_frame(spark, q, "query"), items, hidden, seen


def test_classes_hold_equal_vectors(data):
    _, x, _, _, items, *_ = data
    keys, members = classes.classes_of(items, ("t", "x"))
    assert keys.count() == len(np.unique(x, axis=0)) and members.count() == 60
    assert keys.agg(F.sum("n")).first()[0] == 60
    assert classes.classes_of(items, ("t", "x"), most=3) is None


@pytest.mark.parametrize("most", [10**6, 0])
def test_both_ways_rank_alike(monkeypatch, data, most):
    monkeypatch.setattr(classes, "CLASSES", most)
    monkeypatch.setattr(best, "ITEMS", 11)
    q, x, static, queries, items, hidden, seen = data
    raw = np.round(q @ x.T, 10)
    want = np.round(static + 0.4 * scaled(raw), 10)
    assert got(best.best_hybrids(queries, items, (best.Part(0.4),), 5, seen)) == sorted(top(want, hidden, 5))
    positive = np.where(raw > 0, raw, -np.inf)
    assert got(best.best_products(queries, items.drop("static"), 5, seen, positive=True)) == sorted(top(positive, hidden, 5))


def test_sums_cover_every_pair(data):
    q, x, static, queries, items, *_ = data
    found = classes.classes_of(items, ("t", "x"))
    weight = F.col("item") % 5 + 1
    w = np.arange(60) * 3 % 5 + 1
    score = np.round(static + 0.4 * scaled(np.round(q @ x.T, 10)), 10)
    for r in classes.sums_by_classes(queries, found, (0.4,), ("",), weight).collect():
        own = score[r.query // 3]
        assert r["items"] == 60 and np.isclose(r.total, own.sum()) and np.isclose(r.weighted, own @ w)


def test_equal_documents_have_equal_weights(spark):
    rng = np.random.default_rng(1)
    rows = [(m, f"t{i}", int(tf)) for i, tf in enumerate(rng.integers(1, 9, 40)) for m in range(30)]
    counts = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "movieId long, term string, tf long").withColumn("df", F.length("term") + 3)
    w = content.tf_idf(counts, spark.createDataFrame([(100,)], "n long"))
    assert w.groupBy("term").agg(F.countDistinct("w").alias("k")).where("k > 1").count() == 0


def test_neighbours_of_copies(spark, monkeypatch):
    """Each of 8 texts stands 7 times; lists by classes, by items and by plain products agree."""
    from tamarack.operators import neighbours

    rng = np.random.default_rng(2)
    x = np.where(rng.random((8, 10)) < 0.5, rng.random((8, 10)) + 0.1, 0)
    x[:, 0] = 0.5
    x = np.vstack([x / np.linalg.norm(x, axis=1, keepdims=True)] * 7)
    weights = spark.createDataFrame([(int(i) * 3, f"t{t}", float(x[i, t])) for i, t in zip(*np.nonzero(x), strict=True)], "movieId long, term string, w double")
    s = np.round(x @ x.T, 10)
    np.fill_diagonal(s, -np.inf)
    want = sorted(top(s, set(), 5))
    for shared in (4, 10**9):
        monkeypatch.setattr(neighbours, "SHARED", shared)
        assert sorted((r.movieId, r.otherId, r.place, round(r.score, 9)) for r in neighbours.similar_by_terms(weights, 5).collect()) == want
