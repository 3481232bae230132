"""Nearest items against all pairs, with small groups and limits."""

import numpy as np
import pytest

from tamarack.operators import neighbours


def knn(pairs, k):
    users = {}
    for u, m in pairs:
        users.setdefault(u, []).append(m)
    n, both = {}, {}
    for own in users.values():
        for i in own:
            n[i] = n.get(i, 0) + 1
            for j in own:
                if i != j:
                    both[i, j] = both.get((i, j), 0) + 1
    near = {}
    for (i, j), c in both.items():
        near.setdefault(i, []).append((-round(c / np.sqrt(n[i] * n[j]), 10), j))
    return sorted((i, j, r + 1, round(float(-s), 10)) for i, own in near.items() for r, (s, j) in enumerate(sorted(own)[:k]))


@pytest.mark.parametrize("group, heavy, width", [(2048, 512, 4), (10, 6, 2), (7, 2, 40), (100, 1, 3)])
def test_item_knn(spark, monkeypatch, group, heavy, width):
    monkeypatch.setattr(neighbours, "GROUP", group)
    monkeypatch.setattr(neighbours, "HEAVY", heavy)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    rng = np.random.default_rng(group)
    pairs = {(int(u), int(m) * 5) for u, m in zip(rng.integers(0, 30, 260), rng.zipf(1.5, 260) % 60, strict=True)} | {(99, m * 5) for m in range(60)} | {(-4, m * 5) for m in range(0, 60, 2)} | {(98, 1)}
    df = spark.createDataFrame(sorted(pairs), "userId long, movieId long").repartition(5)
    try:
        out = neighbours.item_knn(df, 4)
        assert sorted((r.movieId, r.otherId, r.place, round(r.similarity, 10)) for r in out.collect()) == knn(pairs, 4)
        assert neighbours.item_knn(df.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("rare", [0, 3, 1000])
def test_similar_by_terms(spark, monkeypatch, rare):
    """A term that 80 per cent of the items have, items with rare terms only, items with nothing in common."""
    monkeypatch.setattr(neighbours, "RARE", rare)
    rng = np.random.default_rng(8)
    x = np.where(rng.random((60, 45)) < 0.06, rng.random((60, 45)), 0)
    x[:48, 0] = 0.05
    x[50] = x[51] = 0
    x[50, 44] = 2
    x[52] = 3 * x[53]  # equal in direction
    rows = [(i * 2, f"t{t}", float(x[i, t])) for i in range(60) for t in np.flatnonzero(x[i])]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(unit @ unit.T, 10)
    np.fill_diagonal(s, 0)
    want = [(2 * i, 2 * int(j), r + 1, round(float(s[i, j]), 10)) for i in range(60) for r, j in enumerate([j for j in np.lexsort((np.arange(60), -s[i])) if s[i, j] > 0][:5])]
    df = spark.createDataFrame(rows, "movieId long, term string, w double").repartition(3)
    out = neighbours.similar_by_terms(df, 5)
    assert sorted((r.movieId, r.otherId, r.place, round(r.score, 10)) for r in out.collect()) == sorted(want)
    assert neighbours.similar_by_terms(df.where("false")).count() == 0


def test_vectors_with_many_equal_products(spark):
    from tamarack.operators import content

    rng = np.random.default_rng(5)
    own = [rng.normal(size=4).round(1).tolist() for _ in range(9)]
    rows = [(3 * i, own[int(rng.integers(9))]) for i in range(200)] + [(1000, [0.0] * 4)]
    df = spark.createDataFrame(rows, "movieId long, embedding array<float>")
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = np.round(v @ v.T, 10)
    want = []
    for i, row in enumerate(s):
        found = sorted((-x, int(j)) for x, j in zip(row, ids) if j != ids[i])[:4]
        want += [(int(ids[i]), j, p + 1, round(-x, 6)) for p, (x, j) in enumerate(found)]
    for block in (16, 2048):
        out = content.similar_by_vectors(df, 4, block).collect()
        assert sorted((r.movieId, r.otherId, r.place, round(r.score, 6) + 0.0) for r in out) == sorted((a, b, c, d + 0.0) for a, b, c, d in want)


def test_blocks_of_vectors_grow(spark):
    from pyspark.sql import functions as F

    from tamarack.operators import content

    rows = spark.range(60_000).select(F.col("id").alias("movieId"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    plan = content.similar_by_vectors(rows, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert ", 42), 4)" in plan and ", 42), 30)" not in plan  # blocks
