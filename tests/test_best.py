"""The best items of every query over many small blocks, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import best


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(best, "ITEMS", 40)
    monkeypatch.setattr(best, "QUERIES", 7)


def vectors(rng, n, width=6, lengths=1.0):
    """Dense vectors of very different lengths, some equal, one zero."""
    x = rng.normal(size=(n, width)) * lengths * rng.exponential(size=(n, 1))
    x[n // 2] = x[n // 3]
    x[n // 5] = 0
    return x


def frame(spark, x, name, suffix="", first=0, **more):
    rows = [(i * 3 + first, *(float(v[i]) for v in more.values()), *([float(z) for z in y[i]] for y in (x if isinstance(x, list) else [x]))) for i in range(len(x[0] if isinstance(x, list) else x))]
    cols = ", ".join(f"x{s} array<double>" for s in (suffix if isinstance(suffix, tuple) else (suffix,)))
    return spark.createDataFrame(rows, f"{name} long, {''.join(f'{c} double, ' for c in more)}{cols}").repartition(3)


def sparse_frame(spark, x, name):
    rows = [(i * 3, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, t array<long>, x array<double>")


def top(scores, hidden, k):
    out = []
    for q, row in enumerate(scores):
        order = [i for i in np.lexsort((np.arange(len(row)), -row)) if (q, i) not in hidden and np.isfinite(row[i])][:k]
        out += [(3 * q, 3 * int(i), r + 1, round(float(row[i]), 9)) for r, i in enumerate(order)]
    return out


def got(df):
    return sorted((r.query, r.item, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def hidden():
    rng = np.random.default_rng(9)
    return {(int(q), int(i)) for q, i in zip(rng.integers(0, 25, 600), rng.integers(0, 230, 600), strict=True)} | {(3, i) for i in range(230)}


@pytest.fixture(scope="module")
def seen(spark, hidden):
    return spark.createDataFrame([(3 * q, 3 * i) for q, i in hidden] + [(0, 10**6), (999, 0)], "query long, item long")


def test_dense_products(spark, hidden, seen):
    rng = np.random.default_rng(1)
    q, x = vectors(rng, 25), vectors(rng, 230)
    want = top(np.round(q @ x.T, 10), hidden, 5)
    assert got(best.best_products(frame(spark, q, "query"), frame(spark, x, "item"), 5, seen)) == sorted(want)


def test_one_item_longer_than_all_others(spark):
    """It points to all queries, so later blocks can add nothing to a list of one; some queries are zero and have no bound."""
    x = np.vstack([[100.0, 100.0], np.random.default_rng(2).normal(size=(199, 2))])
    q = np.abs(np.random.default_rng(3).normal(size=(20, 2))) + 0.1
    q[5] = 0
    for k in (1, 3, 300):
        assert got(best.best_products(frame(spark, q, "query"), frame(spark, x, "item"), k)) == sorted(top(np.round(q @ x.T, 10), set(), k))


def test_sparse_products(spark, hidden, seen):
    rng = np.random.default_rng(4)
    q, x = (np.where(rng.random((n, 30)) < 0.15, rng.random((n, 30)), 0) for n in (25, 230))
    q[:, 0] = 0.3  # a term that all have
    x[:200, 0] = 0.2
    q[7] = x[9] = 0
    scores = np.round(q @ x.T, 10)
    assert got(best.best_products(sparse_frame(spark, q, "query"), sparse_frame(spark, x, "item"), 6, seen)) == sorted(top(scores, hidden, 6))
    some = best.best_products(sparse_frame(spark, q, "query"), sparse_frame(spark, x, "item"), 6, seen, positive=True)
    assert got(some) == sorted(top(np.where(scores > 0, scores, -np.inf), hidden, 6))


def scaled(scores):
    out = np.zeros(scores.shape)
    for k, row in enumerate(scores):
        order = np.sort(row)
        if order[0] != order[-1]:
            out[k] = (np.searchsorted(order, row, "left") + np.searchsorted(order, row, "right") - 1) / 2 / (len(row) - 1)
    return out


@pytest.mark.parametrize("weights", [(0.5, 0.4), (0.0, 1.0), (1.0, 0.0)])
def test_hybrids(spark, hidden, seen, weights):
    rng = np.random.default_rng(5)
    q, x = [vectors(rng, 25) for _ in "ab"], [vectors(rng, 230) for _ in "ab"]
    q[1] = np.round(q[1])  # many equal scores
    x[1] = np.round(x[1])
    q[0][4] = q[1][4] = 0  # all scores of a query are equal
    static = np.round(rng.random(230), 1)
    raw = [np.round(a @ b.T, 10) for a, b in zip(q, x, strict=True)]
    want = np.round(static + weights[0] * scaled(raw[0]) + weights[1] * scaled(raw[1]), 10)
    df = best.best_hybrids(frame(spark, q, "query", ("1", "2")), frame(spark, x, "item", ("1", "2"), static=static), (best.Part(weights[0], "1"), best.Part(weights[1], "2")), 5, seen)
    assert got(df) == sorted(top(want, hidden, 5))
    for r in df.limit(30).collect():
        a, b = r.query // 3, r.item // 3
        assert np.allclose(r.raw, [m[a, b] for m in raw]) and np.allclose(r.scaled, [scaled(m)[a, b] for m in raw])


def test_sparse_hybrids_with_missing_vectors(spark, hidden, seen):
    rng = np.random.default_rng(6)
    q, x = (np.where(rng.random((n, 30)) < 0.1, rng.random((n, 30)), 0) for n in (25, 230))
    q[2] = x[:100] = 0
    none = F.when(F.size("t") > 0, F.col("t")).alias("t"), F.when(F.size("t") > 0, F.col("x")).alias("x")
    static = rng.random(230)
    items = sparse_frame(spark, x, "item").select("item", *none).join(spark.createDataFrame([(3 * i, float(s)) for i, s in enumerate(static)], "item long, static double"), "item")
    df = best.best_hybrids(sparse_frame(spark, q, "query").select("query", *none), items, (best.Part(0.6),), 4, seen)
    assert got(df) == sorted(top(np.round(static + 0.6 * scaled(np.round(q @ x.T, 10)), 10), hidden, 4))


def test_bounds_hold_every_rank(spark):
    rng = np.random.default_rng(7)
    blocks = [np.round(rng.normal(size=n), 1) for n in (500, 3, 1, 900)]
    every = np.concatenate(blocks)
    grid = best.bounds([(*best.points(b), len(b)) for b in blocks])
    lo, hi = best.rank_bounds(every, grid, len(every))
    true = scaled(every[None])[0]
    assert (lo <= true + 1e-12).all() and (true <= hi + 1e-12).all()


def test_catalog_scaled(spark):
    values = [1.0, None, 2.0, 2.0, float("nan"), 5.0, float("inf"), 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "item long, v double")
    out = {r.item: r.s for r in best.catalog_scaled(df, "item", "v", "s").collect()}
    plain = scaled(np.array([[-1e300 if v is None or not np.isfinite(v) else v for v in values]]))[0]
    assert all(abs(out[i] - plain[i]) < 1e-12 for i in range(len(values)))
    flat = best.catalog_scaled(df.withColumn("v", F.lit(3.0)), "item", "v", "s")
    assert {r.s for r in flat.collect()} == {0.0} and flat.where("false").count() == 0


def test_empty_tables(spark):
    q, x = (frame(spark, np.ones((3, 2)), n) for n in ("query", "item"))
    assert best.best_products(q, x.where("false")).count() == 0 and best.best_products(q.where("false"), x).count() == 0
    static = x.withColumn("static", F.lit(0.0))
    assert best.best_hybrids(q.where("false"), static).count() == 0 and best.best_hybrids(q, static.where("false")).count() == 0


def test_only_pairs_that_take_part_are_left_out(spark):
    from tamarack.operators import best

    seen = spark.range(1000).select((F.col("id") % 10).alias("query"), F.col("id").alias("item"))
    queries, items = spark.createDataFrame([(1,), (2,)], "query long"), spark.createDataFrame([(11,), (12,), (13,)], "item long")
    assert sorted(map(tuple, best.taking_part(seen, queries, items).select("query", "item").collect())) == [(1, 11), (2, 12)]
    dense = lambda rows, key: spark.createDataFrame([(k, [float(k), 1.0]) for k in rows], f"{key} long, x array<double>")
    out = best.best_products(dense((1, 2), "query"), dense((11, 12, 13), "item"), 2, seen)
    assert sorted((r.query, r.item) for r in out.collect()) == [(1, 12), (1, 13), (2, 11), (2, 13)]
