"""Title matching, peeling and sampling against plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from tamarack.operators import matching, prepare


def score(a, y, b, z):
    u, v = set(a.split()), set(b.split())
    base = 100 if a == b else 85 if a in b or b in a else len(u & v) * 80 // len(u | v)
    return base + (5 if y is None or z is None else 20 if y == z else 10 if abs(y - z) == 1 else 0)


@pytest.mark.parametrize("least", [60, 70, 101])
def test_titles(spark, least):
    rng = random.Random(least)
    words = [f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(400)]
    titles = [" ".join(dict.fromkeys(rng.choice(words) for _ in range(rng.randint(1, 6)))) for _ in range(90)] + ["w0", "w1 w2", "w30", "zz only", "bw1 w2x", "ew1 w2 w3 w4f w3", "w1 w2 w3 w4"]
    rows = [(i, t, rng.choice((1990, 1991, 1999, None))) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows + [(1000, "", 1990), (1001, None, 1990)], "id long, title string, year int")
    got = sorted(tuple(r) for r in matching.match_titles(df, df, least, 3).collect())
    want = []
    for i, a, y in rows:
        found = [(-score(a, y, b, z), j) for j, b, z in rows if j != i and set(a.split()) & set(b.split()) and score(a, y, b, z) >= least]
        want += [(i, j, -s, k + 1) for k, (s, j) in enumerate(sorted(found)[:3])]
    assert got == sorted(want)


def peeled(rows, a, b, rounds=None):
    while rounds is None or rounds:
        u, m = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
        left = [r for r in rows if u[r[0]] >= a and m[r[1]] >= b]
        if len(left) == len(rows):
            break
        rows, rounds = left, None if rounds is None else rounds - 1
    return sorted(rows)


@pytest.mark.parametrize("rounds", [None, 1, 4])
def test_a_chain_takes_many_rounds(spark, rounds):
    chain = [(f"u{i}", f"m{i + d}", 2 * i + d) for i in range(9) for d in (0, 1)]  # a path: every round takes its ends
    square = [(f"x{i}", f"y{j}", 100 + 3 * i + j) for i in range(3) for j in range(3)] + [("x0", "y0", 200)]
    df = spark.createDataFrame(chain + square, "user_id string, movie_id string, seq int")
    assert sorted(tuple(r) for r in prepare.k_core(df, 2, 2, rounds).collect()) == peeled(chain + square, 2, 2, rounds)
    assert prepare.k_core(df, 99, 1).count() == 0 and prepare.k_core(df.where("false"), 2, 2).count() == 0


@pytest.mark.parametrize("n, few", [(0, 1), (1, 1), (37, 1), (37, 5), (500, 100), (999, 10_000), (5000, 3)])
def test_exact_samples(spark, n, few):
    df = spark.range(1000).withColumnRenamed("id", "k").repartition(5)
    want = sorted(range(1000), key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())[:n]
    assert sorted(r.k for r in prepare.seeded_sample(df, "k", n, 42, few).collect()) == sorted(want)


def test_copies_of_a_title_make_no_pairs(spark, monkeypatch):
    titles = [f"{a} {b}" for a in ("red", "new", "hot") for b in ("bolt", "rod")] + ["red"]
    rows = [(i, titles[i * 7 % len(titles)], 1990 + i % 2 if i % 5 else None) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, title string, year int")
    sizes, kept = [], matching.checkpointed
    monkeypatch.setattr(matching, "checkpointed", lambda d: (sizes.append(kept(d)), sizes[-1])[1])
    got = sorted(tuple(r) for r in matching.match_titles(df, df, 70, 5).collect())
    want = []
    for i, a, y in rows:
        found = [(-score(a, y, b, z), j) for j, b, z in rows if j != i and set(a.split()) & set(b.split()) and score(a, y, b, z) >= 70]
        want += [(i, j, -s, k + 1) for k, (s, j) in enumerate(sorted(found)[:5])]
    assert got == sorted(want)
    assert max(d.count() for d in sizes[1:]) <= 3 * len(titles) * 2  # classes and their words, not 140 titles
