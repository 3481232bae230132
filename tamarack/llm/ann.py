"""Approximate nearest neighbours: inverted lists of coarse centroids over product-quantised residuals.

Centroids and code books are fitted on a bounded sample; every vector is then assigned and encoded by
Spark. A query is sent to its nearest lists, as many as the sample's own neighbours need for the recall
TARGET: few where vectors form clusters, most where they do not. Rows of lists are dealt into blocks of
bounded size by a hash of the id, so that a crowded list has no task of its own. There, distances to
all codes come from one table for each query (asymmetric: the query is not quantised); the RERANKED
best of each block are ranked again by exact distance on the original vectors, which lie beside the
codes, so the number of exact distances grows with the table and no vector moves twice.

Codes are made of vectors scaled by a power of two to about unit size and clipped, so a few huge
vectors neither overflow nor spoil the centroids. Exact distances are scaled where squares would overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted

#: Vectors that centroids and code books are fitted on, at most, and queries among them that the probing is measured on.
SAMPLE, MEASURED = 12_000, 400
#: Bytes of a code: sub-spaces, of 256 words each.
SUBSPACES = 16
#: Share of the sample's true neighbours whose lists must be probed, and lists probed at least.
TARGET, PROBED_LEAST = 0.975, 16
#: Candidates of a query in a block that are ranked exactly.
RERANKED = 300
#: Codes that one task compares at a time.
BLOCK_ROWS = 40_000
#: Queries that one task answers at a time, and tasks over which the lists are dealt, at least.
BLOCK_QUERIES, GROUPS = 20_000, 8
#: Scaled components beyond this are cut for codes.
CLIP = 1024.0


@dataclass
class Index:
    """Coarse centroids [lists, d], code books [subspaces, 256, width] (padded to whole sub-spaces), scale and lists to probe."""

    centroids: np.ndarray
    books: np.ndarray
    width: int
    scale: float
    probed: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Vectors as float32, in the units of the codes."""
        return np.clip(x / self.scale, -CLIP, CLIP).astype(np.float32)

    def parts(self, x: np.ndarray) -> np.ndarray:
        m = len(self.books)
        out = np.zeros((len(x), m * self.width), np.float32)  # the last part may be padded
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, self.width)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        own = self.parts(x - self.centroids[lists])
        return np.stack([nearest(own[:, j], self.books[j]) for j in range(len(self.books))], 1).astype(np.uint8)

    def decoded(self, code: np.ndarray, d: int) -> np.ndarray:
        return self.books[np.arange(code.shape[1]), code].reshape(len(code), -1)[:, :d]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """[queries, subspaces, 256]: product of each part of a query with each word."""
        return np.einsum("qjw,jkw->qjk", self.parts(queries), self.books)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision; scaled by a power of two where squares would overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        z = x - y
        out = np.sqrt((z**2).sum(-1))
    for i in np.flatnonzero(~np.isfinite(out)):
        _, e = np.frexp(np.abs(np.stack([x[i], y[i]])).max())
        own = np.ldexp(x[i], -int(e) - 1) - np.ldexp(y[i], -int(e) - 1)
        with np.errstate(over="ignore"):
            out[i] = np.ldexp(np.sqrt((own**2).sum()), int(e) + 1)
    return out


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (words**2).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (norms - 2 * x[i : i + 4096] @ words.T).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    words = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, words)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(words, dtype=np.float64)
        np.add.at(sums, own, x)
        has = n > 0
        words[has] = (sums[has] / n[has, None]).astype(np.float32)
    return words


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of vectors that take part."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    return vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )


def fit(clean: DataFrame, sample: int = SAMPLE, subspaces: int = SUBSPACES, seed: int = 7) -> tuple[Index, int, int] | None:
    """Index, dimension (the commonest) and number of vectors of that dimension; fitted on about `sample` vectors; None without vectors."""
    sizes = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    d, n = sizes
    share = min(1.0, sample / n)
    drawn = clean.where((F.size("vector") == d) & (F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1_000_003)) <= F.lit(share * 1_000_003)))
    x = np.array([r[0] for r in drawn.select("vector").limit(2 * sample).collect()] or [r[0] for r in clean.where(F.size("vector") == d).select("vector").limit(sample).collect()])
    _, e = np.frexp(np.median(np.abs(x).max(axis=1)))
    index = Index(np.zeros((1, d)), np.zeros((1, 1, 1)), 1, float(np.ldexp(1.0, int(e))), 1)
    x = np.unique(index.scaled(x), axis=0)
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(len(x) // 8, round(np.sqrt(n)))))
    index.centroids = k_means(x, lists, 8, rng)
    m = min(subspaces, d)
    index.width = -(-d // m)
    index.books = np.zeros((m, 1, index.width), np.float32)
    own = index.assign(x)
    residual = index.parts(x - index.centroids[own])
    books = [k_means(residual[:, j], 256, 6, rng) for j in range(m)]
    most = max(len(b) for b in books)
    index.books = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books])
    index.probed = probes(x, own, index.centroids, rng)
    return index, d, n


def probes(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, rng: np.random.Generator, k: int = 10) -> int:
    """The lists, nearest first, among which TARGET of the sample's true neighbours lie."""
    asked = rng.choice(len(x), min(MEASURED, len(x)), replace=False)
    ranks = []
    for i in range(0, len(asked), 64):
        q = asked[i : i + 64]
        far = (x**2).sum(1) - 2 * x[q] @ x.T
        far[np.arange(len(q)), q] = np.inf
        near = np.argsort(far, axis=1)[:, : min(k, len(x) - 1)]
        order = np.argsort(np.argsort((centroids**2).sum(1) - 2 * x[q] @ centroids.T, axis=1), axis=1)
        ranks.append(np.take_along_axis(order, own[near], axis=1).ravel())
    got = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, int)
    need = int(got[min(len(got) - 1, int(TARGET * len(got)))]) + 1 if len(got) else 1
    return min(len(centroids), max(PROBED_LEAST, need))


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", reranked: int = RERANKED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which is_query holds.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id, and a query's
    id is no candidate of its own. Vectors that are null, zero, of another dimension than most, or that
    hold null or non-finite components take no part, as queries or as candidates. Rows that repeat an
    id: as candidates, the nearest of them counts; as queries, the least vector asks. is_query is a
    condition on the column vec_id. An empty table, or a query without candidates, gives no rows.
    """
    spark = vectors.sparkSession
    clean = usable(vectors, id_col, vector_col)
    fitted = fit(clean)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, d, n_rows = fitted
    shared = spark.sparkContext.broadcast(index)
    rows = clean.where(F.size("vector") == d)
    floats = lambda c: c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()].reshape(-1, d)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Beside each vector its list, its code, and what of its distance does not depend on the query."""
        own = shared.value
        for b in batches:
            if b.num_rows:
                x = own.scaled(floats(b.column(1)))
                at = own.assign(x)
                code = own.encode(x, at)
                r = own.decoded(code, d)
                fixed = (r**2).sum(1) + 2 * (own.centroids[at] * r).sum(1)
                raw = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), raw, pa.array(fixed.astype(np.float32)), b.column(1)], ["vec_id", "list", "code", "fixed", "vector"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query for each group of lists that it probes."""
        own = shared.value
        for b in batches:
            if b.num_rows:
                q = own.scaled(floats(b.column(1)))
                far = (own.centroids**2).sum(1) - 2 * q @ own.centroids.T
                near = np.sort(np.argpartition(far, own.probed - 1, axis=1)[:, : own.probed], axis=1)
                out = [(i, g, at[at % GROUPS == g]) for i, at in enumerate(near) for g in np.unique(at % GROUPS).tolist()]
                of = pa.array([i for i, _, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array([g for _, g, _ in out], pa.int32()), pa.array([x.astype(np.int32) for _, _, x in out], pa.list_(pa.int32())), b.column(1).take(of)], ["query_id", "group", "lists", "query"])

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(codes: pa.Table, queries: pa.Table) -> pa.Table:
        nothing = schema.empty_table()
        if not codes.num_rows or not queries.num_rows:
            return nothing
        own = shared.value
        codes, queries = codes.combine_chunks(), queries.combine_chunks()
        one = lambda t, c: t.column(c).chunk(0)
        vector, code = floats(one(codes, "vector")), np.frombuffer(b"".join(one(codes, "code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
        ids, at_list = one(codes, "vec_id").to_numpy(), one(codes, "list").to_numpy()
        order = np.lexsort((*vector.T[:2], ids, at_list))
        again = np.concatenate([[False], (ids[order][1:] == ids[order][:-1]) & (vector[order][1:] == vector[order][:-1]).all(1)])  # repeated rows
        order = order[~again]
        ids, at_list, code, vector, fixed = ids[order], at_list[order], code[order], vector[order], one(codes, "fixed").to_numpy()[order]
        place = np.arange(code.shape[1])
        asked, lists = floats(one(queries, "query")), one(queries, "lists")
        scaled, out = own.scaled(asked), []
        for i, q in enumerate(one(queries, "query_id").to_numpy().tolist()):
            if i % 64 == 0:
                tables = own.tables(scaled[i : i + 64])
            probed = lists[i].values.to_numpy()
            lo, hi = np.searchsorted(at_list, probed), np.searchsorted(at_list, probed, "right")
            n = hi - lo
            some = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            some = some[ids[some] != q]
            if not len(some):
                continue
            base = ((scaled[i] - own.centroids) ** 2).sum(1)
            far = base[at_list[some]] + fixed[some] - 2 * tables[i % 64][place, code[some]].sum(1)
            if len(some) > reranked:  # all that are as near as the last of the best, then ties to smaller ids
                limit = np.partition(far, reranked - 1)[reranked - 1]
                keep = np.flatnonzero(far <= limit)
                some = some[keep[np.lexsort((ids[some[keep]], far[keep]))[:reranked]]]
            exact = distances(np.broadcast_to(asked[i], (len(some), d)), vector[some])
            best = np.lexsort((ids[some], exact))
            best = best[np.sort(np.unique(ids[some[best]], return_index=True)[1])[:k]]
            out.append((np.full(len(best), q), ids[some[best]], exact[best]))
        if not out:
            return nothing
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    coded = rows.mapInArrow(encode, "vec_id long, list int, code binary, fixed float, vector array<double>")
    own_queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_queries = rows.where(is_query).count()
    queries = own_queries.mapInArrow(route, "query_id long, group int, lists array<int>, query array<double>")
    row_blocks, query_blocks = max(1, -(-n_rows // (BLOCK_ROWS * GROUPS))), max(1, -(-n_queries // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    blocked = coded.select(F.pmod(F.col("list"), F.lit(GROUPS)).alias("group"), dealt("vec_id", row_blocks).alias("block"), every(query_blocks).alias("turn"), "vec_id", "list", "code", "fixed", "vector")
    sent = queries.select("group", every(row_blocks).alias("block"), dealt("query_id", query_blocks).alias("turn"), "query_id", "lists", "query")
    keys = ["group", "block", "turn"]
    found = blocked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
