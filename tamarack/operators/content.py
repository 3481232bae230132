"""Item texts, TF-IDF in long form, and similarity of items and profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import flat
from ..functions.vectors import dot, unit
from ..session import checkpointed
from .best import AT_ONCE, SLACK, best_products, numbered_terms, sparse
from .classes import best_by_classes, classes_of, listed_queries, sums_by_classes

#: English words without weight.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "could", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "more", "my", "no", "not", "of",
    "on", "one", "or", "other", "our", "out", "she", "so", "some", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to",
    "up", "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your",
)
#: Vectors of a block of dense products, at most.
LARGEST = 16_384
#: Fixed order of the columns that make up an item's text.
TEXT_COLUMNS = ("title", "genres", "overview", "tagline", "director", "cast", "keywords", "tag_genome_tags", "original_language", "production_companies", "production_countries", "collection_name", "certification", "tags")


def item_text(items: DataFrame) -> Column:
    """The item's text columns that exist, in order, with | as a space."""
    parts = [F.nullif(F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", " ")), F.lit("")) for c in TEXT_COLUMNS if c in items.columns]
    return F.concat_ws(" ", *parts)


def tokens(text: Column, stop: Sequence[str] = STOP_WORDS, bigrams: bool = True) -> Column:
    """Lower-case words of two letters or more without stop words, then the pairs of neighbours among those."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop))
    if not bigrams:
        return words
    pairs = lambda ws: F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(words), lambda ws: F.concat(ws, pairs(ws))), 1)


def term_counts(docs: DataFrame, text: Column, bigrams: bool = True) -> DataFrame:
    """movieId, term, tf."""
    return docs.select("movieId", F.explode(tokens(text, bigrams=bigrams)).alias("term")).groupBy("movieId", "term").agg(F.count("*").alias("tf"))


def pruned(counts: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.85, top: int | None = None) -> DataFrame:
    """counts with `df`, of terms in min_df documents or more and in a share max_df of them or less; all terms if none is.

    With `top`, only that many terms, by total count, ties to the smaller term.
    """
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n_docs))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if kept.isEmpty():
        kept = df
    if top:
        kept = kept.orderBy(F.desc("total"), "term").limit(top)
    return counts.join(kept.select("term", "df"), "term")


def tf_idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """movieId, term, w: tf (ln((1 + n) / (1 + df)) + 1), each document of length 1. Squares are added in order of the term, so equal documents have equal weights."""
    raw = counts.crossJoin(F.broadcast(n_docs)).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("movieId").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return raw.withColumn("w", F.col("w") / length).select("movieId", "term", "w")


def ranked(scores: DataFrame, top_k: int, by: str = "movieId", tie: str = "otherId") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))
    return scores.withColumn("place", place).where(F.col("place") <= top_k)


def similar_by_vectors(vectors: DataFrame, top_k: int = 10, block: int = 2048) -> DataFrame:
    """The same for dense vectors(movieId, embedding): items are dealt into blocks of `block` at least, and each pair of blocks is one task's product.

    Blocks grow to LARGEST as long as there are some for every core, as each vector moves once for each block. A task
    holds two blocks and multiplies a few items at a time; of these only products that reach an item's top_k-th are
    rounded and sorted, and all lists of an item are ranked again.
    """
    n = vectors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-n // block), max(-(-n // LARGEST), int(np.ceil(np.sqrt(4 * cores))))))
    own = vectors.select("movieId", "embedding", F.pmod(F.xxhash64("movieId"), F.lit(blocks)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = own.withColumn("c", every), own.withColumnRenamed("b", "c").withColumn("b", every)

    def product(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if x.num_rows and y.num_rows:
            y = y.sort_by("movieId")
            a, b = (flat(z["embedding"])[0].astype(np.float64).reshape(z.num_rows, -1) for z in (x, y))
            a, b = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) for z in (a, b))
            ids, others = x["movieId"].to_numpy(), y["movieId"].to_numpy()
            for lo in range(0, len(ids), AT_ONCE):
                mine = ids[lo : lo + AT_ONCE]
                s = a[lo : lo + AT_ONCE] @ b.T
                at = np.minimum(np.searchsorted(others, mine), len(others) - 1)
                same = np.flatnonzero(others[at] == mine)
                s[same, at[same]] = -np.inf
                least = np.partition(s, len(others) - top_k, axis=1)[:, len(others) - top_k] if len(others) > top_k else np.full(len(mine), -np.inf)
                row, col = np.nonzero((s >= least[:, None] - SLACK) & np.isfinite(s))
                score = np.round(s[row, col], 10)
                order = np.lexsort((col, -score, row))  # others ascend
                order = order[np.arange(len(order)) - np.searchsorted(row, row) < top_k]  # rows ascend before and after
                for o, v in zip(out, (mine[row[order]], others[col[order]], score[order]), strict=True):
                    o.append(v)
        return pa.table([np.concatenate(o) for o in out], ["movieId", "otherId", "score"])

    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(product, "movieId long, otherId long, score double")
    return ranked(found, top_k)


#: Values of all distinct vectors (terms and weights), at most, that a task may be sent beside its users.
VALUES = 2_000_000


def profiles(history: DataFrame, weights: DataFrame) -> DataFrame:
    """userId, term, p: mean of the vectors of history(userId, movieId).

    Pairs move as ids, and once more by user. Items that share a vector share a class. Where the distinct vectors are few
    they come to the users, so that no term moves for each pair; else terms are added up in tasks and again by user.
    """
    rows = history.select("userId", "movieId").distinct()
    n = rows.groupBy("userId").agg(F.count("*").alias("n"))
    mean = lambda sums: sums.join(n, "userId").select("userId", "term", (F.col("s") / F.col("n")).alias("p"))
    weights = checkpointed(weights)
    vectors = weights.groupBy("movieId").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("v")).select(F.col("movieId").alias("item"), "v")
    found = classes_of(vectors, ("v",), VALUES // 8)
    if found is None or (found[0].agg(F.sum(F.size("v"))).first()[0] or 0) > VALUES:
        return mean(rows.join(weights, "movieId").groupBy("userId", "term").agg(F.sum("w").alias("s")))
    classes = rows.join(found[1].select(F.col("item").alias("movieId"), "cls"), "movieId").repartition("userId").groupBy("userId", "cls").agg(F.count("*").alias("m"))
    terms = classes.join(F.broadcast(found[0].select("cls", "v")), "cls").select("userId", "m", F.explode("v").alias("e"))
    return mean(terms.groupBy("userId", F.col("e.term").alias("term")).agg(F.sum(F.col("m") * F.col("e.w")).alias("s")))


def profile_scores(profile: DataFrame, weights: DataFrame) -> DataFrame:
    """userId, movieId, score: cosine of profile and item; pairs without a common term are left out (0)."""
    length = profile.groupBy("userId").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("pl"))
    items = weights.groupBy("movieId").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("wl"))
    raw = profile.join(weights, "term").groupBy("userId", "movieId").agg(F.sum(F.col("p") * F.col("w")).alias("d"))
    return raw.join(length, "userId").join(items, "movieId").select("userId", "movieId", F.round(F.col("d") / F.nullif(F.col("pl") * F.col("wl"), F.lit(0.0)), 10).alias("score"))


def profile_sides(profile: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries(query, t, x) and items(item, t, x) of length 1, with terms as numbers."""
    terms = numbered_terms(weights)
    side = lambda rows, key, value, name: sparse(rows, key, value, terms).select(F.col(key).cast("long").alias(name), "t", unit(F.col("x")).alias("x"))
    return side(profile, "userId", "p", "query"), side(weights, "movieId", "w", "item")


def profile_sums(profile: DataFrame, weights: DataFrame, weight: Column) -> DataFrame:
    """userId, items, total, weighted: of every user's profile_scores(), the number, the sum and the sum times `weight` (of movieId); scores meet in their task, not in rows."""
    queries, items = profile_sides(profile, weights)
    found = classes_of(items.withColumn("static", F.lit(0.0)), ("t", "x"))
    if found is not None:
        sums = sums_by_classes(queries, (found[0], found[1].withColumn("movieId", F.col("item"))), None, ("",), weight)
        return sums.where("items > 0").withColumnRenamed("query", "userId")
    rows = profile_scores(profile, weights)
    return rows.groupBy("userId").agg(F.count("*").alias("items"), F.sum("score").alias("total"), F.sum(F.col("score") * weight).alias("weighted"))


def item_vectors(weights: DataFrame) -> DataFrame:
    """(item, t, x) of weights(movieId, term, w), of length 1, kept. A term is its 64-bit hash, so that terms need no numbers and don't move once more."""
    by = weights.where("movieId is not null").groupBy("movieId").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("x")))).alias("v"))
    return checkpointed(by.select(F.col("movieId").cast("long").alias("item"), F.col("v.t").alias("t"), unit(F.col("v.x")).alias("x")))


def histories(rows: DataFrame, liked: Column) -> DataFrame:
    """history(query, item, liked) of rows(userId, movieId, ...)."""
    return rows.select(F.col("userId").cast("long").alias("query"), F.col("movieId").cast("long").alias("item"), F.coalesce(liked, F.lit(False)).alias("liked"))


def history_sums(history: DataFrame, weights: DataFrame, weight: Column) -> DataFrame:
    """profile_sums() of the profiles of history(userId, movieId), which move as lists of items where a task can hold the distinct vectors."""
    found = classes_of(item_vectors(weights).withColumn("static", F.lit(0.0)), ("t", "x"))
    if found is None:
        return profile_sums(profiles(history, weights), weights, weight)
    members = found[1].withColumn("movieId", F.col("item"))
    queries = listed_queries(histories(history, F.lit(True)), members).select("query", "liked")
    return sums_by_classes(queries, (found[0], members), None, ("",), weight).where("items > 0").withColumnRenamed("query", "userId")


def best_by_history(history: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """best_by_profile() of the profiles of history(userId, movieId), without the items of the history."""
    found = classes_of(item_vectors(weights).withColumn("static", F.lit(0.0)), ("t", "x"))
    if found is None:
        return best_by_profile(profiles(history, weights), weights, k, history)
    queries = listed_queries(histories(history, F.lit(True)), found[1])
    best = best_by_classes(queries, found, None, ("",), k, None, positive=True).select("query", "item", "score", "rank")
    return best.withColumnsRenamed({"query": "userId", "item": "movieId"})


def best_by_profile(profile: DataFrame, weights: DataFrame, k: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """userId, movieId, score, rank: of each profile(userId, term, p), the k items of weights(movieId, term, w) with the largest cosine above 0, without those in seen(userId, movieId)."""
    queries, items = profile_sides(profile, weights)
    hide = seen.select(F.col("userId").alias("query"), F.col("movieId").alias("item")) if seen is not None else None
    best = best_products(queries, items, k, hide, positive=True)
    return best.withColumnsRenamed({"query": "userId", "item": "movieId"})


def user_vectors(ratings: DataFrame, vectors: DataFrame, threshold: float = 4.0) -> DataFrame:
    """userId, vector: mean of the vectors of a user's positives, or of all rated items without any; length 1."""
    has = F.max((F.col("rating") >= threshold).cast("int")).over(Window.partitionBy("userId"))
    rows = ratings.withColumn("has", has).where((F.col("has") == 0) | (F.col("rating") >= threshold)).join(vectors, "movieId")
    mean = rows.select("userId", F.posexplode("embedding").alias("pos", "x")).groupBy("userId", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("userId").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("v")).select("userId", unit(F.col("v")).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))
