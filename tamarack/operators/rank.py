"""Hybrid ranking: rank-scaled components, the best items of every user, and reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import to_rating, top_rank, unit
from ..session import checkpointed
from .best import Part, best_hybrids, best_products, catalog_scaled, finite, numbered_terms, pair_ranks, sparse
from .classes import best_by_classes, classes_of, listed_queries, sums_by_classes
from .content import histories, item_vectors, profile_scores, profiles
from .scores import mean_profile

WEIGHTS = (0.55, 0.35, 0.10)


#: Rows of one user and value from which the value's rank is broadcast, so that no task joins more rows of one value.
OFTEN = 65_536


def with_scaled(rows: DataFrame, by: str, key: str, value: str, out: str, of: DataFrame | None = None, often: int | None = None) -> DataFrame:
    """rows with `out`: rank_scaled() of value within each `by`, of which no task holds all rows; key tells a group's rows apart.

    Distinct values are counted in ranges, and ranges placed by their sizes. Values of very many rows, of which there
    are few, meet their rows by broadcast; rows of others move once. `of` has the same values as rows and is what is
    counted; it is read once, and should be kept if rows are dear.
    """
    counts = (rows if of is None else of).groupBy(by, finite(F.col(value)).alias("__v")).agg(F.count("*").alias("__c"))
    parts = checkpointed(counts.repartitionByRange(by, "__v").withColumn("__part", F.spark_partition_id()))  # ranges are drawn from a sample: keep them
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(by, "__part").agg(F.sum("__c").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier(by).orderBy("__part")), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(by))).drop("__n")  # a row for each range of each `by`
    less = parts.withColumn("__less", F.coalesce(F.sum("__c").over(earlier(by, "__part").orderBy("__v")), F.lit(0))).join(before, [by, "__part"])
    scaled = F.when(F.col("__c") == F.col("__all"), 0.0).otherwise((F.col("__before") + F.col("__less") + (F.col("__c") - 1) / 2.0) / F.greatest(F.col("__all") - 1, F.lit(1)))
    ranks = checkpointed(less.select(by, "__v", "__c", scaled.alias("__r")))
    many = F.col("__c") > (OFTEN if often is None else often)
    frequent = ranks.where(many).select(by, "__v", F.col("__r").alias("__f"))
    spread = F.when(F.col("__f").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(key), F.lit(1 << 30)))  # rows that have their rank meet nothing, anywhere
    met = rows.withColumn("__v", finite(F.col(value))).join(F.broadcast(frequent), [by, "__v"], "left").withColumn("__s", spread.cast("long"))
    met = met.join(ranks.where(~many).select(by, "__v", F.lit(0).cast("long").alias("__s"), "__r"), [by, "__v", "__s"], "left")
    return met.withColumn(out, F.coalesce("__f", "__r")).drop("__v", "__s", "__f", "__r")


def scaled_components(raw: DataFrame) -> DataFrame:
    """raw(userId, movieId, cf, content, pop) over the whole catalog, with each component rank-scaled per user; raw is kept. A pair occurs once."""
    names = ("cf", "content", "pop")
    out = raw = checkpointed(raw.select("userId", "movieId", *[F.col(c).cast("double").alias(f"raw_{c}") for c in names]))
    for c in names:
        out = with_scaled(out, "userId", "movieId", f"raw_{c}", c, raw)
    return out.select("userId", "movieId", "raw_cf", "raw_content", *names)


def hybrid(components: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    a, b, c = weights
    return components.withColumn("score", F.round(a * F.col("cf") + b * F.col("content") + c * F.col("pop"), 10))


def top_k(scored: DataFrame, k: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """The k best of each user, ties to the smaller id, without pairs in seen(userId, movieId); null and non-finite scores go."""
    rows = scored.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    if seen is not None:
        rows = rows.join(seen.select("userId", "movieId").distinct(), ["userId", "movieId"], "left_anti")
    return rows.withColumn("rank", top_rank(F.col("score"), "userId", "movieId")).where(F.col("rank") <= k)


def scaled_catalog(catalog: DataFrame) -> DataFrame:
    """catalog(movieId, cf, pop) with both rank-scaled among all items; what is added to cf for a user changes no ranks."""
    return checkpointed(catalog_scaled(catalog, "movieId", "cf", "cf").join(catalog_scaled(catalog, "movieId", "pop", "pop"), "movieId"))


def hybrid_sides(users: DataFrame, catalog: DataFrame, profile: DataFrame, vectors: DataFrame, weights: tuple[float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What recommend() and hybrid_sums() rank: the catalog with scaled cf and pop; queries with their profiles; items with static (what cf and pop add) and vectors."""
    a, _, c = weights
    scaled = scaled_catalog(catalog)
    terms = numbered_terms(vectors)
    side = lambda rows, key, value, name: sparse(rows, key, value, terms).select(F.col(key).cast("long").alias(name), "t", unit(F.col("x")).alias("x"))
    items = scaled.select(F.col("movieId").cast("long").alias("item"), (a * F.col("cf") + c * F.col("pop")).alias("static")).join(side(vectors, "movieId", "w", "item"), "item", "left")
    queries = users.select(F.col("userId").cast("long").alias("query")).distinct().join(side(profile, "userId", "p", "query"), "query", "left")
    return scaled, queries, items


def recommend(users: DataFrame, catalog: DataFrame, profile: DataFrame, vectors: DataFrame, k: int = 10, weights: tuple[float, float, float] = WEIGHTS, seen: DataFrame | None = None) -> DataFrame:
    """userId, movieId, score, rank, cf, content, pop, raw_content: the k best items of every user, by rank-scaled components.

    catalog(movieId, cf, pop): cf must rank items alike for all users, as the item's bias does (what is
    added for a user changes no ranks). profile(userId, term, p) and vectors(movieId, term, w) give the
    content component, their cosine, 0 without a common term. seen(userId, movieId) are left out after
    scaling. No rows of users by items arise; a task holds a block of users and the classes of equal vectors.
    """
    scaled, queries, items = hybrid_sides(users, catalog, profile, vectors, weights)
    b = weights[1]
    hide = seen.select(F.col("userId").alias("query"), F.col("movieId").alias("item")) if seen is not None else None
    best = best_hybrids(queries, items, (Part(b),), k, hide)
    best = best.select(F.col("query").alias("userId"), F.col("item").alias("movieId"), "score", "rank", F.col("scaled")[0].alias("content"), F.col("raw")[0].alias("raw_content"))
    return best.join(scaled, "movieId")


def hybrid_sums(users: DataFrame, catalog: DataFrame, profile: DataFrame, vectors: DataFrame, weight: Column, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """userId, items, total, weighted: of every user's scores of all items, as recommend() has them, the number, the sum and the sum times `weight` (of movieId).

    Every pair is scored in its task, and no rows of users by items arise. A catalog of too many distinct vectors for
    a task is ranked in rows.
    """
    _, queries, items = hybrid_sides(users, catalog, profile, vectors, weights)
    found = classes_of(items, ("t", "x"))
    if found is not None:
        members = found[1].withColumn("movieId", F.col("item"))
        return sums_by_classes(queries, (found[0], members), (weights[1],), ("",), weight).withColumnRenamed("query", "userId")
    content = profile_scores(profile, vectors).withColumnRenamed("score", "content")
    pairs = queries.select(F.col("query").alias("userId")).crossJoin(items.select(F.col("item").alias("movieId"), "static")).join(content, ["userId", "movieId"], "left")
    pairs = checkpointed(pairs.withColumn("content", F.coalesce("content", F.lit(0.0))))
    scored = with_scaled(pairs, "userId", "movieId", "content", "scaled").withColumn("score", F.round(F.col("static") + weights[1] * F.col("scaled"), 10))
    return scored.groupBy("userId").agg(F.count("*").alias("items"), F.sum("score").alias("total"), F.sum(F.col("score") * weight).alias("weighted"))


def history_classes(catalog: DataFrame, vectors: DataFrame, weights: tuple[float, float, float]) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """The scaled catalog, and its items with static and vectors by classes, or None if they are too many for a task."""
    a, _, c = weights
    scaled = scaled_catalog(catalog)
    items = scaled.select(F.col("movieId").cast("long").alias("item"), (a * F.col("cf") + c * F.col("pop")).alias("static"))
    return scaled, classes_of(checkpointed(items.join(item_vectors(vectors), "item", "left")), ("t", "x"))


def recommend_by_history(rows: DataFrame, liked: Column, catalog: DataFrame, vectors: DataFrame, k: int = 10, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """recommend() for all users of rows(userId, movieId, ...), whose items are left out; profiles are those of the rows that are `liked`.

    Users move as lists of items, and their profiles are made in the tasks that hold the catalog's distinct vectors.
    """
    scaled, found = history_classes(catalog, vectors, weights)
    if found is None:
        return recommend(rows.select("userId").distinct(), catalog, profiles(rows.where(liked), vectors), vectors, k, weights, rows)
    queries = listed_queries(histories(rows, liked), found[1], rows.select(F.col("userId").cast("long").alias("query")))
    best = best_by_classes(queries, found, (weights[1],), ("",), k, None)
    best = best.select(F.col("query").alias("userId"), F.col("item").alias("movieId"), "score", "rank", F.col("scaled")[0].alias("content"), F.col("raw")[0].alias("raw_content"))
    return best.join(scaled, "movieId")


def history_sums(rows: DataFrame, liked: Column, catalog: DataFrame, vectors: DataFrame, weight: Column, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """hybrid_sums() for all users of rows(userId, movieId, ...), with the profiles of the rows that are `liked`."""
    _, found = history_classes(catalog, vectors, weights)
    if found is None:
        return hybrid_sums(rows.select("userId"), catalog, profiles(rows.where(liked), vectors), vectors, weight, weights)
    members = found[1].withColumn("movieId", F.col("item"))
    queries = listed_queries(histories(rows.where(liked), F.lit(True)), members, rows.where("userId is not null").select(F.col("userId").cast("long").alias("query")))
    return sums_by_classes(queries.select("query", "liked"), (found[0], members), (weights[1],), ("",), weight).withColumnRenamed("query", "userId")


def guests(session: DataFrame, cf: DataFrame, vectors: DataFrame, pop: DataFrame, k: int = 10, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """recommend_by_history() for guests, known by session(userId, movieId) only, whose items are left out.

    cf(movieId, cf) are the scores of an average user, the same for all; pop(movieId, popularity). Each component is
    rank-scaled over the whole catalog.
    """
    catalog = cf.join(pop, "movieId").select("movieId", "cf", F.col("popularity").alias("pop"))
    return recommend_by_history(session, F.lit(True), catalog, vectors, k, weights)


def best_by_factors(users: DataFrame, items: DataFrame, k: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """userId, movieId, score, rank: the k items with the largest products of users(userId, factors) and items(movieId, factors), without those in seen(userId, movieId)."""
    named = lambda df, key, name: df.select(F.col(key).cast("long").alias(name), F.col("factors").alias("x"))
    hide = seen.select(F.col("userId").alias("query"), F.col("movieId").alias("item")) if seen is not None else None
    best = best_products(named(users, "userId", "query"), named(items, "movieId", "item"), k, hide)
    return best.withColumnsRenamed({"query": "userId", "item": "movieId"})


def profile_items(session: DataFrame, ratings: DataFrame, threshold: float = 4.0) -> DataFrame:
    """(userId, movieId, place): session(userId, movieId, pos) items, then liked ones not among them."""
    liked = ratings.where(F.col("rating") >= threshold).groupBy("userId", "movieId").agg(F.min("timestamp").alias("pos")).withColumn("part", F.lit(1))
    both = session.select("userId", "movieId", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("part")).unionByName(liked)
    first = both.groupBy("userId", "movieId").agg(F.min(F.struct("part", "pos")).alias("o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("userId").orderBy("o", "movieId"))).select("userId", "movieId", "place")


def shared_genres(candidates: DataFrame, profile: DataFrame, movies: DataFrame) -> DataFrame:
    """candidates(userId, movieId) with `shared`: genres, sorted, that the profile's items have too."""
    genres = F.filter(F.split("genres", r"\|"), lambda g: (F.trim(g) != "") & (g != "(no genres listed)"))
    own = profile.join(movies, "movieId").select("userId", F.explode(genres).alias("g")).groupBy("userId").agg(F.collect_set("g").alias("mine"))
    rows = candidates.join(movies.select("movieId", genres.alias("theirs")), "movieId").join(own, "userId", "left")
    return rows.withColumn("shared", F.array_sort(F.array_intersect("theirs", F.coalesce("mine", F.array().cast("array<string>"))))).drop("theirs", "mine")


def reasons(content: Column, raw_cf: Column, mu: Column, shared: Column, director: Column) -> Column:
    """One to three explanations of a recommendation."""
    why = F.array(
        F.when((content > 0.15) & (F.size(shared) > 0), F.concat(F.lit("Shared genres: "), F.array_join(F.slice(shared, 1, 3), ", "))).when(content > 0.15, "Similar metadata profile"),
        F.when(raw_cf >= F.greatest(mu, F.lit(3.5)), "Liked by users with similar ratings"),
        F.when(F.coalesce(F.trim(director), F.lit("")) != "", F.concat(F.lit("Directed by "), F.split(director, r"\|")[0])),
    )
    given = F.filter(why, lambda x: x.isNotNull())
    return F.when(F.size(given) == 0, F.array(F.lit("High rating popularity"))).otherwise(F.slice(given, 1, 3))


def embedding_ratings(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """pairs(userId, movieId) with `prediction`, by models that only rank: 0.5 to 5, by the place of the pair's product among the user's products with all items.

    An item without factors is rated 3.0; a user without factors as one with the mean of all users' factors.
    """
    asked = pairs.select("userId", "movieId").distinct()
    guest = mean_profile(users).withColumnRenamed("factors", "g")
    known = asked.select("userId").distinct().join(users, "userId", "left").crossJoin(F.broadcast(guest)).select(F.col("userId").cast("long").alias("query"), F.coalesce(F.col("factors").cast("array<double>"), "g").alias("x"))
    ranks = pair_ranks(asked.select(F.col("userId").cast("long").alias("query"), F.col("movieId").cast("long").alias("item")), known, items.select(F.col("movieId").cast("long").alias("item"), F.col("factors").cast("array<double>").alias("x")))
    rated = ranks.select(F.col("query").alias("userId"), F.col("item").alias("movieId"), to_rating(F.col("scaled")).alias("prediction"))
    return pairs.join(rated, ["userId", "movieId"], "left").withColumn("prediction", F.coalesce("prediction", F.lit(3.0)))


def model_information(manifest: Mapping[str, object], users: DataFrame, movies: DataFrame) -> DataFrame:
    """One row of what a model is: the manifest's names, weights, threshold, modes, backends and metrics (a map), and the numbers of its users and movies."""
    weights, metrics = manifest.get("weights") or {}, manifest.get("metrics") or {}
    text = {k: str(manifest.get(k) or "") for k in ("model_source", "model_name", "dataset", "artifact_path", "collaborative_mode", "collaborative_engine", "content_backend")}
    text["content_model_name"] = str(manifest.get("content_model_name") or "") if text["content_backend"] == "sbert" else ""
    numbers = {k: float(weights.get(k, w)) for k, w in zip(("collaborative", "content", "popularity"), WEIGHTS, strict=True)} | {"positive_threshold": float(manifest.get("positive_threshold", 4.0))}
    pairs = [F.lit(x) for k, v in sorted(metrics.items()) if isinstance(v, (int, float)) for x in (k, float(v))]
    counts = users.agg(F.countDistinct("userId").alias("user_count")).crossJoin(movies.agg(F.countDistinct("movieId").alias("movie_count")))
    return counts.select(*[F.lit(v).alias(k) for k, v in (text | numbers).items()], F.lit(bool(manifest.get("content_from_artifact"))).alias("content_from_artifact"), F.create_map(*pairs).cast("map<string,double>").alias("metrics"), "user_count", "movie_count")


def batch_top_k(users: DataFrame, items: DataFrame, pop: DataFrame, k: int = 10, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """(userId, movieId, score, rank) of users(userId, cf, content, seen) against items(movieId, cf, content).

    cf and content are vectors whose products are the raw scores, both scaled by their ranks among all
    of a user's products; pop(movieId, popularity) is scaled once, and seen is an array of ids to leave
    out.
    """
    a, b, c = weights
    table = items.join(pop, "movieId", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))
    static = catalog_scaled(table, "movieId", "popularity", "__pop").select("movieId", (c * F.col("__pop")).alias("static"))
    vectors = lambda df, key, name, *more: df.select(F.col(key).cast("long").alias(name), *more, F.col("cf").alias("x1"), F.col("content").alias("x2"))
    hide = users.select(F.col("userId").cast("long").alias("query"), F.explode("seen").alias("item"))
    best = best_hybrids(vectors(users, "userId", "query"), vectors(table.join(static, "movieId"), "movieId", "item", "static"), (Part(a, "1"), Part(b, "2")), k, hide)
    return best.select(F.col("query").alias("userId"), F.col("item").alias("movieId"), "score", "rank")
