"""Catalog and ratings preparation: merges with precedence, canonical rows, ids, upserts, k-core."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Interaction types by priority, and default scores by source.
PRIORITY = {"favorite": 6, "rating": 5, "liked": 4, "review": 3, "diary": 2, "watched": 1}
SOURCE_SCORES = {"watched": 2.5, "liked": 4.0, "review": 3.5, "diary": 3.0, "favorite": 5.0}
NO_GENRES = "(no genres listed)"


def require_columns(df: DataFrame, required: Sequence[str], source: str) -> DataFrame:
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{source} lacks columns: {', '.join(missing)}")
    return df


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def first_filled(*columns: Column) -> Column:
    """The first that is not blank, else ''."""
    return F.coalesce(*[F.when(~blank(c), c.cast("string")) for c in columns], F.lit(""))


def merge_enriched(movies: DataFrame, enriched: DataFrame) -> DataFrame:
    """Catalog with enrichment where its own value is blank; genres also where none are listed."""
    other = enriched.select(*[F.col(c).alias(c if c == "movieId" else f"__{c}") for c in enriched.columns])
    joined = movies.join(other, "movieId", "left")
    out = []
    for c in movies.columns:
        if f"__{c}" in other.columns and c != "movieId":
            base = F.when(F.col(c) == NO_GENRES, "").otherwise(F.col(c)) if c == "genres" else F.col(c)
            out.append(F.when(~blank(base), base).when(~blank(F.col(f"__{c}")), F.col(f"__{c}")).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c))
        else:
            out.append(F.col(c))
    out += [F.coalesce(F.col(f"__{c}"), F.lit("")).alias(c) for c in enriched.columns if c not in movies.columns]
    return joined.select(*out)


def overlay(movies: DataFrame, enriched: DataFrame) -> DataFrame:
    """Catalog on which filled enrichment values win."""
    other = enriched.select(*[F.col(c).alias(c if c == "movieId" else f"__{c}") for c in enriched.columns])
    joined = movies.join(other, "movieId", "left")
    common = [c for c in movies.columns if c in enriched.columns and c != "movieId"]
    return joined.select(*[first_filled(F.col(f"__{c}"), F.col(c)).alias(c) if c in common else F.col(c) for c in movies.columns], *[F.col(f"__{c}").alias(c) for c in enriched.columns if c not in movies.columns])


def top_genome_tags(scores: DataFrame, tags: DataFrame, top_n: int = 20, min_relevance: float = 0.35) -> DataFrame:
    """movieId, tag_genome_tags: names of the most relevant tags, joined by spaces."""
    named = scores.where(F.col("relevance") >= min_relevance).join(tags, "tagId", "left").where(~blank(F.col("tag")))
    place = F.row_number().over(Window.partitionBy("movieId").orderBy(F.desc("relevance"), "tagId"))
    kept = named.withColumn("place", place).where(F.col("place") <= top_n)
    return kept.groupBy("movieId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]), " ").alias("tag_genome_tags"))


def tags_text(tags: DataFrame) -> DataFrame:
    """movieId, tags: all tags in input order."""
    return tags.groupBy("movieId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag"))), lambda x: x["tag"]), " ").alias("tags"))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__row", row).where("__row = 1").drop("__row")


def canonical_movies(movies: DataFrame) -> DataFrame:
    """One row for each canonical_key: with url, with year, smallest id first."""
    has = lambda c: (~blank(F.col(c))).cast("int")
    return keep_one(movies, ["canonical_key"], [has("movie_url").desc(), has("year").desc(), F.col("movie_id")])


def best_interactions(interactions: DataFrame) -> DataFrame:
    """Best of each (user, movie): score, then type, then first seen. Rows without ids go."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("interaction_type")], F.lit(0))
    rows = interactions.where(~blank(F.col("user_id")) & ~blank(F.col("movie_id")))
    return keep_one(rows, ["user_id", "movie_id"], [F.desc("implicit_score"), rank.desc(), F.col("seq")])


def dense_ids(df: DataFrame, column: str, start: int = 1, order: Column | None = None, out: str = "dense_id") -> DataFrame:
    """(column, dense_id): distinct values numbered from start without gaps, in order of value or of `order`'s least.

    Values are ranked within ranges, and ranges placed by their sizes, so that no task sorts them all.
    """
    least = df.groupBy(column).agg(F.min(order if order is not None else F.col(column)).alias("__o"))
    parts = least.repartitionByRange("__o", column).withColumn("__part", F.spark_partition_id())
    from ..session import checkpointed

    parts = checkpointed(parts)  # ranges are drawn from a sample: keep them
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    row = F.row_number().over(Window.partitionBy("__part").orderBy("__o", column))
    return parts.withColumn("__row", row).join(F.broadcast(before), "__part").select(column, (F.col("__before") + F.col("__row") - 1 + start).alias(out))


def stable_timestamps(df: DataFrame, date: str, seq: str) -> DataFrame:
    """df with `timestamp`: seconds of the date where at least half the dates parse, else the sequence number."""
    parsed = F.try_to_timestamp(F.col(date).cast("string")).cast("long")
    share = df.agg(F.avg(parsed.isNotNull().cast("double")).alias("__share"))
    return df.crossJoin(F.broadcast(share)).withColumn("timestamp", F.when(F.col("__share") >= 0.5, F.coalesce(parsed, F.col(seq))).otherwise(F.col(seq))).drop("__share")


def first_dates(df: DataFrame, candidates: Sequence[str], now: int) -> DataFrame:
    """df with `timestamp` of the first candidate column with any date that parses; what does not parse is `now`."""
    parsed = [F.try_to_timestamp(F.col(c).cast("string")).cast("long") for c in candidates]
    any_ = df.agg(*[F.coalesce(F.max(p.isNotNull()), F.lit(False)).alias(f"__{i}") for i, p in enumerate(parsed)])
    value = F.coalesce(*[F.when(F.col(f"__{i}"), F.coalesce(p, F.lit(now))) for i, p in enumerate(parsed)], F.lit(now))
    return df.crossJoin(F.broadcast(any_)).withColumn("timestamp", value).drop(*[f"__{i}" for i in range(len(parsed))])


def positives(ratings: DataFrame, threshold: float = 4.0) -> DataFrame:
    """(userId, movieId, rating) of ratings from the threshold on, the first of each pair in time."""
    rows = ratings.where(F.col("rating") >= threshold)
    return keep_one(rows, ["userId", "movieId"], [F.col("timestamp"), F.col("rating")]).select("userId", "movieId", "rating")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of existing with the same key; missing columns are null."""
    return existing.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_filled(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Full outer upsert by column: filled new values win, except in `keep`, where old ones do."""
    n = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in old.columns if c != key])
    pick = lambda c: (F.coalesce(F.col(c), F.col(f"__{c}")) if c in keep else F.coalesce(F.when(~blank(F.col(f"__{c}")), F.col(f"__{c}")), F.col(c))).alias(c)
    return old.join(n, key, "full_outer").select(key, *[pick(c) for c in old.columns if c != key])


def merge_store(old: DataFrame, new: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """Best interactions of both, of known users and movies, with the earliest created_at of each pair."""
    both = old.unionByName(new).join(users, "user_id", "left_semi").join(movies, "movie_id", "left_semi")
    both = both.withColumn("created_at", F.min("created_at").over(Window.partitionBy("user_id", "movie_id")))
    return best_interactions(both)


def ratings_of(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id", "movie_id", F.coalesce("rating", "implicit_score").alias("rating"), F.col("interaction_type").isin("liked", "favorite").alias("liked"))


def k_core(interactions: DataFrame, min_user: int = 10, min_movie: int = 5, rounds: int | None = None) -> DataFrame:
    """Rows left when users and movies with too few rows go, again and again (`rounds` times at most); both counts precede each drop.

    Rows are counted once. A round looks only at the rows of those that go in it, and lowers the counts
    of their neighbours; the rows themselves stay where they are until the end.
    """
    from ..session import checkpointed

    rows = checkpointed(interactions.withColumn("__row", F.monotonically_increasing_id()))
    edges = rows.select("__row", "user_id", "movie_id")
    keys = {"user_id": min_user, "movie_id": min_movie}
    counts = {k: checkpointed(edges.groupBy(k).agg(F.count("*").alias("n"))) for k in keys}
    gone, done = {k: None for k in keys}, 0
    while rounds is None or done < rounds:
        going = {k: checkpointed(counts[k].where(F.col("n") < least).select(k)) for k, least in keys.items()}
        if all(g.isEmpty() for g in going.values()):
            break
        lost = edges.join(going["user_id"], "user_id", "left_semi").unionByName(edges.join(going["movie_id"], "movie_id", "left_semi")).distinct()
        for k in keys:
            if gone[k] is not None:
                lost = lost.join(gone[k], k, "left_anti")
        lost = checkpointed(lost)
        for k in keys:
            less = lost.groupBy(k).agg(F.count("*").alias("less"))
            left = counts[k].join(going[k], k, "left_anti").join(less, k, "left")
            counts[k] = checkpointed(left.select(k, (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")))
            gone[k] = going[k] if gone[k] is None else checkpointed(gone[k].union(going[k]))
        done += 1
    for k in keys:
        if gone[k] is not None:
            rows = rows.join(gone[k], k, "left_anti")
    return rows.select(*interactions.columns)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42, few: int = 10_000) -> DataFrame:
    """Exactly n rows of df (all, if it has fewer), the first by the MD5 of key and seed; keys are not repeated.

    The n-th hash is found by counting: each round counts the hashes between some probes and goes on
    between the two that the n-th lies between, until `few` are left, which alone are put in order.
    """
    from ..session import checkpointed

    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("__digest", digest)
    at = checkpointed(rows.select("__digest", F.conv(F.substring("__digest", 1, 12), 16, 10).cast("long").alias("h")))
    lo, hi, before, inside = 0, 1 << 48, 0, at.count()
    if inside <= n:
        return df
    while inside > max(few, 1) and hi - lo > 1:
        step = max(1, -(-(hi - lo) // 256))
        found = at.where((F.col("h") >= lo) & (F.col("h") < hi)).groupBy(F.floor((F.col("h") - lo) / step).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()  # 256 counts at most
        for k, count in sorted(found):
            if before + count >= n:
                lo, hi, inside = lo + k * step, min(hi, lo + (k + 1) * step), count
                break
            before += count
    limit = at.where((F.col("h") >= lo) & (F.col("h") < hi)).orderBy("__digest").limit(n - before).agg(F.max("__digest").alias("limit"))
    return rows.join(F.broadcast(limit), rows["__digest"] <= limit["limit"]).select(*df.columns)


def frontier(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes reached from seeds(node) over edges(src, dst) in up to `hops` steps, each once."""
    from ..session import checkpointed

    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    last = seen
    for hop in range(1, hops + 1):
        last = checkpointed(edges.join(last, edges.src == last.node).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = checkpointed(seen.union(last))
    return seen


def placeholders(movies: DataFrame, existing: DataFrame) -> DataFrame:
    """Enrichment that covers the catalog exactly: orphans go, missing ids get an empty row."""
    kept = existing.join(movies, "movieId", "left_semi").withColumn("enrichment_status", F.lit("enriched"))
    return kept.unionByName(placeholder_rows(movies.join(existing, "movieId", "left_anti")), allowMissingColumns=True)


def placeholder_rows(movies: DataFrame) -> DataFrame:
    return movies.select("movieId", F.lit("empty_metadata").alias("enrichment_status"))


def work_list(links: DataFrame, existing: DataFrame, mode: str, core: Sequence[str] = (), statuses: Sequence[str] = ("empty_metadata", "not_found", "error")) -> DataFrame:
    """Links to enrich: all, only_missing, retry_empty (by status, or all core columns blank) or refresh_empty (any core column blank)."""
    if mode == "all":
        return links
    if mode == "only_missing":
        return links.join(existing, "movieId", "left_anti")
    empties = [blank(F.col(c)) | F.coalesce(F.col(c).cast("string").try_cast("double") == 0, F.lit(False)) for c in core]
    if mode == "retry_empty":
        every = F.lit(True)
        for e in empties:
            every = every & e
        todo = existing.where(F.col("enrichment_status").isin(*statuses) | every)
    elif mode == "refresh_empty":
        some = F.lit(not core)
        for e in empties:
            some = some | e
        todo = existing.where(some)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return links.join(todo, "movieId", "left_semi")


def resolve_tokens(tokens: DataFrame, movies: DataFrame, links: DataFrame) -> DataFrame:
    """(movieId, place) of tokens(pos, token): an id, tmdb_<id>, or an exact title; first place of each, unknown ones go."""
    t = tokens.select("pos", F.trim("token").alias("token")).withColumns({"id": F.col("token").try_cast("long"), "tmdb": F.regexp_extract("token", "^tmdb_(.+)$", 1), "name": F.lower("token")})
    by_id = movies.select(F.col("movieId").alias("id"), F.col("movieId").alias("m1"))
    by_tmdb = links.where(~blank(F.col("tmdbId"))).groupBy(F.col("tmdbId").alias("tmdb")).agg(F.min("movieId").alias("m2"))
    by_name = movies.groupBy(F.lower("title").alias("name")).agg(F.min("movieId").alias("m3"))
    found = t.join(by_id, "id", "left").join(by_tmdb, "tmdb", "left").join(by_name, "name", "left").withColumn("movieId", F.coalesce("m1", "m2", "m3"))
    return found.where("movieId is not null").groupBy("movieId").agg(F.min("pos").alias("place"))
