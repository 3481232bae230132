"""Data-quality audit of catalogs and ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent, year_in_title
from ..session import checkpointed
from .prepare import blank


def missing_year(title: Column) -> Column:
    return year_in_title(title) == ""


def non_empty(c: Column) -> Column:
    return F.count_if(~blank(c))


def positive_number(c: Column) -> Column:
    return F.count_if(F.coalesce(c.cast("string").try_cast("double") > 0, F.lit(False)))


def rating_distribution(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rating").agg(F.count("*").alias("n"))


def rating_stats(ratings: DataFrame, threshold: float = 4.0) -> DataFrame:
    n = F.count_if(F.col("rating") >= threshold)
    return ratings.agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"), F.avg("rating").alias("mean"), F.median("rating").alias("median"), n.alias("positives"), percent(n, F.count("*")).alias("positive_pct"))


def per_key(ratings: DataFrame, key: str) -> DataFrame:
    by = ratings.groupBy(key).agg(F.count("*").alias("n"))
    return by.agg(F.min("n").alias("lo"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("hi"), F.count_if(F.col("n") < 5).alias("under_5"), F.count_if(F.col("n") < 10).alias("under_10"))


def sizes(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Distinct users and movies, and the share of pairs without a rating."""
    r = ratings.agg(F.countDistinct("userId").alias("users"), F.countDistinct("movieId").alias("rated"), F.countDistinct("userId", "movieId").alias("pairs"))
    m = movies.agg(F.countDistinct("movieId").alias("movies"))
    cells = F.col("users") * F.col("movies")
    return r.crossJoin(m).withColumn("sparsity_pct", F.when(cells == 0, 0.0).otherwise(F.bround(100.0 - F.col("pairs") * 100.0 / F.nullif(cells, F.lit(0)), 4)))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def orphans(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti").agg(F.countDistinct(key).alias("orphans"))


def coverage(df: DataFrame, text: list[str], numeric: list[str]) -> DataFrame:
    """column, covered, total, pct: non-blank text, or numbers over 0; in one pass."""
    counts = df.agg(F.count("*").alias("total"), *[non_empty(F.col(c)).alias(c) for c in text], *[positive_number(F.col(c)).alias(c) for c in numeric])
    long = counts.unpivot(["total"], text + numeric, "column", "covered")
    return long.select("column", "covered", "total", percent(F.col("covered"), F.col("total")).alias("pct"))


def core_gaps(movies: DataFrame, core: list[str]) -> DataFrame:
    gaps = [blank(F.col(c)) for c in core]
    some = gaps[0]
    every = gaps[0]
    for g in gaps[1:]:
        some, every = some | g, every & g
    return movies.agg(F.count_if(some).alias("any_missing"), F.count_if(every).alias("all_missing"), F.count_if(blank(F.col("genres")) | (F.col("genres") == "(no genres listed)")).alias("no_genre"), F.count_if(year_in_title(F.col("title")) == "").alias("no_year"))


def split_diagnostics(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("userId").alias("users"), F.countDistinct("movieId").alias("movies"))


def advice(report: DataFrame) -> DataFrame:
    """report(missing_year, no_genre, unrated, sparsity_pct) with `advice`: what its numbers call for."""
    hints = F.array(
        F.when(F.col("missing_year") > 0, "fill years from release dates"),
        F.when(F.col("no_genre") > 0, "enrich genres"),
        F.when(F.col("unrated") > 0, "score unrated items by content"),
        F.when(F.col("sparsity_pct") > 99, "prefer content-heavy weights"),
    )
    return report.withColumn("advice", F.filter(hints, lambda x: x.isNotNull()))


def interaction_stats(interactions: DataFrame) -> DataFrame:
    users = interactions.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("users"), F.avg("n").alias("per_user"), F.count_if(F.col("n") < 10).alias("users_under_10"))
    movies = interactions.groupBy("movie_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("movies"), F.avg("n").alias("per_movie"), F.count_if(F.col("n") < 5).alias("movies_under_5"))
    return interactions.agg(F.count("*").alias("rows"), F.count("rating").alias("rated")).crossJoin(users).crossJoin(movies)


def report(movies: DataFrame, ratings: DataFrame, enriched: DataFrame) -> DataFrame:
    """(section, name, value, text): a quality report in rows, a few for each section."""
    one = lambda df, section, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), "value")
    genres = F.trim(F.coalesce("genres", F.lit("")))
    parts = [
        one(ratings, "ids", "users", F.countDistinct("userId")),
        one(movies, "ids", "movies", F.countDistinct("movieId")),
        one(ratings, "ids", "rated_movies", F.countDistinct("movieId")),
        one(ratings, "shapes", "ratings", F.count("*")),
        orphans(ratings, movies, "movieId").select(F.lit("orphans").alias("section"), F.lit("ratings_without_movie").alias("name"), F.col("orphans").cast("double").alias("value")),
        one(movies, "issues", "no_genres", F.count_if((genres == "") | (genres == "(no genres listed)"))),
        coverage(enriched, ["overview"], []).select(F.lit("coverage").alias("section"), F.col("column").alias("name"), F.col("pct").cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("text", F.lit(None).cast("string"))


#: Metadata columns whose coverage is told, those that count if over 0, and the core ones.
CONTENT = ("overview", "tagline", "director", "cast", "poster_url", "budget", "revenue", "tmdbId", "imdbId", "genres", "year", "release_date", "runtime", "original_language", "production_companies", "production_countries", "keywords", "tag_genome_tags", "vote_average", "vote_count", "popularity", "collection_name", "certification")
NUMERIC = ("budget", "revenue", "runtime", "vote_average", "vote_count", "popularity")
CORE = ("overview", "director")
NO_GENRES = "(no genres listed)"
SPLITS = ("train", "validation", "test")
SOURCES = ("movies", "ratings", "tags", "links", "enriched")
ADVICE = (
    ("missing_enriched_movies", "add placeholder rows for movies without enrichment, then enrich them"),
    ("movies_without_ratings", "keep unrated movies for content and cold start, leave them out of collaborative training"),
    ("test_movies_not_in_train", "report warm items first, cold items apart"),
    ("items_with_lt_5_ratings", "compare by segments of item popularity, or with a minimum of interactions"),
    ("no_budget_no_revenue", "take a budget and revenue of 0 for missing"),
)


def _rows(df: DataFrame, section: str, **values: Column) -> DataFrame:
    """(section, name, value) of aggregates of df, in one pass."""
    one = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return one.unpivot([], list(values), "name", "value").select(F.lit(section).alias("section"), "name", "value")


def interaction_figures(split: DataFrame, movies: DataFrame, threshold: float = 4.0) -> DataFrame:
    """(section, name, value) of split(userId, movieId, rating, split): ids, duplicates, ratings, their distribution, and the split.

    Users, movies, pairs and rating values are counted in one pass over the rows, by grouping sets;
    all figures come from those counts.
    """
    mine = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}")
    sets = [[F.col("userId")], [F.col("movieId")], [F.col("userId"), F.col("movieId")], [F.col("rating")]]
    # Key columns under other names: in a set that leaves a column out, it would be null in the aggregates too.
    keys = [F.col(c) for c in ("userId", "movieId", "rating")]
    rows = split.select("userId", "movieId", F.col("rating"), "split", F.col("rating").alias("r"))
    good = F.count_if((F.col("split") == "test") & (F.col("r") >= threshold)).alias("good_test")
    by = checkpointed(rows.groupingSets(sets, *keys).agg(F.grouping_id().alias("set"), F.count("*").alias("n"), *[mine(s) for s in SPLITS], good))
    of = {"userId": 3, "movieId": 5, "pair": 1, "rating": 6}  # bits of the columns left out
    users, items, pairs, values = (by.where(F.col("set") == of[k]) for k in of)
    n, lacks = F.col("n"), lambda s: F.count_if((F.col(f"n_{s}") > 0) & (F.col("n_train") == 0))
    catalog = movies.agg(F.countDistinct("movieId").alias("catalog"))
    size = lambda s: F.sum(f"n_{s}")
    parts = [
        _rows(users.crossJoin(F.broadcast(catalog)), "ids", users=F.count("*"), movies=F.max("catalog"), sparsity_pct=F.bround(100 * (1 - F.sum("n") / F.greatest(F.count("*") * F.max("catalog"), F.lit(1))), 4)),
        _rows(items, "ids", rated_movies=F.count("*")),
        _rows(pairs, "duplicates", ratings_userId_movieId=F.sum(n - 1)),
        _rows(values, "ratings", min=F.min("rating"), max=F.max("rating"), mean=F.bround(F.sum(F.col("rating") * n) / F.sum("n"), 4), median=F.percentile("rating", F.lit(0.5), n), positive_threshold=F.lit(threshold), positive_count=F.sum(F.when(F.col("rating") >= threshold, n).otherwise(0)), positive_pct=percent(F.sum(F.when(F.col("rating") >= threshold, n).otherwise(0)), F.sum("n"))),
        values.select(F.lit("distribution").alias("section"), F.col("rating").cast("string").alias("name"), n.cast("double").alias("value")),
        *[_rows(df, "ratings", **{f"{k}_interactions_min": F.min("n"), f"{k}_interactions_median": F.median("n"), f"{k}_interactions_mean": F.bround(F.avg("n"), 4), f"{k}_interactions_max": F.max("n")}) for df, k in ((users, "user"), (items, "item"))],
        _rows(items, "ratings", items_with_lt_5_ratings=F.count_if(n < 5), items_with_lt_10_ratings=F.count_if(n < 10)),
        _rows(users, "split", **{f"{s}_size": size(s) for s in SPLITS}, **{f"{s}_pct": percent(size(s), F.sum("n")) for s in SPLITS}, **{f"{s}_users": F.count_if(F.col(f"n_{s}") > 0) for s in SPLITS}, test_users_not_in_train=lacks("test")),
        _rows(items, "split", **{f"{s}_movies_not_in_train": lacks(s) for s in SPLITS[1:]}, **{f"{s}_{kind}_interactions": F.sum(F.when((F.col("n_train") > 0) == (kind == "warm"), F.col(f"n_{s}")).otherwise(0)) for s in SPLITS[1:] for kind in ("warm", "cold")}, test_cold_positive_interactions=F.sum(F.when(F.col("n_train") == 0, F.col("good_test")).otherwise(0))),
    ]
    return reduce(DataFrame.union, parts)


def table_figures(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, name, value): shapes of the tables of SOURCES, repeated ids, ids in one and not in another, and tagged movies; every table is read once, and ids meet in one grouping by movieId."""
    rows = reduce(DataFrame.union, [tables[s].select(F.col("movieId").cast("long").alias("movieId"), F.lit(s).alias("source")) for s in SOURCES])
    ids = checkpointed(rows.groupBy("movieId").agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES]))
    has = lambda s: F.col(s) > 0
    beyond = lambda s: F.sum(F.greatest(F.col(s) - 1, F.lit(0)))
    shapes = _rows(ids, "shapes", **{f"{s}_rows": F.sum(s) for s in SOURCES}, **{f"{s}_columns": F.lit(len(tables[s].columns)) for s in SOURCES})
    repeated = _rows(ids, "duplicates", **{f"{s}_movieId": beyond(s) for s in ("movies", "links", "enriched")})
    names = {"ratings": "rating", "tags": "tag", "links": "link", "enriched": "enriched"}
    orphan = {f"{names[s]}_movieIds_not_in_movies": F.count_if(has(s) & ~has("movies") & F.col("movieId").isNotNull()) for s in SOURCES[1:]} | {f"movies_without_{s}": F.count_if(has("movies") & ~has(s)) for s in ("ratings", "links", "enriched")}
    tagged = {"tagged_movies": F.count_if(has("tags") & F.col("movieId").isNotNull()), "tagged_movies_pct": percent(F.count_if(has("tags") & F.col("movieId").isNotNull()), F.sum("movies"))}
    tags = tables["tags"]
    full = _rows(tags.groupBy(*tags.columns).agg(F.count("*").alias("n")), "duplicates", tags_full_rows=F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
    return reduce(DataFrame.union, [shapes, repeated, full, _rows(ids, "orphans", **orphan), _rows(ids, "issues", **tagged)])


def content_figures(loaded: DataFrame) -> DataFrame:
    """(section, name, value): coverage of CONTENT's columns that loaded movies have, in numbers and per cent, and issues; one pass."""
    there = [c for c in CONTENT if c in loaded.columns]
    core = [blank(F.col(c)) for c in CORE if c in loaded.columns] or [F.lit(True)]
    any_, all_ = reduce(lambda a, b: a | b, core), reduce(lambda a, b: a & b, core)
    values: dict[str, Column] = {}
    for c in there:
        covered = positive_number(F.col(c)) if c in NUMERIC else non_empty(F.col(c))
        values |= {f"coverage.{c}": covered, f"coverage.{c}_pct": percent(covered, F.count("*"))}
    values |= {"issues.any_core_metadata_missing": F.count_if(any_), "issues.all_core_metadata_missing": F.count_if(all_), "issues.no_genres_listed": F.count_if(F.col("genres") == NO_GENRES), "issues.missing_year": F.count_if(missing_year(F.col("title")))}
    zero = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) == 0 if c in loaded.columns else F.lit(True)
    if {"budget", "revenue"} & set(loaded.columns):
        values["issues.no_budget_no_revenue"] = F.count_if(zero("budget") & zero("revenue"))
    rows = _rows(loaded, "", **{k.replace(".", ":"): v for k, v in values.items()})
    part = F.split("name", ":")
    return rows.select(part[0].alias("section"), part[1].alias("name"), "value")


def examples(tables: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """(section, name, value, text): the first movies, by id, without enrichment, ratings, year or genres."""
    movies = tables["movies"].select("movieId", "title", "genres")
    lacking = lambda s: movies.join(tables[s], "movieId", "left_anti")
    found = {"missing_enriched_movies": lacking("enriched"), "movies_without_ratings": lacking("ratings"), "missing_year": movies.where(missing_year(F.col("title"))), "no_genres_listed": movies.where(F.col("genres") == NO_GENRES)}
    return reduce(DataFrame.union, [df.orderBy("movieId").limit(limit).select(F.lit("examples").alias("section"), F.lit(name).alias("name"), F.col("movieId").cast("double").alias("value"), F.concat_ws(" | ", "title", "genres").alias("text")) for name, df in found.items()])


def audit(tables: dict[str, DataFrame], loaded: DataFrame, split: DataFrame, example_limit: int = 10) -> DataFrame:
    """(section, name, value, text): the whole quality report of tables (SOURCES), loaded movies, and ratings with their split.

    Sections: shapes, ids, duplicates, orphans, ratings, distribution, split, coverage, issues, examples
    (value: movieId, text: title and genres), and advice (text), a row for each figure that calls for one.
    """
    figures = checkpointed(reduce(DataFrame.union, [interaction_figures(split, tables["movies"]), table_figures(tables), content_figures(loaded)]))
    of = {"missing_enriched_movies": "movies_without_enriched"}
    said = reduce(DataFrame.union, [figures.where((F.col("name") == of.get(name, name)) & (F.col("value") > 0)).select(F.lit("advice").alias("section"), F.lit(name).alias("name"), "value", F.lit(text).alias("text")) for name, text in ADVICE])
    return figures.withColumn("text", F.lit(None).cast("string")).unionByName(said).unionByName(examples(tables, example_limit))
