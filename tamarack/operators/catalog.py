"""Catalog questions: trending, top rated, latest, by genre, search, history, details, similar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text, year_in_title
from .scores import movie_scores


def with_scores(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """movies with vote_average, vote_count (0 if unrated) and year (1900 if unknown)."""
    return (
        movies.join(movie_scores(ratings), "movieId", "left")
        .withColumns({"vote_average": F.coalesce("mean", F.lit(0.0)), "vote_count": F.coalesce("n", F.lit(0)), "year": F.coalesce(year_in_title(F.col("title")).try_cast("int"), F.lit(1900))})
        .drop("mean", "n")
    )


def _first(scored: DataFrame, k: int, *order) -> DataFrame:
    return scored.orderBy(*order, "movieId").limit(k)


def trending(scored: DataFrame, k: int = 15, min_votes: int = 15) -> DataFrame:
    return _first(scored.where(F.col("vote_count") >= min_votes), k, F.desc("vote_count"))


def top_rated(scored: DataFrame, k: int = 15, min_votes: int = 15) -> DataFrame:
    return _first(scored.where(F.col("vote_count") >= min_votes), k, F.round("vote_average", 10).desc())


def latest(scored: DataFrame, k: int = 15) -> DataFrame:
    return _first(scored, k, F.desc("year"), F.desc("vote_count"))


def in_genre(scored: DataFrame, genre: str, k: int = 15) -> DataFrame:
    return _first(scored.where(contains_text(F.col("genres"), genre)), k, F.round("vote_average", 10).desc())


def search(movies: DataFrame, text: str) -> DataFrame:
    return movies.where(contains_text(F.col("title"), text))


def history(ratings: DataFrame, movies: DataFrame, user: int, k: int = 15) -> DataFrame:
    rows = ratings.where(F.col("userId") == user).join(movies, "movieId")
    return rows.orderBy(F.desc("rating"), F.desc("timestamp"), "movieId").limit(k)


def similar_by_genres(scored: DataFrame, movie: int, k: int = 15) -> DataFrame:
    """Others by number of shared genres, votes and mean."""
    genres = F.split("genres", r"\|")
    own = scored.where(F.col("movieId") == movie).select(genres.alias("own"))
    rows = scored.where(F.col("movieId") != movie).crossJoin(F.broadcast(own)).withColumn("shared", F.size(F.array_intersect(genres, "own"))).drop("own")
    return _first(rows.where(F.col("shared") > 0), k, F.desc("shared"), F.desc("vote_count"), F.round("vote_average", 10).desc())
