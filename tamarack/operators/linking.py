"""Joins between catalogs, ratings and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_year, year_in_title
from .prepare import dense_ids

#: Columns that a picker shows, and names that stand for the library's own.
PICKER = ("movieId", "title", "genres", "year", "poster_url")
ALIASES = {"user_id": "userId", "movie_id": "movieId"}


def with_links(movies: DataFrame, links: DataFrame) -> DataFrame:
    """movies with the ids of links(movieId, imdbId, tmdbId); null where a movie has none."""
    return movies.join(links.select("movieId", "imdbId", "tmdbId"), "movieId", "left")


def unseen(candidates: DataFrame, seen: DataFrame, keys: Sequence[str] = ("userId", "movieId")) -> DataFrame:
    """Candidates without the pairs in seen, whose rows may repeat."""
    return candidates.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def referential(rows: DataFrame, known: DataFrame, key: str = "movieId") -> DataFrame:
    """Rows whose key is known."""
    return rows.join(known.select(key), key, "left_semi")


def remapped(rows: DataFrame, keys: Mapping[str, str], start: int = 1, of: DataFrame | None = None) -> DataFrame:
    """rows with a dense id beside each key (keys: column to name of the id), from `start` in order of the key.

    With `of`, ids are those of its keys, and rows whose key it lacks go.
    """
    for column, name in keys.items():
        rows = rows.join(dense_ids(rows if of is None else of, column, start, out=name), column)
    return rows


def aligned_vectors(movies: DataFrame, vectors: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """movieId, vector for every movie: that of vectors(movieId, column), or zeros."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return movies.select("movieId").join(vectors.select("movieId", F.col(column).cast("array<double>").alias("vector")), "movieId", "left").select("movieId", F.coalesce("vector", zeros).alias("vector"))


def resolved_ids(movies: DataFrame, links: DataFrame) -> DataFrame:
    """movieId, tmdbId of movies without a tmdbId of their own: the smallest of movies of equal title and year, else of equal title; null if there is none."""
    named = movies.select("movieId", without_year(F.col("title")).alias("bare"), year_in_title(F.col("title")).alias("y"))
    have = links.where("tmdbId <> ''").select("movieId", "tmdbId")
    exact = named.join(have, "movieId").groupBy("bare", "y").agg(F.min("tmdbId").alias("a"))
    loose = exact.groupBy("bare").agg(F.min("a").alias("b"))
    return named.join(have, "movieId", "left_anti").join(exact, ["bare", "y"], "left").join(loose, "bare", "left").select("movieId", F.coalesce("a", "b").alias("tmdbId"))


def picker(movies: DataFrame) -> DataFrame:
    """PICKER's columns, as far as movies has them; null texts are empty."""
    return movies.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "movieId" else F.col(c) for c in PICKER if c in movies.columns])


def aliased(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """df with its columns under the library's names; a column that has one already stays as it is."""
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns and v not in df.columns})


def overlaps(members: DataFrame, lists: DataFrame, by: str = "user_id", key: str = "movie_id") -> DataFrame:
    """(by, n): for how many of lists(key) members(by, key) has a row, in any number."""
    return members.join(lists.select(key), key, "left_semi").groupBy(by).agg(F.countDistinct(key).alias("n"))


def missing_counts(a: DataFrame, b: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row: for each column (names: column to name of its count) the distinct values of a that b lacks."""
    out = None
    for column, name in names.items():
        one = a.select(column).distinct().join(b.select(column), column, "left_anti").agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
