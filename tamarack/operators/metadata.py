"""Film metadata out of JSON payloads, and rows of crawled users, films and interactions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import certification, hashed_id, joined_names, poster_url, user_name

#: The parts of a payload that are read.
PAYLOAD = (
    "overview string, tagline string, poster_path string, budget bigint, revenue bigint, release_date string, runtime bigint, original_language string, "
    "vote_average double, vote_count bigint, popularity double, imdb_id string, genres array<struct<name: string>>, keywords struct<keywords: array<struct<name: string>>>, "
    "production_companies array<struct<name: string>>, production_countries array<struct<iso_3166_1: string>>, belongs_to_collection struct<id: bigint, name: string>, "
    "credits struct<cast: array<struct<name: string>>, crew: array<struct<name: string, job: string>>>, "
    "release_dates struct<results: array<struct<iso_3166_1: string, release_dates: array<struct<certification: string>>>>>"
)


def payload_columns(payload: Column) -> list[Column]:
    """The columns of enriched films from a JSON text: missing texts are '', missing numbers 0, lists are joined by '|'."""
    p = F.from_json(payload, PAYLOAD)
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    every = lambda c, key="name": joined_names(F.transform(c, lambda e: e[key]))
    directors = F.filter(p["credits"]["crew"], lambda e: e["job"] == "Director")
    out = {
        "overview": text(p["overview"]),
        "tagline": text(p["tagline"]),
        "director": every(directors),
        "cast": joined_names(F.transform(F.slice(p["credits"]["cast"], 1, 5), lambda e: e["name"])),
        "poster_url": poster_url(p["poster_path"]),
        "budget": number(p["budget"], "bigint"),
        "revenue": number(p["revenue"], "bigint"),
        "genres": every(p["genres"]),
        "release_date": text(p["release_date"]),
        "runtime": number(p["runtime"], "bigint"),
        "original_language": text(p["original_language"]),
        "production_companies": every(p["production_companies"]),
        "production_countries": every(p["production_countries"], "iso_3166_1"),
        "keywords": every(p["keywords"]["keywords"]),
        "vote_average": number(p["vote_average"], "double"),
        "vote_count": number(p["vote_count"], "bigint"),
        "popularity": number(p["popularity"], "double"),
        "collection_id": number(p["belongs_to_collection"]["id"], "bigint"),
        "collection_name": text(p["belongs_to_collection"]["name"]),
        "certification": certification(p["release_dates"]["results"]),
        "imdb_id": text(p["imdb_id"]),
    }
    return [c.alias(name) for name, c in out.items()]


def clean(value: Column) -> Column:
    """Text with single spaces, '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " "))


#: Fields of a profile that a user row takes over.
PROFILE = ("display_name", "location", "films_count", "this_year_count", "lists_count", "following_count", "followers_count", "member_since", "bio")


def user_row(name: Column, profile: dict[str, Column], created: Column, base: str = "https://films.example.com") -> list[Column]:
    """Columns of a user row: hashed id, name, address and the profile's fields ('' where it has none)."""
    own = user_name(name)
    fields = {f: clean(profile[f]) if f in profile else F.lit("") for f in PROFILE}
    out = {"user_id": hashed_id(own, "user"), "username": own, **dict(list(fields.items())[:2]), "profile_url": F.concat(F.lit(base + "/"), own, F.lit("/")), **dict(list(fields.items())[2:]), "created_at": created}
    return [c.alias(n) for n, c in out.items()]


def movie_row(movie: Column, title: Column, year: Column, url: Column, created: Column) -> list[Column]:
    return [movie.alias("movie_id"), clean(title).alias("title"), clean(year).alias("year"), clean(url).alias("movie_url"), created.alias("created_at")]


def interaction_row(user: Column, movie: Column, kind: Column, rating: Column, implicit: Column, source: Column, watched: Column, created: Column) -> list[Column]:
    """Columns of an interaction row; a missing rating is ''."""
    return [
        user.alias("user_id"), movie.alias("movie_id"), clean(kind).alias("interaction_type"), F.coalesce(rating.cast("string"), F.lit("")).alias("rating"),
        implicit.alias("implicit_score"), clean(source).alias("source"), clean(watched).alias("watched_date"), created.alias("created_at"),
    ]
