"""Fields out of raw pages and feeds."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_id, number_in, stars, user_name, valid_user_name, year_in, year_in_title
from .prepare import SOURCE_SCORES


ANCHOR, TAG = r"(?is)<a\s[^>]*>.*?</a>", r"<[^>]*>"
#: Attributes that hold a card's title and its address, the first that is there.
TITLE_ATTRIBUTES = ("data-film-name", "data-film-title", "data-item-name", "title")
LINK_ATTRIBUTES = ("data-target-link", "data-film-link", "href")


def attribute(markup: Column, name: str) -> Column:
    """Value of an attribute of the first tag that has it; null if none, or empty."""
    return F.nullif(F.trim(F.regexp_extract(markup, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def cards(pages: DataFrame) -> DataFrame:
    """page_id, link, title, year, position: the anchors of each page, each link once, in order.

    Title and link come from the card's attributes, else from the anchor's text; the year from
    its attribute, else from the title, else it is ''. Anchors without a link are left out.
    """
    card = F.col("card")
    bare = F.trim(F.regexp_replace(F.regexp_replace(card, TAG, ""), r"\s+", " "))
    title = F.coalesce(*[attribute(card, n) for n in TITLE_ATTRIBUTES], bare)
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("at", "card"))
    rows = rows.select("page_id", "at", F.coalesce(*[attribute(card, n) for n in LINK_ATTRIBUTES]).alias("link"), title.alias("title"), F.coalesce(attribute(card, "data-film-year"), year_in_title(title)).alias("year"))
    first = rows.where("link is not null").groupBy("page_id", "link").agg(F.min(F.struct("at", "title", "year")).alias("c"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("c.at")) - 1
    return first.select("page_id", "link", "c.title", "c.year", place.alias("position"))


def class_rating(html: Column) -> Column:
    """N / 2 of the css class rated-N, else the stars in the text."""
    return F.coalesce(F.regexp_extract(html, r"rated-(\d+)", 1).try_cast("int") / 2.0, stars(html))


def user_links(pages: DataFrame) -> DataFrame:
    """page_id, name, position: valid user names that links point to, each once, by first position."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("position", "link"))
    names = links.select("page_id", "position", user_name(F.regexp_extract("link", r"^/([^/?#]+)/?$", 1)).alias("name")).where(valid_user_name(F.col("name")))
    return names.groupBy("page_id", "name").agg(F.min("position").alias("position"))


def typed(rows: DataFrame) -> DataFrame:
    """rows(source, rating) with interaction_type and implicit_score: a rating if there is one, else the source's default."""
    scores = F.create_map(*[F.lit(x) for kv in SOURCE_SCORES.items() for x in kv])
    return rows.withColumns({"interaction_type": F.when(F.col("rating").isNotNull(), "rating").otherwise(F.col("source")), "implicit_score": F.coalesce("rating", scores[F.col("source")])})


#: Child elements of a feed's item, whatever their namespaces, by the columns they fill.
ITEM_FIELDS = {"title": "title", "link": "link", "description": "description", "pubDate": "date", "filmTitle": "film", "filmYear": "film_year", "memberRating": "member_rating"}


def item_records(feeds: DataFrame) -> DataFrame:
    """feed_id, position, and a text column for each of ITEM_FIELDS ('' where an item lacks it), a row for each item of feeds(feed_id, xml).

    Each item is parsed on its own, so a field that one lacks shifts nothing. A feed that is not well
    formed gives no rows, and harms no other.
    """
    names = list(ITEM_FIELDS.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, place, values = [], [], {n: [] for n in names}
            for k, xml in enumerate(batch.column(1).to_pylist()):
                try:
                    items = ElementTree.fromstring(xml or "").findall(".//item")
                except ElementTree.ParseError:
                    continue
                for i, item in enumerate(items):
                    found: dict[str, str] = {}
                    for child in item:
                        name = ITEM_FIELDS.get(child.tag.rpartition("}")[2])
                        if name:
                            found.setdefault(name, " ".join((child.text or "").split()))
                    of.append(k)
                    place.append(i)
                    for n in names:
                        values[n].append(found.get(n, ""))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(place, pa.int32()), *[pa.array(v, pa.string()) for v in values.values()]], ["feed_id", "position", *names])

    kind = feeds.schema["feed_id"].dataType.simpleString()
    return feeds.select("feed_id", "xml").mapInArrow(run, f"feed_id {kind}, position int, " + ", ".join(f"{n} string" for n in names))


def film_of_title(title: Column) -> Column:
    """The film in an item's title: without stars and what follows, who did what, and the year."""
    out = F.trim(F.regexp_replace(title, r"(?s)\s*[★½]+.*$", ""))
    for verb in ("watched", "reviewed", "liked"):
        out = F.trim(F.regexp_replace(out, rf"(?s)^.* {verb} ", ""))
    return F.trim(F.regexp_replace(out, r"(?s),\s*(19\d{2}|20\d{2}).*$", ""))


def feed_items(feeds: DataFrame) -> DataFrame:
    """feed_id, position, movie_id, title, year, link, rating, interaction_type, implicit_score, date of the items of feeds(feed_id, xml).

    An item's own rating counts, else the stars of its description, else of its title; without any, the
    title's verb tells the type (liked, reviewed, else watched) and its score. Film and year are the
    item's own, else those in its title; items without a film are left out.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = item_records(feeds).withColumns({
        "film": F.coalesce(blank("film"), film_of_title(F.col("title"))),
        "year": F.coalesce(blank("film_year"), year_in(F.col("title")).cast("string"), F.lit("")),
        "rating": F.coalesce(F.nullif(F.col("member_rating").try_cast("double"), F.lit(0.0)), stars(F.col("description")), stars(F.col("title"))),
    })
    said = F.lower("title")
    kind = F.when(F.col("rating").isNotNull(), "rating").when(F.contains(said, F.lit("liked")), "liked").when(F.contains(said, F.lit("reviewed")), "review").otherwise("watched")
    score = F.coalesce("rating", F.when(kind == "liked", 4.0).when(kind == "review", 3.5).otherwise(2.5))
    movie = hashed_id(F.coalesce(blank("link"), F.concat_ws("_", "film", "year")), "movie")
    return rows.where("film <> ''").select("feed_id", "position", movie.alias("movie_id"), F.col("film").alias("title"), "year", "link", "rating", kind.alias("interaction_type"), score.alias("implicit_score"), "date")


def profile_count(html: Column, label: str) -> Column:
    """The number before a label on a profile page; 0 if none."""
    return number_in(F.regexp_extract(html, rf"(?is)([\d,]+)\s*(?:</[^>]+>\s*)*(?:<[^>]+>\s*)*{label}", 1))


def is_profile(html: Column, name: Column) -> Column:
    h = F.lower(html)
    return F.contains(h, F.concat(F.lit('href="/'), F.lower(name), F.lit("/films/"))) | F.contains(h, F.lit("profile-header")) | F.contains(h, F.lit('data-person="'))
