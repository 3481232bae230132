"""Feeds and pages of several items, against plain Python."""

from pyspark.sql import functions as F

from tamarack.operators import extract

FEED = """<?xml version="1.0"?><rss xmlns:lb="https://x.org/ns"><channel><title>Ann</title>
<item><title>Ring, 1999 - ★½</title><link> https://x.org/film/ring/ </link><pubDate>Mon, 1 Jan</pubDate></item>
<item><title>Ann liked Heat, 1995</title><description>so ★★★★ good</description></item>
<item><title>Ann reviewed Ran, 1985</title><link>https://x.org/film/ran/</link></item>
<item><title>Ann watched <![CDATA[Up & Away]]></title><link>https://x.org/film/up/</link><lb:memberRating>0</lb:memberRating></item>
<item><link>https://x.org/film/none/</link></item>
<item><title>x</title><link>https://x.org/film/m/</link><lb:filmTitle>M</lb:filmTitle><lb:filmYear>1931</lb:filmYear><lb:memberRating>4.5</lb:memberRating></item>
</channel></rss>"""


def test_items_keep_their_own_fields(spark):
    rows = [("a", FEED), ("b", FEED[:400]), ("c", None), ("d", "<rss><channel/></rss>"), ("e", FEED.replace("Ring", "Rang"))]
    out = extract.feed_items(spark.createDataFrame(rows, "feed_id string, xml string")).collect()
    assert {r.feed_id for r in out} == {"a", "e"} and len(out) == 10
    got = [(r.position, r.title, r.year, r.link, r.rating, r.interaction_type, r.implicit_score, r.date) for r in sorted(out) if r.feed_id == "a"]
    assert got == [
        (0, "Ring", "1999", "https://x.org/film/ring/", 1.5, "rating", 1.5, "Mon, 1 Jan"),
        (1, "Heat", "1995", "", 4.0, "rating", 4.0, ""),
        (2, "Ran", "1985", "https://x.org/film/ran/", None, "review", 3.5, ""),
        (3, "Up & Away", "", "https://x.org/film/up/", None, "watched", 2.5, ""),
        (5, "M", "1931", "https://x.org/film/m/", 4.5, "rating", 4.5, ""),
    ]
    assert len({r.movie_id for r in out}) == 5 and all(r.movie_id.startswith("movie_") for r in out)


def test_cards_of_broken_pages(spark):
    html = "<div><a href='/film/a/'>A (1999)</a><a data-film-name=\"B\" href='/film/b/' data-film-year='2001'><img></a><a href='/film/a/'>again</a><a>no link</a><a href='/film/c/'>C <b>bold</b></a><a href='/open'>never closed"
    out = extract.cards(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("position").collect()
    assert [(r.link, r.title, r.year, r.position) for r in out] == [("/film/a/", "A (1999)", "1999", 0), ("/film/b/", "B", "2001", 1), ("/film/c/", "C bold", "", 2)]
