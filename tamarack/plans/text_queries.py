"""Queries of the scalar functions, over titles, urls, ids and texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import linking
from .registry import query

TRY = "try_cast"
SLUG = "trim(regexp_replace(regexp_replace(trim(lower({t})), '^(the|a|an)\\s+', ''), '[^a-z0-9]+', '-', 'g'), '-')"
WORDS = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({t})), '^(the|a|an)\\s+', ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("p01_year_in_title", r"select movieId, regexp_extract(title, '\((\d{4})(?:[–-]\d{4})?\)', 1) as year from movies")
def _(t):
    return t.movies.select("movieId", X.year_in_title(F.col("title")).alias("year"))


@query("p02_year_at_end", r"select movieId, coalesce(try_cast(regexp_extract(title, '\((\d{4})\)\s*$', 1) as int), 0) as year, trim(regexp_replace(title, '\s*\(\d{4}\)\s*$', '')) as bare from movies")
def _(t):
    return t.movies.select("movieId", X.year_at_end(F.col("title")).alias("year"), X.without_year(F.col("title")).alias("bare"))


@query("p03_title_with_year", r"select movieId, regexp_replace(title, '\s*\(\d{4}\)\s*$', '') || ' (' || regexp_extract(title, '\((\d{4})\)', 1) || ')' as again, title as kept from movies")
def _(t):
    y = X.year_in_title(F.col("title"))
    return t.movies.select("movieId", X.with_year(X.without_year(F.col("title")), y).alias("again"), X.with_year(F.col("title"), F.concat(y, F.lit(".0"))).alias("kept"))


@query("p04_parsed_year", r"select movieId, case when movieId % 3 = 0 then '1999' when movieId % 3 = 1 then regexp_extract(title, '\((\d{4})\)\s*$', 1) else regexp_extract(title, '\((\d{4})\)\s*$', 1) end as year from movies")
def _(t):
    given = F.when(F.col("movieId") % 3 == 0, "1999.0").when(F.col("movieId") % 3 == 1, "n/a")
    return t.movies.select("movieId", X.parsed_year(given, F.col("title")).alias("year"))


@query("p05_title_slug", f"select movieId, {SLUG.format(t='title')} as slug from movies")
def _(t):
    return t.movies.select("movieId", X.slug_of_title(F.col("title")).alias("slug"))


@query("p06_title_words", f"select doc_id, {WORDS.format(t='text')} as words from documents")
def _(t):
    return t.documents.select("doc_id", X.words_of_title(F.col("text")).alias("words"))


@query("p07_url_slug", r"select page_id, lower(regexp_extract('https://x.org/film/' || replace(regexp_extract(url, '://([^/?#]+)', 1), '.', '-') || '/page', '^(?:[a-zA-Z]+://[^/]*)?/film/([^/?#]+)', 1)) as slug, lower(regexp_extract(url, '^(?:[a-zA-Z]+://[^/]*)?/film/([^/?#]+)', 1)) as own from pages")
def _(t):
    made = F.concat(F.lit("https://x.org/film/"), F.replace(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("."), F.lit("-")), F.lit("/page"))
    return t.pages.select("page_id", X.slug_of_url(made).alias("slug"), X.slug_of_url(F.col("url")).alias("own"))


@query("p08_canonical_key", rf"select movieId, case when movieId % 2 = 0 then 'slug:s' || movieId else 'title:' || {SLUG.format(t='title')} || ':' || regexp_extract(title, '\((\d{{4}})', 1) end as k from movies")
def _(t):
    slug = F.when(F.col("movieId") % 2 == 0, F.concat(F.lit("s"), F.col("movieId").cast("string"))).otherwise("")
    return t.movies.select("movieId", X.canonical_key(slug, F.col("title"), X.year_in_title(F.col("title"))).alias("k"))


@query("p09_normal_rating", "select event_id, least(5.0, greatest(0.5, coalesce(case when event_type = 'purchase' then value end, case when event_type = 'click' then 5.0 else 0.0 end))) as rating from events")
def _(t):
    liked = F.when(F.col("event_type") == "click", "Yes").otherwise("no")
    return t.events.select("event_id", X.normal_rating(F.when(F.col("event_type") == "purchase", F.col("value").cast("string")).otherwise("n/a"), liked).alias("rating"))


@query("p10_rating_or_score", "select seq, least(5.0, greatest(0.5, coalesce(implicit_score, 0))) as rating, interaction_type in ('liked') as liked from interactions")
def _(t):
    return t.interactions.select("seq", X.normal_rating(F.col("implicit_score"), F.lit(None)).alias("rating"), X.is_liked(F.col("interaction_type")).alias("liked"))


@query("p13_hashed_id", r"select c_custkey, 'u_' || substr(md5(lower(trim(regexp_replace('  ' || c_name || '   x', '\s+', ' ', 'g')))), 1, 12) as id from customer")
def _(t):
    return t.customer.select("c_custkey", X.hashed_id(F.concat(F.lit("  "), F.col("c_name"), F.lit("   x")), "u").alias("id"))


_NAMES = ", ".join(f"'{x}'" for x in X.RESERVED_NAMES)
_ENDS = f"^({'|'.join(X.RESERVED_STARTS)})|({'|'.join(X.RESERVED_ENDS)})$"
VALID = f"regexp_full_match(name, '[a-z0-9_-]{{2,30}}') and name not in ({_NAMES}) and not regexp_matches(name, '{_ENDS}')"


@query("p14_user_names", f"with n as (select p_partkey, case p_partkey % 8 when 0 then lower(p_type) when 1 then 'films' when 2 then 'film-' || p_partkey when 3 then 'api-beta' when 4 then 'ann_' || p_partkey when 5 then p_partkey || '-guide' when 6 then 'watchlist' else lower(p_name) end as name from part) select p_partkey, name, {VALID} as ok from n")
def _(t):
    k, n = F.col("p_partkey") % 8, F.col("p_partkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" /"), F.col("p_type"), F.lit("/ "))).when(k == 1, "/Films/").when(k == 2, F.concat(F.lit("film-"), n)).when(k == 3, "API-beta")
    raw = raw.when(k == 4, F.concat(F.lit("/Ann_"), n, F.lit("/"))).when(k == 5, F.concat(n, F.lit("-guide"))).when(k == 6, "watchlist").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.user_name(raw).alias("name"), X.valid_user_name(raw).alias("ok"))


@query("p15_numbers", r"select o_orderkey, coalesce(try_cast(replace(regexp_extract(format('{:,}', cast(floor(o_totalprice) as bigint)) || ' votes', '(\d[\d,]*)', 1), ',', '') as bigint), 0) as number, year(o_orderdate) as y, try_cast(trim(case when o_orderkey % 2 = 0 then ' 3.5 ' else 'x' end) as double) as d from orders")
def _(t):
    text = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" votes"))
    return t.orders.select("o_orderkey", X.number_in(text).alias("number"), X.year_in(F.concat(F.lit("seen on "), F.date_format("o_orderdate", "dd/MM/yyyy"))).cast("long").alias("y"), X.safe_double(F.when(F.col("o_orderkey") % 2 == 0, " 3.5 ").otherwise("x")).alias("d"))


@query("p16_stars", "select l_orderkey, l_linenumber, l_quantity, case when l_quantity <= 10 then (floor(l_quantity / 2) + case when l_quantity % 2 = 1 then 0.5 else 0 end) end as stars from lineitem where l_quantity >= 1")
def _(t):
    q = F.col("l_quantity")
    halves = F.when(q % 4 == 1, "½½").otherwise("½")  # two halves count once
    glyphs = F.concat(F.lit("rated "), F.repeat(F.lit("★"), F.floor(q / 2).cast("int")), F.when(q % 2 == 1, halves).otherwise(""), F.lit(" by ★?"))
    text = F.when(q == 1, "rated ½½ only").otherwise(glyphs)
    return t.lineitem.where("l_quantity >= 1").select("l_orderkey", "l_linenumber", "l_quantity", X.stars(text).alias("stars"))


@query("p17_film_url", "select p_partkey, case p_partkey % 4 when 0 then '' when 1 then 'https://x.org/' || p_type when 2 then 'https://films.example.com/film/' || p_type else 'https://films.example.com/film/' || p_type || '/' end as url from part")
def _(t):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("https://x.org/"), "p_type")).when(k == 2, F.concat(F.lit("/film/"), "p_type")).otherwise(F.concat(F.lit(" "), "p_type", F.lit("/")))
    return t.part.select("p_partkey", X.film_url(v).alias("url"))


@query("p18_fill_missing", "select m.movieId, coalesce(e.overview, '') as overview, coalesce(try_cast(e.runtime as double), 0) as runtime from movies m left join enriched e on m.movieId = e.movieId")
def _(t):
    rows = t.movies.join(t.enriched.drop("genres"), "movieId", "left")
    return rows.select("movieId", F.coalesce("overview", F.lit("")).alias("overview"), F.coalesce(F.col("runtime").try_cast("double"), F.lit(0.0)).alias("runtime"))


@query("p19_poster_url", "select movieId, case when imdbId like 'tt1%' then 'https://images.example.com/w500/' || imdbId when imdbId like 'tt2%' then '' else 'http://x/' || imdbId end as url from links")
def _(t):
    i = F.col("imdbId")
    v = F.when(i.like("tt1%"), F.concat(F.lit("/"), i)).when(i.like("tt2%"), F.lit(None)).otherwise(F.concat(F.lit("http://x/"), i))
    return t.links.select("movieId", X.poster_url(v).alias("url"))


@query("p20_external_id", "select movieId, case when tmdbId in ('', '0') then '' else tmdbId end as id, '' as none from links")
def _(t):
    return t.links.select("movieId", X.external_id(F.when(F.col("tmdbId") == "", "NaN").otherwise(F.concat("tmdbId", F.lit(".0")))).alias("id"), X.external_id(F.lit(" None ")).alias("none"))


@query("p21_search_key", r"select movieId, trim(regexp_replace(title, '\s*\(\d{4}\)\s*$', '')) as bare, regexp_extract(title, '\((\d{4})\)\s*$', 1) as year from movies")
def _(t):
    return t.movies.select("movieId", X.without_year(F.col("title")).alias("bare"), X.parsed_year(F.lit(None).cast("string"), F.col("title")).alias("year"))


@query("p22_joined_names", "select o_custkey, string_agg(o_orderpriority, '|' order by o_orderkey) filter (where r <= 3) as names from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) group by o_custkey")
def _(t):
    names = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return t.orders.groupBy("o_custkey").agg(names.alias("n")).select("o_custkey", X.joined_names(F.concat(F.array(F.lit(" "), F.lit(None)), "n"), 3).alias("names"))


@query("p23_certification", "select o_custkey, coalesce(min_by(o_orderpriority, o_orderkey) filter (where o_orderstatus = 'F'), '') as mark from orders group by o_custkey")
def _(t):
    one = F.struct(F.col("o_orderstatus").alias("iso_3166_1"), F.array(F.struct(F.lit("").alias("certification")), F.struct(F.col("o_orderpriority").alias("certification"))).alias("release_dates"))
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("r")))).alias("a"))
    return rows.select("o_custkey", X.certification(F.transform("a", lambda x: x["r"]), "F").alias("mark"))


@query("p25_positives", "select userId, movieId, rating from (select *, row_number() over (partition by userId, movieId order by timestamp, rating) as r from ratings where rating >= 4) where r = 1")
def _(t):
    from ..operators.prepare import positives

    return positives(t.ratings)


@query("p26_search", "select movieId, title from movies where contains(lower(title), 'ring')")
def _(t):
    from ..operators.catalog import search

    return search(t.movies, "RING").select("movieId", "title")


@query("p28_article_first", "select movieId, 'The ' || replace(title, ' (', ' x (') as title from movies")
def _(t):
    x = F.regexp_replace("title", r" \((\d{4})\)$", " x, The ($1)")
    return t.movies.select("movieId", X.article_first(x).alias("title"))


@query("p29_rating_scale", "select event_id, least(5.0, greatest(0.5, value)) as clipped, 0.5 + 4.5 * (value / 1000) as scaled from events")
def _(t):
    return t.events.select("event_id", X.clipped(F.col("value")).alias("clipped"), V.to_rating(F.col("value") / 1000).alias("scaled"))


@query("p30_match_share", "select event_id, round(case when hi > lo then 0.60 + 0.39 * (value - lo) / (hi - lo) else 0.85 end, 6) as share from (select *, min(value) over (partition by user_id) as lo, max(value) over (partition by user_id) as hi from events)")
def _(t):
    return t.events.select("event_id", F.round(V.match_share(F.col("value"), "user_id"), 6).alias("share"))


@query("p31_match_alone", "select event_id, case when value - 3 > 0 then greatest(0.1, least(1.0, (value - 3) / 5.0)) else 0.85 end as share from events")
def _(t):
    return t.events.select("event_id", V.match_share_alone(F.col("value") - 3).alias("share"))


@query("p32_placeholder", "select movieId, coalesce(nullif(trim(overview), ''), 'No overview') as overview from enriched")
def _(t):
    return t.enriched.select("movieId", X.or_placeholder(F.col("overview"), "No overview").alias("overview"))


@query("p33_resolve_tokens", "with t as (select o_orderkey as pos, case o_orderkey % 4 when 0 then cast(o_custkey as varchar) when 1 then 'tmdb_' || (o_custkey * 7) when 2 then 'SMALL RING (1981)' else 'nothing' end as token from orders), l as (select tmdbId, min(movieId) as m2 from links where tmdbId <> '' group by 1), n as (select lower(title) as name, min(movieId) as m3 from movies group by 1), f as (select pos, coalesce(m.movieId, m2, m3) as movieId from t left join movies m on m.movieId = try_cast(token as bigint) left join l on 'tmdb_' || tmdbId = token left join n on name = lower(token)) select movieId, min(pos) as place from f where movieId is not null group by movieId")
def _(t):
    from ..operators.prepare import resolve_tokens

    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    token = F.when(k == 0, c.cast("string")).when(k == 1, F.concat(F.lit("tmdb_"), (c * 7).cast("string"))).when(k == 2, "SMALL RING (1981)").otherwise("nothing")
    return resolve_tokens(t.orders.select(F.col("o_orderkey").alias("pos"), token.alias("token")), t.movies, t.links)


@query("p34_picker", "select movieId, coalesce(title, '') as title, coalesce(genres, '') as genres from movies")
def _(t):
    return linking.picker(t.movies)


@query("p37_model_family", "select p_partkey, case p_partkey % 10 when 0 then 'hybrid' when 1 then 'lightgcn' when 2 then 'bpr' when 3 then 'popularity' when 4 then 'two_tower' when 5 then 'svd' when 6 then 'itemknn' when 7 then 'content' when 8 then 'hybrid' else 'bpr' end as family from part")
def _(t):
    k = F.col("p_partkey") % 10
    names = ("Hybrid LightGCN", "LightGCN v2", "recbole-BPR", "Pop", "Two-Tower", "funk_SVD", "ItemKNN", "content tf-idf", "plain", "x")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    return t.part.select("p_partkey", X.model_family(name, F.when(k == 9, "BPR run").otherwise("recbole")).alias("family"))


@query("p38_percent", "select o_custkey, case when count(*) filter (where o_orderstatus <> 'P') = 0 then 0.0 else round_even(count(*) filter (where o_orderstatus = 'F') * 100.0 / nullif(count(*) filter (where o_orderstatus <> 'P'), 0), 4) end as pct from orders group by o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(X.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "P")).alias("pct"))


@query("p39_counts", "select count(*) filter (where trim(coalesce(overview, '')) <> '') as filled, count(*) filter (where try_cast(runtime as double) > 0) as positive from enriched")
def _(t):
    from ..operators.quality import non_empty, positive_number

    return t.enriched.agg(non_empty(F.col("overview")).alias("filled"), positive_number(F.col("runtime")).alias("positive"))


@query("p40_unit_vectors", "select vec_id, i - 1 as pos, round(cast(embedding[i] as double) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 1e-12), 6) as x from embeddings, range(1, 65) r(i)")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("p41_aliased_columns", "select userId, count(*) as n from ratings group by userId")
def _(t):
    other = t.ratings.withColumnsRenamed({"userId": "user_id", "movieId": "movie_id"})
    return linking.aliased(other).groupBy("userId").agg(F.count("*").alias("n"))


@query("x08_title_similarity", f"with t as (select movieId, case when movieId % 11 = 0 then '(!)' else title end as title from movies), w as (select a.movieId as a, b.movieId as b, {WORDS.format(t='a.title')} as x, {WORDS.format(t='b.title')} as y from t a join t b on a.movieId = b.movieId + 7), s as (select *, list_distinct(string_split(x, ' ')) as u, list_distinct(string_split(y, ' ')) as v from w) select a, b, cast(case when x = y then 100 when contains(x, y) or contains(y, x) then 85 else floor(len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v))) * 80) end as bigint) as score from s")
def _(t):
    titled = t.movies.withColumn("title", F.when(F.col("movieId") % 11 == 0, "(!)").otherwise(F.col("title")))  # some without words
    a = titled.select(F.col("movieId").alias("a"), F.col("title").alias("x"), (F.col("movieId") - 7).alias("k"))
    b = titled.select(F.col("movieId").alias("b"), F.col("title").alias("y"), F.col("movieId").alias("k"))
    return a.join(b, "k").select("a", "b", X.title_similarity(F.col("x"), F.col("y")).alias("score"))
