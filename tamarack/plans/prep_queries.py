"""Queries of catalog preparation: joins, windows, set operations, upserts, audits and catalog questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import normal_rating
from ..operators import catalog, linking, matching, prepare, quality, split
from ..operators.scores import movie_scores
from ..operators.tuning import candidate_weights
from .registry import query

#: SQL of the temporal split.
SPLIT = """sp as (select *, case when n < 3 then 'train' when r <= greatest(1, n - v - v) then 'train' when r <= n - v then 'validation' else 'test' end as split
from (select *, greatest(1, round_even(n * 0.1, 0)) as v from (select *, count(*) over (partition by userId) as n, row_number() over (partition by userId order by timestamp, movieId, rating) as r from ratings)))"""
SCORED = r"""sc as (select m.*, coalesce(vote_average, 0) as vote_average, coalesce(vote_count, 0) as vote_count, coalesce(try_cast(regexp_extract(title, '\((\d{4})(?:[–-]\d{4})?\)', 1) as int), 1900) as year
from movies m left join (select movieId, avg(rating) as vote_average, count(*) as vote_count from ratings group by movieId) s on m.movieId = s.movieId)"""


@query("s01_catalog", "select movieId, title, coalesce(genres, '') as genres from movies")
def _(t):
    return t.movies.select("movieId", "title", F.coalesce("genres", F.lit("")).alias("genres"))


@query("s02_ratings", "select userId, movieId, rating, count(*) as n from ratings group by all")
def _(t):
    return t.ratings.groupBy("userId", "movieId", "rating").agg(F.count("*").alias("n"))


@query("s13_export", f"with {SPLIT} select split, userId as user_id, movieId as item_id, rating, timestamp from sp where rating >= 4")
def _(t):
    from ..sources.files import interaction_export

    return interaction_export(split.temporal_split(t.ratings)).select("split", F.col("`user_id:token`").alias("user_id"), F.col("`item_id:token`").alias("item_id"), F.col("`rating:float`").alias("rating"), F.col("`timestamp:float`").cast("long").alias("timestamp"))


@query("s14_run_summary", f"with {SPLIT} select split, count(*) as rows, count(*) filter (where rating >= 4) as positives from sp group by split")
def _(t):
    return split.temporal_split(t.ratings).groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.col("rating") >= 4).alias("positives"))


@query("s15_leaderboard_file", "select 0 as place, '| rating | n | mean |' as line union all select 1, '| --- | --- | --- |' union all select 1 + row_number() over (order by rating), printf('| %.4f | %d | %.4f |', rating, n, mean) from (select rating, count(*) as n, rating as mean from ratings group by rating)")
def _(t):
    from ..sources.files import markdown_lines

    rows = t.ratings.groupBy("rating").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"))
    return markdown_lines(rows, "rating")


def _figures(section, source, **values):
    """SQL of (section, name, value) of aggregates of a source."""
    return " union all ".join(f"select '{section}' as section, '{k}' as name, cast(({v}) as double) as value from {source}" for k, v in values.items())


def _pct(n, d):
    return f"case when {d} = 0 then 0 else round_even({n} * 100.0 / {d}, 4) end"


def _audit_sql():
    splits = ("train", "validation", "test")
    lacks = lambda s: f"count(*) filter (where n_{s} > 0 and n_train = 0)"
    counts = ", ".join(f"count(*) filter (where split = '{s}') as n_{s}" for s in splits) + ", count(*) filter (where split = 'test' and rating >= 4) as good, count(*) as n"
    text, number = ("overview", "director", "genres", "original_language"), ("runtime",)
    covered = {c: f"count(*) filter (where trim(coalesce({c}, '')) <> '')" for c in text} | {c: f"count(*) filter (where try_cast({c} as double) > 0)" for c in number}
    missing = {s: f"select count(distinct movieId) from {s} where movieId not in (select movieId from movies)" for s in ("ratings", "tags", "links", "enriched")}
    single = {"ratings": "rating", "tags": "tag", "links": "link", "enriched": "enriched"}
    columns = {"movies": 3, "ratings": 4, "tags": 5, "links": 3, "enriched": 6}
    year = r"regexp_extract(title, '\((\d{4})', 1)"
    parts = [
        _figures("ids", "us", users="count(*)", movies="max((select count(distinct movieId) from movies))", sparsity_pct="round_even(100 * (1 - sum(n) / greatest(count(*) * (select count(distinct movieId) from movies), 1)), 4)"),
        _figures("ids", "it", rated_movies="count(*)"),
        _figures("duplicates", "pr", ratings_userId_movieId="sum(n - 1)"),
        _figures("ratings", "ratings", min="min(rating)", max="max(rating)", mean="round_even(sum(rating) * 10000 / count(*), 0) / 10000", median="quantile_cont(rating, 0.5)", positive_threshold="max(4.0)", positive_count="count(*) filter (where rating >= 4)", positive_pct=_pct("count(*) filter (where rating >= 4)", "count(*)")),
        "select 'distribution' as section, cast(rating as varchar) as name, cast(count(*) as double) as value from ratings group by rating",
        *[_figures("ratings", t, **{f"{k}_interactions_min": "min(n)", f"{k}_interactions_median": "quantile_cont(n, 0.5)", f"{k}_interactions_mean": "round_even(sum(n) * 10000 / count(*), 0) / 10000", f"{k}_interactions_max": "max(n)"}) for t, k in (("us", "user"), ("it", "item"))],
        _figures("ratings", "it", items_with_lt_5_ratings="count(*) filter (where n < 5)", items_with_lt_10_ratings="count(*) filter (where n < 10)"),
        _figures("split", "us", **{f"{s}_size": f"sum(n_{s})" for s in splits}, **{f"{s}_pct": _pct(f"sum(n_{s})", "sum(n)") for s in splits}, **{f"{s}_users": f"count(*) filter (where n_{s} > 0)" for s in splits}, test_users_not_in_train=lacks("test")),
        _figures("split", "it", **{f"{s}_movies_not_in_train": lacks(s) for s in splits[1:]}, **{f"{s}_{k}_interactions": f"coalesce(sum(n_{s}) filter (where n_train {o} 0), 0)" for s in splits[1:] for k, o in (("warm", ">"), ("cold", "="))}, test_cold_positive_interactions="coalesce(sum(good) filter (where n_train = 0), 0)"),
        *[_figures("shapes", t, **{f"{t}_rows": "count(*)", f"{t}_columns": f"max({c})"}) for t, c in columns.items()],
        *[_figures("duplicates", t, **{f"{t}_movieId": "count(*) - count(distinct movieId)"}) for t in ("movies", "links", "enriched")],
        _figures("duplicates", "(select distinct * from tags)", tags_full_rows="(select count(*) from tags) - count(*)"),
        *[_figures("orphans", "(select 1)", **{f"{single[t]}_movieIds_not_in_movies": q}) for t, q in missing.items()],
        *[_figures("orphans", "(select 1)", **{f"movies_without_{t}": f"select count(*) from movies where movieId not in (select movieId from {t})"}) for t in ("ratings", "links", "enriched")],
        _figures("issues", "tags", tagged_movies="count(distinct movieId)", tagged_movies_pct=_pct("count(distinct movieId)", "(select count(*) from movies)")),
        *[_figures("coverage", "ld", **{c: q, f"{c}_pct": _pct(q, "count(*)")}) for c, q in covered.items()],
        _figures("issues", "ld", any_core_metadata_missing="count(*) filter (where trim(coalesce(overview, '')) = '' or trim(coalesce(director, '')) = '')", all_core_metadata_missing="count(*) filter (where trim(coalesce(overview, '')) = '' and trim(coalesce(director, '')) = '')", no_genres_listed="count(*) filter (where genres = '(no genres listed)')", missing_year=f"count(*) filter (where {year} = '')"),
    ]
    shown = [("missing_enriched_movies", "movieId not in (select movieId from enriched)"), ("movies_without_ratings", "movieId not in (select movieId from ratings)"), ("missing_year", f"{year} = ''"), ("no_genres_listed", "genres = '(no genres listed)'")]
    tops = " union all ".join(f"select 'examples', '{name}', cast(movieId as double), title || ' | ' || genres from (select * from movies where {where} order by movieId limit 10)" for name, where in shown)
    said = " union all ".join(f"select 'advice', '{name}', value, '{text}' from fg where name = '{'movies_without_enriched' if name == 'missing_enriched_movies' else name}' and value > 0" for name, text in quality.ADVICE)
    return f"""with {SPLIT}, us as (select userId, {counts} from sp group by userId), it as (select movieId, {counts} from sp group by movieId), pr as (select count(*) as n from ratings group by userId, movieId),
ld as (select m.*, overview, director, original_language, runtime from movies m left join enriched e on e.movieId = m.movieId), fg as ({" union all ".join(parts)})
select section, name, value, null as text from fg union all {said} union all {tops}"""


@query("s16_quality_report", _audit_sql())
def _(t):
    tables = {s: getattr(t, s) for s in quality.SOURCES}
    loaded = t.movies.join(t.enriched.select("movieId", "overview", "director", "original_language", "runtime"), "movieId", "left")
    return quality.audit(tables, loaded, split.temporal_split(t.ratings))


@query("p11_timestamps", "select event_id, case when share >= 0.5 then coalesce(cast(floor(epoch(cast(d as timestamp))) as bigint), event_id) else event_id end as timestamp from (select *, avg(case when d is not null then 1.0 else 0.0 end) over () as share from (select event_id, case when event_id % 3 > 0 then cast(ts as date) end as d from events))")
def _(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon").alias("d"))
    return prepare.stable_timestamps(rows, "d", "event_id").select("event_id", "timestamp")


@query("p12_first_dates", "select event_id, case when event_id % 3 > 0 then cast(floor(epoch(cast(cast(ts as date) as timestamp))) as bigint) else 1700000000 end as timestamp from events")
def _(t):
    rows = t.events.select("event_id", F.lit("never").alias("watched"), F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("created"))
    return prepare.first_dates(rows, ["watched", "created"], now=1_700_000_000).select("event_id", "timestamp")


@query("p27_in_genre", "select movieId from movies where contains(lower(genres), 'economy')")
def _(t):
    from ..functions.text import contains_text

    return t.movies.where(contains_text(F.col("genres"), "Economy")).select("movieId")


_WEIGHTED = ", ".join(f"({a}, {b}, {c})" for a, b, c in candidate_weights())


@query("p42_weight_grid", f"select round(a, 6) as a, round(b, 6) as b, round(c, 6) as c, count(*) as n, round(avg(a * l_discount * 10 + b * l_tax * 10 + c * l_quantity / 50), 5) as mean, round(max(a * l_discount * 10 + b * l_tax * 10 + c * l_quantity / 50), 5) as best from lineitem, (values {_WEIGHTED}) w(a, b, c) group by a, b, c")
def _(t):
    rows = t.lineitem.select((F.col("l_discount") * 10).alias("cf"), (F.col("l_tax") * 10).alias("content"), (F.col("l_quantity") / 50).alias("pop"))
    grid = F.broadcast(t.spark.createDataFrame(candidate_weights(), "a double, b double, c double"))
    score = F.col("a") * F.col("cf") + F.col("b") * F.col("content") + F.col("c") * F.col("pop")
    out = rows.crossJoin(grid).groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.max(score).alias("best"))
    return out.select(*[F.round(x, 6).alias(x) for x in "abc"], "n", F.round("mean", 5).alias("mean"), F.round("best", 5).alias("best"))


_PAYLOAD = "select doc_id, source, lang, n_chars, p_name, p_type, p_brand, p_size, p_partkey from documents join part on p_partkey = doc_id"


@query("p24_payload", f"with d as ({_PAYLOAD}) select doc_id, case when doc_id % 5 = 0 then '' else p_name end as overview, '' as tagline, case when doc_id % 3 = 0 then p_brand else p_brand || '|' || p_type end as director, p_name || '|' || p_type || '|a|b|c' as cast, case when doc_id % 4 = 0 then '' else 'https://images.example.com/w500/' || doc_id || '.jpg' end as poster_url, coalesce(n_chars, 0) as budget, 0 as revenue, p_type || '|' || p_brand as genres, '2001-02-03' as release_date, p_size as runtime, coalesce(lang, '') as original_language, p_brand as production_companies, 'US|FR' as production_countries, 'k' || doc_id as keywords, p_size / 2.0 as vote_average, p_partkey as vote_count, 0.0 as popularity, case when doc_id % 2 = 0 then doc_id else 0 end as collection_id, case when doc_id % 2 = 0 then p_name else '' end as collection_name, case when doc_id % 7 = 0 then '' else 'PG' end as certification, 'tt' || doc_id as imdb_id from d")
def _(t):
    from ..operators.metadata import payload_columns

    c, k = F.col, F.col("doc_id")
    named = lambda *names: F.array(*[F.struct(n.alias("name")) for n in names])
    person = lambda n, job: F.struct(n.alias("name"), F.lit(job).alias("job"))
    crew = F.when(k % 3 == 0, F.array(person(c("p_type"), "Writer"), person(c("p_brand"), "Director"))).otherwise(F.array(person(c("p_brand"), "Director"), person(c("p_type"), "Director")))
    mark = lambda country, text: F.struct(F.lit(country).alias("iso_3166_1"), F.array(F.struct(F.lit("").alias("certification")), F.struct(text.alias("certification"))).alias("release_dates"))
    payload = F.struct(
        F.when(k % 5 > 0, c("p_name")).alias("overview"), F.when(k % 4 > 0, F.concat(F.lit("/"), k.cast("string"), F.lit(".jpg"))).alias("poster_path"), c("n_chars").alias("budget"),
        named(c("p_type"), c("p_brand"), F.lit(" ")).alias("genres"), F.lit("2001-02-03").alias("release_date"), c("p_size").alias("runtime"), c("lang").alias("original_language"),
        named(c("p_brand")).alias("production_companies"), F.array(*[F.struct(F.lit(x).alias("iso_3166_1")) for x in ("US", "FR")]).alias("production_countries"),
        F.struct(named(F.concat(F.lit("k"), k.cast("string"))).alias("keywords")).alias("keywords"), (c("p_size") / 2).alias("vote_average"), c("p_partkey").alias("vote_count"),
        F.when(k % 2 == 0, F.struct(k.alias("id"), c("p_name").alias("name"))).alias("belongs_to_collection"),
        F.struct(named(c("p_name"), c("p_type"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("cast"), crew.alias("crew")).alias("credits"),
        F.struct(F.array(mark("FR", F.lit("12")), mark("US", F.when(k % 7 > 0, "PG").otherwise(" "))).alias("results")).alias("release_dates"), F.concat(F.lit("tt"), k.cast("string")).alias("imdb_id"),
    )
    rows = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id"))
    return rows.select("doc_id", F.to_json(payload).alias("payload")).select("doc_id", *payload_columns(F.col("payload")))


@query("p36_user_rows", "select 'user_' || substr(md5(lower(c_name)), 1, 12) as user_id, lower(c_name) as username, c_name || ' of ' || c_mktsegment as display_name, '' as location, 'https://films.example.com/' || lower(c_name) || '/' as profile_url, cast(c_custkey as varchar) as films_count, '' as this_year_count, '' as lists_count, '' as following_count, '' as followers_count, '' as member_since, '' as bio, '2020-01-01' as created_at from customer")
def _(t):
    from ..operators.metadata import user_row

    profile = {"display_name": F.concat(F.col("c_name"), F.lit("  of \n"), F.col("c_mktsegment"), F.lit(" ")), "films_count": F.col("c_custkey")}
    return t.customer.select(*user_row(F.concat(F.lit("/"), F.col("c_name"), F.lit("/ ")), profile, F.lit("2020-01-01")))


@query("p36_movie_rows", "select 'm' || p_partkey as movie_id, p_name as title, cast(1970 + p_size as varchar) as year, 'https://films.example.com/film/' || p_partkey || '/' as movie_url, '2020-01-01' as created_at from part")
def _(t):
    from ..operators.metadata import movie_row

    key = F.col("p_partkey").cast("string")
    return t.part.select(*movie_row(F.concat(F.lit("m"), key), F.concat(F.lit(" "), F.col("p_name")), F.col("p_size") + 1970, F.concat(F.lit("https://films.example.com/film/"), key, F.lit("/ ")), F.lit("2020-01-01")))


@query("p36_interaction_rows", "select user_id, movie_id, interaction_type, coalesce(cast(rating as varchar), '') as rating, implicit_score, 'page ' || seq as source, '' as watched_date, '2020-01-01' as created_at from interactions")
def _(t):
    from ..operators.metadata import interaction_row

    c = F.col
    return t.interactions.select(*interaction_row(c("user_id"), c("movie_id"), c("interaction_type"), c("rating"), c("implicit_score"), F.concat(F.lit("page  "), c("seq").cast("string")), F.lit(None), F.lit("2020-01-01")))


@query("j01_links", "select m.movieId, m.title, l.imdbId, l.tmdbId from movies m left join links l on m.movieId = l.movieId")
def _(t):
    return linking.with_links(t.movies, t.links).select("movieId", "title", "imdbId", "tmdbId")


@query("j02_enriched", "select m.movieId, m.title, case when m.genres <> '(no genres listed)' and trim(m.genres) <> '' then m.genres when coalesce(trim(e.genres), '') <> '' then e.genres else m.genres end as genres, coalesce(e.overview, '') as overview, coalesce(e.director, '') as director, coalesce(e.lang_, '') as original_language, coalesce(e.runtime, '') as runtime from movies m left join (select *, original_language as lang_ from enriched) e on m.movieId = e.movieId")
def _(t):
    return prepare.merge_enriched(t.movies, t.enriched)


GENOME = "g as (select movieId, string_agg(tag, ' ' order by place) as tag_genome_tags from (select movieId, tag, row_number() over (partition by movieId order by relevance desc, s.tagId) as place from genome_scores s join genome_tags g on s.tagId = g.tagId where relevance >= 0.35) where place <= 20 group by movieId)"


@query("j03_genome_text", f"with {GENOME} select m.movieId, coalesce(tag_genome_tags, '') as tag_genome_tags from movies m left join g on m.movieId = g.movieId")
def _(t):
    tags = prepare.top_genome_tags(t.genome_scores, t.genome_tags)
    return t.movies.join(tags, "movieId", "left").select("movieId", F.coalesce("tag_genome_tags", F.lit("")).alias("tag_genome_tags"))


@query("j04_named_genome", "select movieId, s.tagId, relevance, tag from genome_scores s left join genome_tags g on s.tagId = g.tagId")
def _(t):
    return t.genome_scores.join(t.genome_tags, "tagId", "left").select("movieId", "tagId", "relevance", "tag")


@query("w04_top_genome_tags", f"with {GENOME} select * from g")
def _(t):
    return prepare.top_genome_tags(t.genome_scores, t.genome_tags)


@query("j05_rated_movies", "select movieId from movies where movieId in (select movieId from ratings)")
def _(t):
    return split.rated_movies(t.movies, t.ratings).select("movieId")


@query("j06_warm_cold", f"with {SPLIT} select userId, sp.movieId, rating, timestamp, case when k.movieId is not null then 'warm' else 'cold' end as segment from sp left join (select distinct movieId from sp where split = 'train') k on k.movieId = sp.movieId where split = 'test'")
def _(t):
    s = split.temporal_split(t.ratings)
    return split.segments(s.where("split = 'test'").drop("split"), s.where("split = 'train'"))


@query("j07_orphans", "select (select count(distinct movieId) from tags where movieId not in (select movieId from movies)) as tags, (select count(distinct movieId) from movies where movieId not in (select movieId from links)) as unlinked, (select count(distinct movieId) from movies where movieId not in (select movieId from ratings)) as unrated")
def _(t):
    one = lambda a, b, name: quality.orphans(a, b, "movieId").withColumnRenamed("orphans", name)
    return one(t.tags, t.movies, "tags").crossJoin(one(t.movies, t.links, "unlinked")).crossJoin(one(t.movies, t.ratings, "unrated"))


@query("j08_unseen", f"with {SPLIT} select distinct userId, movieId from sp where split <> 'train' and (userId, movieId) not in (select (userId, movieId) from sp where split = 'train')")
def _(t):
    s = split.temporal_split(t.ratings)
    return linking.unseen(s.where("split <> 'train'").select("userId", "movieId").distinct(), s.where("split = 'train'"))


@query("j09_remapped", "with u as (select user_id, row_number() over (order by user_id) as u from (select distinct user_id from interactions)), m as (select movie_id, row_number() over (order by movie_id) as m from (select distinct movie_id from interactions)) select seq, u as \"userId\", m as \"movieId\" from interactions join u using (user_id) join m using (movie_id)")
def _(t):
    return linking.remapped(t.interactions, {"user_id": "userId", "movie_id": "movieId"}).select("seq", "userId", "movieId")


@query("j10_referential", "select userId, movieId, seq from tags where movieId in (select movieId from links)")
def _(t):
    return linking.referential(t.tags, t.links).select("userId", "movieId", "seq")


@query("j11_dense_ratings", "with u as (select userId, row_number() over (order by userId) - 1 as u from (select distinct userId from ratings where rating >= 3)), m as (select movieId, row_number() over (order by movieId) - 1 as m from (select distinct movieId from ratings where rating >= 3)) select u, m, count(*) as n from ratings join u using (userId) join m using (movieId) group by u, m")
def _(t):
    return linking.remapped(t.ratings, {"userId": "u", "movieId": "m"}, 0, t.ratings.where("rating >= 3")).groupBy("u", "m").agg(F.count("*").alias("n"))


@query("j12_catalog_scores", f"with {SCORED} select movieId, title, round(vote_average, 6) as vote_average, vote_count, year from sc")
def _(t):
    return catalog.with_scores(t.movies, t.ratings).select("movieId", "title", F.round("vote_average", 6).alias("vote_average"), "vote_count", "year")


@query("j13_history", "select movieId, title, rating, timestamp from ratings join movies using (movieId) where userId = 5 order by rating desc, timestamp desc, movieId limit 15")
def _(t):
    return catalog.history(t.ratings, t.movies, 5).select("movieId", "title", "rating", "timestamp")


@query("j14_overlay", "select m.movieId, title, case when coalesce(trim(e.genres), '') <> '' then e.genres else coalesce(m.genres, '') end as genres, overview, director, original_language, runtime from movies m left join enriched e on m.movieId = e.movieId")
def _(t):
    return prepare.overlay(t.movies, t.enriched)


@query("j15_aligned_vectors", "select movieId, coalesce(len(embedding), 64) as d, round(coalesce(cast(embedding[1] as double), 0), 6) as first from movies left join embeddings on vec_id = movieId")
def _(t):
    rows = linking.aligned_vectors(t.movies, t.vectors(), 64)
    return rows.select("movieId", F.size("vector").cast("long").alias("d"), F.round(F.col("vector")[0], 6).alias("first"))


@query("j17_fuzzy_titles", r"with w as (select *, trim(regexp_replace(title, '\s*\(\d{4}\)\s*$', '')) as bare, cast(regexp_extract(title, '\((\d{4})', 1) as int) as y from movies), u as (select movieId, bare, y, unnest(list_distinct(string_split(bare, ' '))) as word from w), p as (select distinct a.movieId, b.movieId as candidate, a.bare as x, b.bare as z, a.y as ay, b.y as zy from u a join u b using (word) where a.movieId <> b.movieId), c as (select movieId, candidate, case when ay = zy then 20 when abs(ay - zy) = 1 then 10 else 0 end + case when x = z then 100 when contains(x, z) or contains(z, x) then 85 else cast(floor(80.0 * len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(z, ' ')))) / len(list_distinct(string_split(x || ' ' || z, ' ')))) as bigint) end as score from p) select * from (select *, row_number() over (partition by movieId order by score desc, candidate) as place from c where score >= 70) where place <= 5")
def _(t):
    from ..functions.text import without_year, year_in_title

    w = t.movies.select(F.col("movieId").alias("id"), without_year(F.col("title")).alias("title"), year_in_title(F.col("title")).cast("int").alias("year"))
    return matching.match_titles(w, w).withColumnRenamed("id", "movieId")


@query("j18_resolved_ids", r"with k as (select regexp_replace(title, '\s*\(\d{4}\)\s*$', '') as bare, regexp_extract(title, '\((\d{4})', 1) as y, min(tmdbId) as id from movies join links using (movieId) where tmdbId <> '' group by all), k2 as (select bare, min(id) as id from k group by bare), m as (select movieId, regexp_replace(title, '\s*\(\d{4}\)\s*$', '') as bare, regexp_extract(title, '\((\d{4})', 1) as y from movies where movieId not in (select movieId from links where tmdbId <> '')) select movieId, coalesce(k.id, k2.id) as tmdbId from m left join k on m.bare = k.bare and m.y = k.y left join k2 on m.bare = k2.bare")
def _(t):
    return linking.resolved_ids(t.movies, t.links)


@query("a01_movie_scores", "select movieId, round(avg(rating), 6) as mean, count(*) as n from ratings group by movieId")
def _(t):
    return movie_scores(t.ratings).select("movieId", F.round("mean", 6).alias("mean"), "n")


@query("a05_distribution", "select rating, count(*) as n from ratings group by rating")
def _(t):
    return quality.rating_distribution(t.ratings)


@query("a06_rating_stats", "select min(rating) as lo, max(rating) as hi, round(avg(rating), 6) as mean, median(rating) as median, count(*) filter (where rating >= 4) as positives, round_even(count(*) filter (where rating >= 4) * 100.0 / count(*), 4) as positive_pct from ratings")
def _(t):
    return quality.rating_stats(t.ratings).withColumn("mean", F.round("mean", 6))


@query("a07_per_key", "select 'userId' as key, min(n) as lo, median(n) as median, round(avg(n), 6) as mean, max(n) as hi, count(*) filter (where n < 5) as under_5, count(*) filter (where n < 10) as under_10 from (select count(*) as n from ratings group by userId) union all select 'movieId', min(n), median(n), round(avg(n), 6), max(n), count(*) filter (where n < 5), count(*) filter (where n < 10) from (select count(*) as n from ratings group by movieId)")
def _(t):
    one = lambda k: quality.per_key(t.ratings, k).select(F.lit(k).alias("key"), "*").withColumn("mean", F.round("mean", 6))
    return one("userId").unionByName(one("movieId"))


@query("a08_sizes", "select *, round_even(100.0 - pairs * 100.0 / (users * movies), 4) as sparsity_pct from (select count(distinct userId) as users, count(distinct movieId) as rated, count(distinct (userId, movieId)) as pairs from ratings), (select count(distinct movieId) as movies from movies)")
def _(t):
    return quality.sizes(t.ratings, t.movies)


@query("a09_duplicates", "select (select sum(n - 1) from (select count(*) as n from ratings group by userId, movieId)) as pairs, (select sum(n - 1) from (select count(*) as n from ratings group by userId, movieId, rating, timestamp)) as rows from (select count(*) from ratings)")
def _(t):
    one = lambda keys, name: quality.duplicates(t.ratings, keys).withColumnRenamed("duplicates", name)
    return one(["userId", "movieId"], "pairs").crossJoin(one(t.ratings.columns, "rows"))


@query("a10_tags_text", "select movieId, string_agg(tag, ' ' order by seq, tag) as tags from tags group by movieId")
def _(t):
    return prepare.tags_text(t.tags)


@query("a11_relevant", "select userId, count(distinct movieId) as n, sum(distinct movieId) as s from ratings where rating >= 4 group by userId")
def _(t):
    from ..operators.evaluate import relevant

    return relevant(t.ratings).groupBy("userId").agg(F.count("*").alias("n"), F.sum("movieId").alias("s"))


@query("a12_interaction_stats", "select * from (select count(*) as rows, count(rating) as rated from interactions), (select count(*) as users, round(avg(n), 6) as per_user, count(*) filter (where n < 10) as users_under_10 from (select count(*) as n from interactions group by user_id)), (select count(*) as movies, round(avg(n), 6) as per_movie, count(*) filter (where n < 5) as movies_under_5 from (select count(*) as n from interactions group by movie_id))")
def _(t):
    return quality.interaction_stats(t.interactions).withColumns({"per_user": F.round("per_user", 6), "per_movie": F.round("per_movie", 6)})


@query("a13_coverage", "select 'overview' as \"column\", count(*) filter (where trim(overview) <> '') as covered, count(*) as total, round_even(count(*) filter (where trim(overview) <> '') * 100.0 / count(*), 4) as pct from enriched union all select 'genres', count(*) filter (where trim(genres) <> ''), count(*), round_even(count(*) filter (where trim(genres) <> '') * 100.0 / count(*), 4) from enriched union all select 'runtime', count(*) filter (where try_cast(runtime as double) > 0), count(*), round_even(count(*) filter (where try_cast(runtime as double) > 0) * 100.0 / count(*), 4) from enriched")
def _(t):
    return quality.coverage(t.enriched, ["overview", "genres"], ["runtime"])


@query("a14_core_gaps", r"with e as (select m.movieId, title, m.genres as g, coalesce(overview, '') as o, coalesce(director, '') as d from movies m left join enriched e on m.movieId = e.movieId) select count(*) filter (where trim(o) = '' or trim(d) = '') as any_missing, count(*) filter (where trim(o) = '' and trim(d) = '') as all_missing, count(*) filter (where g = '(no genres listed)') as no_genre, count(*) filter (where regexp_extract(title, '\((\d{4})', 1) = '') as no_year from e")
def _(t):
    return quality.core_gaps(t.movies.join(t.enriched.drop("genres"), "movieId", "left"), ["overview", "director"])


@query("a15_split_diagnostics", f"with {SPLIT} select split, count(*) as rows, count(distinct userId) as users, count(distinct movieId) as movies from sp group by split")
def _(t):
    return quality.split_diagnostics(split.temporal_split(t.ratings))


@query("a16_overlap_users", "select user_id, count(distinct movie_id) as n from interactions where movie_id in (select movie_id from interactions group by movie_id order by count(*) desc, movie_id limit 10) group by user_id")
def _(t):
    top = t.interactions.groupBy("movie_id").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "movie_id").limit(10)
    return linking.overlaps(t.interactions, top)


@query("w01_temporal_split", f"with {SPLIT} select userId, movieId, rating, timestamp, split from sp")
def _(t):
    return split.temporal_split(t.ratings)


@query("w03_tail_validation", "select userId, movieId, rating, timestamp, n >= 5 and b <= least(n - 1, greatest(1, round_even(n * 0.1, 0))) as held from (select *, count(*) over (partition by userId) as n, row_number() over (partition by userId order by timestamp desc, movieId desc, rating desc) as b from ratings)")
def _(t):
    return split.tail_validation(t.ratings)


@query("w05_rank_scaled", "select user_id, event_id, round(case when lo = hi then 0 else (rank() over (partition by user_id order by v) + (count(*) over (partition by user_id, v) - 1) / 2.0 - 1) / greatest(n - 1, 1) end, 6) as s from (select *, floor(value / 10) as v, count(*) over (partition by user_id) as n, min(floor(value / 10)) over (partition by user_id) as lo, max(floor(value / 10)) over (partition by user_id) as hi from events)")
def _(t):
    from ..functions.vectors import rank_scaled

    return t.events.withColumn("v", F.floor(F.col("value") / 10).cast("double")).select("user_id", "event_id", F.round(rank_scaled(F.col("v"), "user_id"), 6).alias("s"))


@query("w06_top_k", "select userId, movieId, rank from (select *, row_number() over (partition by userId order by score desc, movieId) as rank from (select userId, movieId, avg(rating) as score from ratings group by all)) where rank <= 10")
def _(t):
    from ..operators.rank import top_k

    return top_k(t.ratings.groupBy("userId", "movieId").agg(F.avg("rating").alias("score"))).select("userId", "movieId", "rank")


@query("w07_canonical", f"select canonical_key, movieId from (select *, row_number() over (partition by canonical_key order by u desc, movieId) as r from (select p_name as canonical_key, p_partkey as movieId, case when p_partkey % 3 = 0 then 1 else 0 end as u from part)) where r = 1")
def _(t):
    rows = t.part.select(F.col("p_name").alias("canonical_key"), F.col("p_partkey").alias("movie_id"), F.when(F.col("p_partkey") % 3 == 0, "https://x").alias("movie_url"), F.lit("1999").alias("year"))
    return prepare.canonical_movies(rows).select("canonical_key", F.col("movie_id").alias("movieId"))


BEST = "b as (select user_id, movie_id, interaction_type, rating, implicit_score, seq from (select *, row_number() over (partition by user_id, movie_id order by implicit_score desc, case interaction_type when 'favorite' then 6 when 'rating' then 5 when 'liked' then 4 when 'review' then 3 when 'diary' then 2 when 'watched' then 1 else 0 end desc, seq) as r from interactions) where r = 1)"


@query("w08_best_interactions", f"with {BEST} select * from b")
def _(t):
    return prepare.best_interactions(t.interactions)


@query("w09_keep_last", "select userId, movieId, rating, timestamp from (select *, row_number() over (partition by userId, movieId order by timestamp desc, rating desc) as r from ratings) where r = 1")
def _(t):
    return prepare.keep_one(t.ratings, ["userId", "movieId"], [F.desc("timestamp"), F.desc("rating")])


@query("w10_dense_ids", "select user_id, row_number() over (order by user_id) as by_value, row_number() over (order by first, user_id) as by_first from (select user_id, min(seq) as first from interactions group by user_id)")
def _(t):
    a = prepare.dense_ids(t.interactions, "user_id", out="by_value")
    return a.join(prepare.dense_ids(t.interactions, "user_id", order=F.col("seq"), out="by_first"), "user_id")


@query("w11_latest_rating", "select userId, movieId, max_by(rating, (timestamp, rating)) as rating from ratings group by userId, movieId")
def _(t):
    return t.ratings.groupBy("userId", "movieId").agg(F.max_by("rating", F.struct("timestamp", "rating")).alias("rating"))


def _catalog(name, sql, f):
    @query(name, f"with {SCORED} select movieId, title from sc {sql}")
    def _(t):
        return f(catalog.with_scores(t.movies, t.ratings)).select("movieId", "title")


_catalog("t01_trending", "where vote_count >= 15 order by vote_count desc, movieId limit 15", catalog.trending)
_catalog("t02_top_rated", "where vote_count >= 15 order by round(vote_average, 10) desc, movieId limit 15", catalog.top_rated)
_catalog("t03_latest", "order by year desc, vote_count desc, movieId limit 15", catalog.latest)
_catalog("t04_in_genre", "where contains(lower(genres), 'promo') order by round(vote_average, 10) desc, movieId limit 15", lambda s: catalog.in_genre(s, "PROMO"))


@query("t05_history", "select movieId, title, rating from ratings join movies using (movieId) where userId = 7 order by rating desc, timestamp desc, movieId limit 15")
def _(t):
    return catalog.history(t.ratings, t.movies, 7).select("movieId", "title", "rating")


@query("t06_similar_by_genres", f"with {SCORED}, o as (select string_split(genres, '|') as g from movies where movieId = 11) select movieId, shared from (select *, len(list_intersect(string_split(genres, '|'), g)) as shared from sc, o where movieId <> 11) where shared > 0 order by shared desc, vote_count desc, round(vote_average, 10) desc, movieId limit 15")
def _(t):
    return catalog.similar_by_genres(catalog.with_scores(t.movies, t.ratings), 11).select("movieId", F.col("shared").cast("long").alias("shared"))


@query("t08_history_titles", "select title, rating from ratings join movies using (movieId) where userId = 9 order by lower(title), rating limit 20")
def _(t):
    return t.ratings.where("userId = 9").join(t.movies, "movieId").orderBy(F.lower("title"), "rating").limit(20).select("title", "rating")


@query("t09_examples", "select movieId from movies where movieId not in (select movieId from links) order by movieId limit 10")
def _(t):
    return t.movies.join(t.links, "movieId", "left_anti").orderBy("movieId").limit(10).select("movieId")


@query("u01_upsert", "select movieId, director, status from (select movieId, director, 'old' as status from enriched where movieId % 3 <> 0 union all select movieId, 'new', 'enriched' from movies where movieId % 3 = 0)")
def _(t):
    new = t.movies.where("movieId % 3 = 0").select("movieId", F.lit("new").alias("director"), F.lit("enriched").alias("status"))
    return prepare.upsert(t.enriched.select("movieId", "director", F.lit("old").alias("status")), new, "movieId")


@query("u02_work_list", "select 'all' as mode, count(*) as n from links union all select 'only_missing', count(*) from links where movieId not in (select movieId from enriched where movieId % 2 = 0) union all select 'retry_empty', count(*) from links where movieId in (select movieId from enriched where movieId % 2 = 0 and (movieId % 10 = 0 or (trim(overview) = '' and trim(genres) = ''))) union all select 'refresh_empty', count(*) from links where movieId in (select movieId from enriched where movieId % 2 = 0 and (trim(overview) = '' or trim(genres) = ''))")
def _(t):
    have = t.enriched.where("movieId % 2 = 0").withColumn("enrichment_status", F.when(F.col("movieId") % 10 == 0, "not_found").otherwise("enriched"))
    out = None
    for mode in ("all", "only_missing", "retry_empty", "refresh_empty"):
        n = prepare.work_list(t.links, have, mode, ["overview", "genres"]).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query("u03_placeholders", "select movieId, case when movieId in (select movieId from enriched where movieId % 4 > 0) then 'enriched' else 'empty_metadata' end as enrichment_status from movies")
def _(t):
    return prepare.placeholders(t.movies, t.enriched.where("movieId % 4 > 0")).select("movieId", "enrichment_status")


@query("u04_placeholder_rows", "select movieId, 'empty_metadata' as enrichment_status from movies")
def _(t):
    return prepare.placeholder_rows(t.movies)


@query("u07_union_of_splits", f"with {SPLIT} select userId, movieId, rating from sp where rating >= 4")
def _(t):
    s = split.temporal_split(t.ratings).where("rating >= 4")
    parts = [s.where(F.col("split") == x).select("userId", "movieId", "rating") for x in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _core(p, users=60, movies=80):
    return f"(select user_id, movie_id, seq from (select *, count(*) over (partition by user_id) as u, count(*) over (partition by movie_id) as m from {p}) where u >= {users} and m >= {movies})"


def _peeled(rounds):
    out = "interactions"
    for _ in range(rounds):
        out = _core(out, 54, 6)
    return out


@query("u08_k_core", f"select user_id, movie_id, seq from {_peeled(3)}")
def _(t):
    return prepare.k_core(t.interactions.select("user_id", "movie_id", "seq"), 54, 6, rounds=3)


@query("u08_k_core_fixpoint", f"select user_id, movie_id, seq from {_peeled(8)}")
def _(t):
    return prepare.k_core(t.interactions.select("user_id", "movie_id", "seq"), 54, 6)


@query("u09_profile_upsert", "select coalesce(o.c_custkey, n.k) as c_custkey, coalesce(case when n.name <> '' then n.name end, o.c_name) as c_name, coalesce(o.c_mktsegment, n.seg) as c_mktsegment from (select * from customer where c_custkey % 5 > 0) o full join (select c_custkey as k, case when c_custkey % 2 = 0 then '' else 'new' end as name, 'NEW' as seg from customer where c_custkey % 3 = 0) n on o.c_custkey = n.k")
def _(t):
    old = t.customer.where("c_custkey % 5 > 0").select("c_custkey", "c_name", "c_mktsegment")
    new = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("new").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return prepare.upsert_filled(old, new, "c_custkey", keep=["c_mktsegment"])


@query("u10_merge_store", f"with {BEST}, k as (select user_id, movie_id, min(seq) as created_at from interactions group by all) select b.user_id, b.movie_id, b.interaction_type, b.seq, created_at from b join k using (user_id, movie_id) where movie_id in (select 'm' || movieId from movies)")
def _(t):
    rows = t.interactions.withColumn("created_at", F.col("seq"))
    known = t.movies.select(F.concat(F.lit("m"), F.col("movieId").cast("string")).alias("movie_id"))
    merged = prepare.merge_store(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), rows.select("user_id").distinct(), known)
    return merged.select("user_id", "movie_id", "interaction_type", "seq", "created_at")


@query("u11_resume_cleanup", "select seq from interactions where regexp_full_match(user_id, '[a-z0-9_-]{2,30}') and movie_id in (select 'm' || movieId from movies where movieId % 2 = 0)")
def _(t):
    from ..functions.text import valid_user_name

    known = t.movies.where("movieId % 2 = 0").select(F.concat(F.lit("m"), F.col("movieId").cast("string")).alias("movie_id"))
    return t.interactions.where(valid_user_name(F.col("user_id"))).join(known, "movie_id", "left_semi").select("seq")


@query("u12_ratings_of", "select user_id, movie_id, coalesce(rating, implicit_score) as rating, interaction_type in ('liked', 'favorite') as liked from interactions")
def _(t):
    return prepare.ratings_of(t.interactions)


@query("u13_core_catalog", f"select movieId from movies where 'm' || movieId in (select movie_id from {_core('interactions')})")
def _(t):
    core = prepare.k_core(t.interactions.select("user_id", "movie_id", "seq"), 60, 80, rounds=1)
    return t.movies.withColumn("movie_id", F.concat(F.lit("m"), F.col("movieId").cast("string"))).join(core, "movie_id", "left_semi").select("movieId")


@query("u14_frontier", "with recursive r(node, hop) as (select 3::bigint, 0 union select dst, hop + 1 from r join follows on src = node where hop < 2) select node, min(hop) as hop from r group by node")
def _(t):
    return prepare.frontier(t.follows, t.spark.createDataFrame([(3,)], "node long"), 2)


@query("u15_set_difference", f"with {SPLIT} select (select count(distinct userId) from sp where split = 'test' and userId not in (select userId from sp where split = 'train')) as users, (select count(distinct movieId) from sp where split = 'test' and movieId not in (select movieId from sp where split = 'train')) as movies")
def _(t):
    s = split.temporal_split(t.ratings)
    part = lambda x: s.where(F.col("split") == x)
    return linking.missing_counts(part("test"), part("train"), {"userId": "users", "movieId": "movies"})


@query("u16_seeded_sample", "select userId from (select distinct userId from ratings) order by md5(userId || ':42'), userId limit 100")
def _(t):
    return prepare.seeded_sample(t.ratings.select("userId").distinct(), "userId", 100)


@query("d01_shapes", "select 'ratings' as tbl, count(*) as rows, 4 as cols from ratings union all select 'movies', count(*), 3 from movies union all select 'links', count(*), 3 from links")
def _(t):
    one = lambda name, df: df.agg(F.lit(name).alias("tbl"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("cols"))
    return one("ratings", t.ratings).union(one("movies", t.movies)).union(one("links", t.links))


@query("d02_examples", "select 'unenriched' as issue, movieId from (select movieId from movies where movieId not in (select movieId from enriched) order by movieId limit 5) union all select 'unrated', movieId from (select movieId from movies where movieId not in (select movieId from ratings) order by movieId limit 5) union all select 'no genres', movieId from (select movieId from movies where genres = '(no genres listed)' order by movieId limit 5)")
def _(t):
    first = lambda issue, df: df.orderBy("movieId").limit(5).select(F.lit(issue).alias("issue"), "movieId")
    m = t.movies
    return first("unenriched", m.join(t.enriched, "movieId", "left_anti")).union(first("unrated", m.join(t.ratings, "movieId", "left_anti"))).union(first("no genres", m.where(F.col("genres") == prepare.NO_GENRES)))


@query("d03_advice", "select no_genre, sparsity_pct, concat_ws('; ', case when no_genre > 0 then 'enrich genres' end, case when sparsity_pct > 99 then 'prefer content-heavy weights' end) as advice from (select (select count(*) from movies where genres = '(no genres listed)') as no_genre, (select round_even(100.0 - count(distinct (userId, movieId)) * 100.0 / (count(distinct userId) * (select count(*) from movies)), 4) from ratings) as sparsity_pct)")
def _(t):
    gaps = quality.core_gaps(t.movies, ["title"]).select("no_genre", F.col("no_year").alias("missing_year"), F.lit(0).alias("unrated"))
    report = gaps.crossJoin(quality.sizes(t.ratings, t.movies).select("sparsity_pct"))
    return quality.advice(report).select("no_genre", "sparsity_pct", F.array_join("advice", "; ").alias("advice"))


@query("d04_missing_year", r"select movieId from (select movieId, case when movieId % 9 = 0 then regexp_replace(title, '\s*\(\d{4}\)$', '') else title end as title from movies) where regexp_extract(title, '\((\d{4})(?:[–-]\d{4})?\)', 1) = ''")
def _(t):
    from ..functions.text import without_year

    title = F.when(F.col("movieId") % 9 == 0, without_year(F.col("title"))).otherwise(F.col("title"))
    return t.movies.withColumn("title", title).where(quality.missing_year(F.col("title"))).select("movieId")
