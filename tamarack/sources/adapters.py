"""Ratings, catalog and interaction views over the given tables, for Spark and, as text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_tasks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SPARK = {
    "ratings": "select o_custkey userId, l_partkey movieId, cast(ceil(l_quantity/5)/2 as double) rating, unix_timestamp(cast(o_orderdate as timestamp)) as timestamp from {lineitem} join {orders} on l_orderkey = o_orderkey",
    "movies": "select cast(p_partkey as bigint) movieId, concat(p_name,' (',cast(1970+p_size as string),')') title, case when p_partkey%50=0 then '(no genres listed)' else concat_ws('|',p_type,p_brand) end genres from {part}",
    "links": "select cast(p_partkey as bigint) movieId, concat('tt',cast(p_partkey as string)) imdbId, case when p_partkey%20=0 then '' else cast(p_partkey*7 as string) end tmdbId from {part} where p_partkey%40 <> 1",
    "tags": "select user_id userId, cast(get_json_object(props,'$.k') as bigint) movieId, event_type tag, unix_timestamp(cast(ts as timestamp)) as timestamp, event_id seq from {events}",
    "enriched": "select cast(p_partkey as bigint) movieId, case when doc_id%10=0 then '' else text end overview, source director, lang original_language, case when p_partkey%3=0 then 'Drama|Action' else '' end genres, cast(n_chars as string) runtime from {part} join {documents} on doc_id = p_partkey",
    "genome_scores": "select l_partkey movieId, l_suppkey tagId, max(l_discount*10) relevance from {lineitem} group by l_partkey, l_suppkey",
    "genome_tags": "select s_suppkey tagId, lower(s_name) tag from {supplier}",
    "interactions": "select concat('u',cast(user_id as string)) user_id, concat('m',get_json_object(props,'$.k')) movie_id, case event_type when 'purchase' then 'rating' when 'click' then 'liked' when 'error' then 'review' when 'signup' then 'diary' else 'watched' end interaction_type, case when event_type='purchase' then cast((cast(floor(value) as bigint)%10+1)/2.0 as double) end rating, cast(case event_type when 'purchase' then cast((cast(floor(value) as bigint)%10+1)/2.0 as double) when 'click' then 4.0 when 'error' then 3.5 when 'signup' then 3.0 else 2.5 end as double) implicit_score, event_id seq from {events}",
    "follows": "select distinct user_id src, cast(get_json_object(props,'$.k') as bigint) dst from {events} where cast(get_json_object(props,'$.k') as bigint) <> user_id",
}
DUCK = {
    k: v.replace("unix_timestamp(cast(o_orderdate as timestamp))", "cast(floor(epoch(cast(o_orderdate as timestamp))) as bigint)")
    .replace("unix_timestamp(cast(ts as timestamp))", "cast(floor(epoch(cast(ts as timestamp))) as bigint)")
    .replace("get_json_object(props,'$.k')", "json_extract_string(props,'$.k')")
    .replace("{", "")
    .replace("}", "")
    for k, v in SPARK.items()
}


class Tables:
    """Given tables and views over them, read when asked for: t.ratings, t.documents."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = bounded_tasks(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in SPARK:
            raise AttributeError(name)
        text = SPARK[name]
        return self.spark.sql(text, **{t: getattr(self, t) for t in TABLES if "{" + t + "}" in text})

    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("movieId"), "embedding")


def oracle(body: str) -> str:
    """SQL for DuckDB: body with the views that it names."""
    import re

    names = [k for k in DUCK if re.search(rf"\b{k}\b", body)]
    views = ", ".join(f"{k} as ({DUCK[k]})" for k in names)
    if not views:
        return body
    head = re.match(r"\s*with\s+(recursive\s+)?", body, re.I)
    if head:
        return f"with {head[1] or ''}{views}, {body[head.end():]}"
    return f"with {views} {body}"
