"""Streaming queries: the ratings of the given tables, arriving as files, give what the batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_folder
from ..streaming import ratings as stream
from .registry import query


def _arrive(t) -> str:
    """The ratings as files in a new folder that all executors share; an invalid row among them."""
    folder = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    bad = t.ratings.limit(1).withColumn("rating", F.lit(9.0))
    t.ratings.union(bad).select("userId", "movieId", "rating", F.col("timestamp").cast("long").alias("timestamp")).repartition(4, "userId").write.parquet(f"{folder}/in")
    return folder


@query("r01_ingest", "select userId, movieId, rating, timestamp from ratings")
def _(t):
    folder = _arrive(t)
    stream.ingest(stream.incoming(t.spark, f"{folder}/in"), f"{folder}/table", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/table")


@query("r02_latest", "select userId, movieId, max_by(rating, (timestamp, rating)) as rating from ratings group by userId, movieId")
def _(t):
    folder = _arrive(t)
    stream.keep_latest(stream.incoming(t.spark, f"{folder}/in", 2), f"{folder}/table", f"{folder}/state").awaitTermination()
    return stream.latest_table(t.spark, f"{folder}/table").read().select("userId", "movieId", "rating")


@query("r03_live_scores", "select movieId, round(avg(rating), 6) as mean, count(*) as n from ratings group by movieId")
def _(t):
    folder = _arrive(t)
    stream.live_scores(stream.incoming(t.spark, f"{folder}/in", 2), f"{folder}/table", f"{folder}/state").awaitTermination()
    return stream.live_table(t.spark, f"{folder}/table").select("movieId", F.round("mean", 6).alias("mean"), "n")
