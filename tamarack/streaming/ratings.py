"""Ratings that arrive as files: validated ingest, latest per pair, and live means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import MergedRuns

SCHEMA = "userId long, movieId long, rating double, timestamp long"


def incoming(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder; ratings out of 0.5 to 5 and rows without ids go."""
    reader = spark.readStream.schema(SCHEMA)
    rows = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)
    return rows.where(F.col("rating").between(0.5, 5.0) & F.col("userId").isNotNull() & F.col("movieId").isNotNull())


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what there is to a Parquet table, each file once."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """userId, movieId, rating, timestamp: the last of each pair by time, then by rating."""
    last = rows.groupBy("userId", "movieId").agg(F.max(F.struct("timestamp", "rating")).alias("l"))
    return last.select("userId", "movieId", F.col("l.rating").alias("rating"), F.col("l.timestamp").alias("timestamp"))


def latest_table(spark: SparkSession, folder: str) -> MergedRuns:
    """The table that keep_latest() keeps: read() has the latest rating of each pair."""
    return MergedRuns(spark, folder, latest)


def keep_latest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A table of latest(), kept up batch by batch: a batch writes its own rows, and merges runs of like size now and then."""
    return _kept(stream.select("userId", "movieId", "rating", "timestamp"), latest, folder, checkpoint)


def partial_scores(rows: DataFrame) -> DataFrame:
    """movieId, total, n of rows that hold the same: sums of sums."""
    return rows.groupBy("movieId").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def live_table(spark: SparkSession, folder: str) -> DataFrame:
    """movieId, mean, n of all ratings that live_scores() has taken in."""
    return MergedRuns(spark, folder, partial_scores).read().select("movieId", (F.col("total") / F.col("n")).alias("mean"), "n")


def live_scores(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Mean and count of each movie so far, as a table of sums that batches are added to."""
    return _kept(stream.select("movieId", F.col("rating").alias("total"), F.lit(1).cast("long").alias("n")), partial_scores, folder, checkpoint)


def _kept(stream: DataFrame, merge: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    def take_in(batch: DataFrame, number: int) -> None:
        MergedRuns(batch.sparkSession, folder, merge).add(batch, number)

    return stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
