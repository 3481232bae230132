"""Ranking and rating metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "ndcg", "mrr")
#: Fixed value: the name of the evaluation protocol.
PROTOCOL = "per_user_temporal_80_10_10_pos4_full"


def relevant(holdout: DataFrame, threshold: float = 4.0) -> DataFrame:
    return holdout.where(F.col("rating") >= threshold).select("userId", "movieId").distinct()


def user_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10, extra: tuple[str, ...] = ()) -> DataFrame:
    """Metrics at k of each user of truth(userId, movieId, *extra) and each group of the extra columns, from ranked(userId, movieId, rank).

    Precision divides by the rows returned.
    """
    spark = ranked.sparkSession
    keys = ["userId", *extra]
    top = ranked.where(F.col("rank") <= k)
    returned = top.groupBy("userId").agg(F.count("*").alias("returned"))
    wanted = truth.groupBy(*keys).agg(F.count("*").alias("wanted"))
    hits = truth.join(top, ["userId", "movieId"]).groupBy(*keys).agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"), F.min("rank").alias("first"))
    ideal = spark.range(1, k + 1).select(F.col("id").alias("m"), F.sum(1 / F.log2(F.col("id") + 1)).over(Window.orderBy("id")).alias("best"))  # k rows
    rows = wanted.join(hits, keys, "left").join(returned, "userId", "left").join(F.broadcast(ideal), F.least(F.col("wanted"), F.lit(k)) == F.col("m"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.select(
        *keys,
        zero(F.col("hits") / F.col("returned")).alias("precision"),
        zero(F.col("hits") / F.col("wanted")).alias("recall"),
        zero(F.col("gain") / F.col("best")).alias("ndcg"),
        zero(1 / F.col("first")).alias("mrr"),
    )


def averaged(by_user: DataFrame, users: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the users measured, or, with users(userId), over all of those, 0 where there is no measure."""
    rows = by_user if users is None else users.select("userId").distinct().join(by_user, "userId", "left")
    return rows.groupBy(*by).agg(F.count("*").alias("users"), *[F.coalesce(F.avg(F.coalesce(m, F.lit(0.0))), F.lit(0.0)).alias(m) for m in METRICS])


def rating_errors(predictions: DataFrame) -> DataFrame:
    """rmse and mae of prediction against rating; 0 without rows."""
    e = F.col("prediction") - F.col("rating")
    return predictions.agg(F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)).alias("rmse"), F.coalesce(F.avg(F.abs(e)), F.lit(0.0)).alias("mae"))


def with_segments(truth: DataFrame) -> DataFrame:
    """truth(userId, movieId, segment) with every row also in segment `all`."""
    return truth.withColumn("segment", F.explode(F.array(F.lit("all"), F.col("segment"))))
