"""Splits in time and segments of holdouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("timestamp", "movieId", "rating")


def temporal_split(ratings: DataFrame, val_ratio: float = 0.1, test_ratio: float = 0.1) -> DataFrame:
    """ratings with `split`: of each user's ratings in time order the last part is test, the one before validation.

    Users of fewer than three ratings are all train. Sizes are rounded half to even, 1 at least.
    """
    user = Window.partitionBy("userId")
    n = F.count(F.lit(1)).over(user)
    row = F.row_number().over(user.orderBy(*ORDER))
    test, val = F.greatest(F.lit(1.0), F.rint(n * test_ratio)), F.greatest(F.lit(1.0), F.rint(n * val_ratio))
    train_end = F.greatest(F.lit(1.0), n - val - test)
    split = F.when(n < 3, "train").when(row <= train_end, "train").when(row <= n - test, "validation").otherwise("test")
    return ratings.withColumn("split", split)


def tail_validation(ratings: DataFrame, ratio: float = 0.1, least: int = 5) -> DataFrame:
    """ratings with `held`: the last max(1, round(n ratio)) rows, n - 1 at most, of users with `least` or more."""
    user = Window.partitionBy("userId")
    n = F.count(F.lit(1)).over(user)
    back = F.row_number().over(user.orderBy(*[F.desc(c) for c in ORDER]))
    size = F.least(n - 1, F.greatest(F.lit(1.0), F.rint(n * ratio)))
    return ratings.withColumn("held", (n >= least) & (back <= size))


def rated_movies(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    return movies.join(ratings, "movieId", "left_semi")


def segments(holdout: DataFrame, train: DataFrame) -> DataFrame:
    """holdout with `segment`: warm if the item occurs in train, else cold."""
    seen = train.select("movieId").distinct().withColumn("__seen", F.lit(True))
    return holdout.join(seen, "movieId", "left").withColumn("segment", F.when(F.col("__seen"), "warm").otherwise("cold")).drop("__seen")
