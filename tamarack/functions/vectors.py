"""Vectors and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v over its length, which counts as 1e-12 at least."""
    over = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12))))  # the length is taken once
    return over[0]


def rank_scaled(score: Column, *by: str) -> Column:
    """Average rank of score within a group, scaled to 0 to 1; 0 if all are equal. Null and non-finite count as least.

    Scores are rounded first, so values that differ by rounding noise share a rank.
    """
    x = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), F.lit(-1.7e308)).otherwise(F.round(score, 10))
    group = Window.partitionBy(*by)
    average = F.rank().over(group.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0
    n = F.count(F.lit(1)).over(group)
    flat = F.min(x).over(group) == F.max(x).over(group)
    return F.when(flat, 0.0).otherwise((average - 1) / F.greatest(n - 1, F.lit(1)))


def top_rank(score: Column, by: str, tie: str, digits: int = 10) -> Column:
    """Place within a group by score, the largest first, ties to the smaller id."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.round(score, digits).desc(), F.col(tie)))


def match_share(score: Column, by: str) -> Column:
    """Scores of one request scaled to 0.60 to 0.99; 0.85 if flat."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, 0.60 + 0.39 * (score - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.85)


def match_share_alone(score: Column) -> Column:
    return F.when(score > 0, F.greatest(F.lit(0.1), F.least(F.lit(1.0), score / 5.0))).otherwise(0.85)


def to_rating(unit_score: Column) -> Column:
    return 0.5 + 4.5 * unit_score
