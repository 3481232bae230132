"""Leaderboards: metric names, fixed rows, order and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prepare import keep_one

#: Metrics, segments and columns of a leaderboard row, its protocol and seed.
NAMES = ("precision@10", "recall@10", "ndcg@10", "mrr@10", "rmse", "mae")
SEGMENTS = ("warm", "cold")
COLUMNS = (
    "dataset", "protocol", "model", "model_family", "source", "tuned_weights",
    "precision@10", "recall@10", "ndcg@10", "mrr@10",
    "warm_precision@10", "warm_recall@10", "warm_ndcg@10", "warm_mrr@10", "cold_precision@10", "cold_recall@10", "cold_ndcg@10", "cold_mrr@10",
    "precision@20", "recall@20", "ndcg@20", "mrr@20", "rmse", "mae", "best_epoch", "warm_interactions", "cold_interactions", "artifact_dir", "command", "seed",
)
MEASURED = COLUMNS[6:27]
SEED = 42
ORDER = ("ndcg@10", "mrr@10", "recall@10", "precision@10")


def normal_metrics(raw: DataFrame, k: int = 10) -> DataFrame:
    """(run, metric, value) of raw(run, metric, value): names in one spelling, those asked for by segment first.

    all_x and x_at_k mean x; test_x and rating_x of errors mean x. A trainer that gives a metric both
    bare and for all means the bare one as that of the warm segment.
    """
    raw = raw.withColumn("spelled", F.lower("metric"))
    name = F.regexp_replace("spelled", f"_at_k$|_at_{k}$", f"@{k}")
    name = F.regexp_replace(name, "^(test|test_result)[._]", "")
    name = F.regexp_replace(name, "^rating_(rmse|mae)$", "$1")
    name = F.regexp_replace(name, "^(warm|cold)_test_interactions$", "$1_interactions")
    rows = raw.withColumn("name", name)
    plain = rows.withColumns({"priority": F.when(F.startswith("name", F.lit("all_")), 2).otherwise(1), "name": F.regexp_replace("name", "^all_", "")})
    both = raw.where(F.startswith("spelled", F.lit("all_"))).select("run", F.substr("spelled", F.lit(5)).alias("spelled")).distinct()
    bare = rows.where(F.col("spelled").rlike("^(precision|recall|ndcg|mrr)_at_k$")).join(both, ["run", "spelled"], "left_semi")
    warm = bare.withColumns({"priority": F.lit(0), "name": F.concat(F.lit("warm_"), F.col("name"))})
    known = plain.unionByName(warm).where(F.col("name").isin(*MEASURED))
    return known.groupBy("run", F.col("name").alias("metric")).agg(F.max_by("value", "priority").alias("value"))


def leaderboard_rows(metrics: DataFrame, runs: DataFrame, protocol: str, seed: int = SEED) -> DataFrame:
    """One row of COLUMNS for each of runs(run, dataset, model, model_family, source, artifact_dir, and perhaps tuned_weights and command).

    Metrics that a run lacks are null; missing texts are empty, missing weights are '{}'.
    """
    wide = metrics.groupBy("run").pivot("metric", list(MEASURED)).agg(F.first("value"))
    given = {"tuned_weights": "{}", "artifact_dir": "", "command": ""}
    rows = runs.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in runs.columns else F.lit(d) for c, d in given.items()})
    rows = rows.withColumns({"protocol": F.lit(protocol), "seed": F.lit(seed)})
    return rows.join(wide, "run", "left").select(*[F.col(f"`{c}`") for c in COLUMNS])


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[F.desc_nulls_last(f"`{c}`") for c in ORDER], "model")


def best_with_artifact(rows: DataFrame) -> DataFrame:
    return ordered(rows.where(F.coalesce("artifact_dir", F.lit("")) != "")).limit(1)


def merged(groups: list[DataFrame]) -> DataFrame:
    """Rows of all groups; of those that agree in dataset, model and artifact_dir, the last group's."""
    all_ = None
    for i, g in enumerate(groups):
        g = g.withColumn("__group", F.lit(i))
        all_ = g if all_ is None else all_.unionByName(g, allowMissingColumns=True)
    return keep_one(all_, ["dataset", "model", "artifact_dir"], [F.desc("__group")]).drop("__group")


def replace_dataset(overall: DataFrame, rows: DataFrame, dataset: str) -> DataFrame:
    return overall.where(F.col("dataset") != dataset).unionByName(rows, allowMissingColumns=True)


def same_protocol(rows: DataFrame, protocol: str) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_and(F.col("protocol") == protocol), F.lit(False)).alias("same"))
