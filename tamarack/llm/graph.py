"""Connected components of a link table, by alternating large and small stars over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): the component's smallest node.

    Rounds until nothing changes; each is cut by a checkpoint. No links give an empty result.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # Large star: neighbours that are larger move to the least neighbour. Rows are dealt by node once for all that needs them so.
        both = pairs_of(edges, ("u", "v"), ("v", "u")).repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").repartition("u").distinct()
        # Small star: each node and its smaller neighbours move to the least of them.
        moved = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = pairs_of(moved, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs_of(edges, ("u", "v"), ("v", "v")).distinct().toDF("node", "component")


def pairs_of(rows: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """(u, v): rows read once, and each of the pairs of columns for every row."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in columns])).alias("e")).select("e.*")
