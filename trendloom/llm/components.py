"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import settle

MAX_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    known = _both_ways(links)
    least = known.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return known.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """Columns ``node`` and ``root``, the smallest node reachable, for all nodes in ``links(u, v)``.

    Large and small stars in turn, each a grouped minimum and a join on the node; the number of
    rounds grows with the logarithm of the longest path. A node's links never meet in one row or
    one task. Links to oneself are ignored.
    """
    now = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where(F.col("u") != F.col("v")).distinct()
    mark = None
    for round_ in range(MAX_ROUNDS):
        now = settle(_small_star(_large_star(now)), f"{label}-{round_}")
        # A forest of stars is reached when a round changes no link.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
