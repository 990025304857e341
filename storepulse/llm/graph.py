"""Connected components of a link table, without collecting links or gathering a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of the edges: two numbers for the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, are linked to the least node it knows.

    Minima are combined before the shuffle; the join back has one row per node on its small side, so a hot
    node's rows may be split among tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = cut_lineage(large)  # u > v in every row from here on
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (longs, either order, repeats allowed) to ``node``, ``root``: each linked node and the least
    node of its component. Alternating stars until nothing changes; each round is a written table."""
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _signature(now)
    while seen[0]:
        after = _star(now)
        if (sign := _signature(after)) == seen:
            break
        now, seen = after, sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
