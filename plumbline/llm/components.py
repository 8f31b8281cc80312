"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, join_counts


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of ``links`` (``src``, ``dst``); a component is named by its
    smallest node.

    A round links every node's larger neighbours to its smallest one, then its smaller ones. Minima
    are aggregated before the shuffle and joined back, so a hub is a skewed join that adaptive
    execution splits, never a collected list. The link table of each round is checkpointed; only its
    size and a checksum come to the driver. Rounds grow with the logarithm of a component's diameter.
    """
    edges = (
        links.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .filter("hi <> lo").distinct()
    )
    edges = checkpoint(edges)
    seen = None
    for _ in range(max_rounds):
        # Large star: all larger neighbours of a node go to the smallest of its neighbours and itself.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            join_counts(both, least, "u").filter("v > u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        )
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = join_counts(large, least, "hi").select(
            F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e")
        )
        edges = checkpoint(
            small.select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo")).filter("hi <> lo").distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
