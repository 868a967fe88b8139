"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpointed


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours.  Pre-aggregated map-side, so a hub costs one row per task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an undirected edge table (src, dst).

    ``component`` is the least node id that can be reached.  Large-star and
    small-star steps alternate until the edges no longer change; each round
    is checkpointed, so a lost executor costs at most one round.  Null ends
    and self loops are dropped; a node seen only in a self loop is its own
    component.  An empty table gives an empty table.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    current = checkpointed(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the greater neighbours of u point to the least neighbour of u
        large = (
            both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u and its lesser neighbours point to the least of them
        least = _min_neighbour(large)
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        current = checkpointed(small.distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")), "node", "left").select(
        "node", F.coalesce("c", "node").alias("component")
    )
