"""Connected components of an edge table by alternating large-star and small-star.

Edges stay distributed; each round is written to shared storage, so a lost executor costs at most the
running round.  The driver only sees a row count and a checksum of each round's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _hook(edges: DataFrame, *, larger: bool) -> DataFrame:
    """Link neighbours to the smallest id around a node: the larger ones (large star), or all of a node's smaller ones and itself (small star).

    ``edges`` has a > b.
    """
    if larger:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.distinct()


def connected_components(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """(id, component) for every node that is not its component's smallest id.

    ``edges`` has columns a and b in any direction; loops, repeats and nulls are ignored.  No edges: no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = workspace.stage(edges.distinct(), f"{name}-0", rows=edges.count())
    seen, step = _checksum(edges), 0
    while seen[0]:
        step += 1
        # A round makes at most two edges of each.
        edges = workspace.stage(_hook(_hook(edges, larger=True), larger=False), f"{name}-{step}", rows=2 * seen[0])
        workspace.drop(f"{name}-{step - 1}")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
