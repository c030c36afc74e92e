"""Connected components of an edge table, by hooking and shortening; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.sources.tables import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """Each node of edges (src, dst: long) with the least node of its component: columns node, component.

    Nodes hook onto their least neighbour, chains are shortened fourfold and edges are drawn between what remains, until
    none remains. Grouping keeps minima only (map-side combined) and the joins have a table with unique keys on one side, so
    a hub's edges are dealt anew by adaptive execution. Null ends and loops are ignored; an empty table gives an empty result.
    """
    links = staged(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct(), "edges")
    chains = None  # node, up: what each node has been replaced by so far
    while not links.isEmpty():
        ends = links.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("up")))
        up = staged(ends.groupBy("node").agg(F.min("up").alias("up")), "hooks")
        for _ in range(2):
            up, before = staged(_follow(up, up), "hooks"), up
            discard(before)
        first = chains is None
        chains, before = (up, None) if first else (staged(_follow(chains, up), "roots"), chains)
        moved = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("na")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("nb")), "b")
        links, left = staged(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a < b").distinct(), "edges"), links
        discard(before, left, None if first else up)
    if chains is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return chains.select("node", F.col("up").alias("component"))


def _follow(near: DataFrame, far: DataFrame) -> DataFrame:
    step = far.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
    return near.join(step, "up", "left").select("node", F.coalesce("beyond", "up").alias("up"))
