"""Connected components of an edge table, as joins and aggregations; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _jump(parents: DataFrame) -> DataFrame:
    """Every node's parent's parent, where there is one."""
    up = parents.select(F.col("hi").alias("_at"), F.col("lo").alias("_up"))
    return parents.join(up, parents.lo == up._at, "left").select("hi", F.coalesce("_up", "lo").alias("lo"), F.col("_up").isNotNull().alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp: for each node of edges (a, b), the smallest node reachable, if that is another one.

    Every node hooks onto its smallest smaller neighbour; pointer jumping makes these trees flat; edges are then
    contracted to edges between roots, until none is left. Null ends and loops are ignored. A node with very many
    edges is no heavy key: its edges are aggregated before they are dealt out, and only joins, whose large
    partitions Spark splits, see them one by one.
    """
    ends = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    left = materialize(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*ends("a", "b")).where("hi <> lo").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        tree = materialize(left.groupBy("hi").agg(F.min("lo").alias("lo")), "parents")
        while True:
            flat = materialize(_jump(tree), "jump")
            done = flat.where("moved").isEmpty()
            discard(tree)
            tree = flat
            if done:
                break
        low = tree.select(F.col("hi").alias("_at"), F.col("lo").alias("_root"))
        high = tree.select(F.col("hi").alias("_from"), F.col("lo").alias("_to"))
        roots = left.join(high, left.hi == high._from).select("_to", "lo").join(low, F.col("lo") == F.col("_at"), "left").select(F.col("_to").alias("a"), F.coalesce("_root", "lo").alias("b"))
        contracted = materialize(roots.select(*ends("a", "b")).where("hi <> lo").distinct(), "edges")
        new = tree.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
        if labels is not None:
            moved = labels.join(low, F.col("comp") == F.col("_at"), "left").select("node", F.coalesce("_root", "comp").alias("comp"))
            new = moved.unionByName(new)
        before, labels = labels, materialize(new, "labels")
        for table in (left, tree, before):
            if table is not None:
                discard(table)
        left = contracted
    return labels if labels is not None else left.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
