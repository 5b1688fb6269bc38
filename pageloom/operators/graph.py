"""Connected components and independent sets on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.skew import checkpoint


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component (its smallest id) of every node that has an edge.

    Alternating star contraction: each round links nodes to the smallest
    neighbour seen, which needs few rounds also for long chains.  A node with
    very many edges is only ever aggregated and joined, never collected.
    Rounds are cut by a reliable checkpoint.
    """
    e = checkpoint(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = _signature(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(small_min.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def first_come_set(edges: DataFrame) -> DataFrame:
    """Greedy choice on a conflict graph, without walking it node by node.

    ``edges``: winner, loser: two nodes in conflict, the one served first under
    ``winner``.  A node is dropped when some earlier neighbour is kept.  Each
    round keeps every open node without an open earlier neighbour and drops
    their neighbours; the outcome equals serving the nodes one by one.
    Result: node, kept.
    """
    open_edges = checkpoint(edges.select("winner", "loser").distinct())
    done: DataFrame | None = None
    # every round decides the first-served open node at least, so this ends
    while not open_edges.isEmpty():
        nodes = open_edges.select(F.col("winner").alias("node")).unionByName(
            open_edges.select(F.col("loser").alias("node"))
        ).distinct()
        kept = checkpoint(nodes.join(open_edges.select(F.col("loser").alias("node")), "node", "left_anti"))
        dropped = checkpoint(
            open_edges.join(kept.withColumnRenamed("node", "winner"), "winner", "left_semi").select(
                F.col("loser").alias("node")
            ).distinct()
        )
        decided = kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))
        gone = decided.select("node")
        rest = open_edges.join(gone.withColumnRenamed("node", "winner"), "winner", "left_anti").join(
            gone.withColumnRenamed("node", "loser"), "loser", "left_anti"
        )
        # nodes whose last open neighbour was dropped stay: they are kept too
        left = rest.select(F.col("winner").alias("node")).unionByName(rest.select(F.col("loser").alias("node"))).distinct()
        free = nodes.join(gone, "node", "left_anti").join(left, "node", "left_anti").withColumn("kept", F.lit(True))
        decided = decided.unionByName(free)
        done = checkpoint(decided if done is None else done.unionByName(decided))
        open_edges = checkpoint(rest.select("winner", "loser"))
    if done is None:
        return edges.select(F.col("winner").alias("node"), F.lit(True).alias("kept")).limit(0)
    return done
