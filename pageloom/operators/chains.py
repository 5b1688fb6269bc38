"""Following pointers from a start: which rows lie on the way, and as the how-manieth.

Some rules are sequential by nature: where one batch or ban ends decides where the
next may begin.  Each row can say alone where it would lead, though, so these
rules become pointers, and a chain of n pointers is followed in log2(n) rounds of
equi-joins (pointer doubling) instead of n steps in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.skew import checkpoint


def chain_ranks(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, rank) of all nodes on the chains that begin at ``starts``.

    ``edges``: node, next, steps (how many links the pointer stands for), at
    most one edge per node and no cycle; ``starts``: node.  A node without an edge ends its
    chain.  After k rounds the first 2^k nodes of each chain are
    known; a round joins each table once on the node, so no chain is ever in one task.
    """
    jump = checkpoint(edges.select("node", "next", F.col("steps").cast("long").alias("steps")))
    reached = checkpoint(starts.select("node", F.lit(0).cast("long").alias("rank")))
    while True:
        found = checkpoint(
            reached.join(jump, "node").select(F.col("next").alias("node"), (F.col("rank") + F.col("steps")).alias("rank"))
        )
        if found.isEmpty():
            return reached
        reached = reached.unionByName(found)
        onward = jump.select(F.col("node").alias("next"), F.col("next").alias("_then"), F.col("steps").alias("_more"))
        jump = checkpoint(jump.join(onward, "next").select(
            "node", F.col("_then").alias("next"), (F.col("steps") + F.col("_more")).alias("steps")
        ))
