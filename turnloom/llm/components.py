"""Connected components of a distributed edge list.

Every round each node takes the smallest label around it, hands that label to its own label's node, and jumps
to its label's label, so paths shorten by doubling. Joins are plain ones on a node or on a label; both sides come
straight from files, which lets adaptive execution split a label that many nodes share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

MAX_ROUNDS = 60
#: Rows of one part of the tables that rounds hand on; a few rows shall not become hundreds of files.
PART_ROWS = 250_000


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for each node of edges(a, b); component: the smallest node reachable.

    Loops are allowed, either direction of an edge is enough, repeated edges change nothing, an empty list
    gives an empty table. Nodes are longs and not null. Nothing but one sum a round comes to the driver.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    loops = edges.where("a = b").select("a", "b")
    both = cut(both.unionByName(loops).distinct())
    parts = max(both.sparkSession.sparkContext.defaultParallelism, -(-both.count() // PART_ROWS))

    def settle(df: DataFrame) -> DataFrame:
        return cut(df.coalesce(parts))

    near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = settle(near.select(F.col("a").alias("node"), "label"))
    total = _total(labels)
    for _ in range(max_rounds):
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        low = settle(labels.unionByName(around).groupBy("node").agg(F.max("label").alias("old"), F.min("label").alias("label")))
        hooks = low.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("label"))
        hooked = settle(low.select("node", "label").unionByName(hooks).groupBy("node").agg(F.min("label").alias("label")))
        up = hooked.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = settle(hooked.join(up, hooked.label == up["at"]).select("node", F.least("label", "up").alias("label")))
        for x in (low, hooked, labels):
            drop(x)
        labels, before, total = new, total, _total(new)
        if total == before:
            drop(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
