"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, forget


def components(links: DataFrame, rows_a_task: int = 50_000) -> DataFrame:
    """node, component (its smallest node) for the nodes of links (a, b), longs.

    In each round every node moves to the neighbour, or stays itself, that comes first in a fresh
    random order; links are renamed and links within a node disappear. Paths, stars and cliques
    alike shrink by a constant factor, and no hot node's links meet in one place: the minimum is
    combined before the shuffle. Null ends and self-links only name nodes. rows_a_task: small rounds
    need few tasks, whatever the number of shuffle partitions.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    labels = nodes.withColumn("component", F.col("node"))
    edges, labels = durable(links.filter("a <> b").select("a", "b").distinct()), durable(labels)
    parts = lambda df: 1 + df.count() // rows_a_task
    label_parts, turn = parts(labels), 0
    while not edges.isEmpty():
        turn += 1
        n = parts(edges)
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("r"), F.col(c).alias("v"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        moves = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("old"), F.least(F.col("m"), rank("a"))["v"].alias("new"))
        moves = durable(moves.coalesce(n))
        left = edges.join(moves.select(F.col("old").alias("a"), F.col("new").alias("a2")), "a").drop("a")
        left = left.join(moves.select(F.col("old").alias("b"), F.col("new").alias("b2")), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        left = durable(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(n))
        moved = labels.join(moves.select(F.col("old").alias("component"), "new"), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        moved = durable(moved.coalesce(label_parts))
        forget(edges, labels, moves)
        edges, labels = left, moved
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
