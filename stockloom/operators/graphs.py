"""Connected components of many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockloom.session import published


def _to_least(edges: DataFrame) -> DataFrame:
    """Ties every node and all its neighbours to the least of them."""
    both = edges.unionByName(edges.select("space", F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("space", "a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    tied = both.join(least, ["space", "a"])
    links = tied.select("space", F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return links.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """space, node, component (the least node reachable) of every node of an edge (space, a, b); an edge of a node with
    itself names a lone node.

    In every round each node brings its neighbours to the least of them, so that chains shorten by doubling; the rounds
    end when nothing changes, which leaves one star per component. Each is written to the shared folder.
    """
    nodes = published(edges.select("space", F.col("a").alias("node")).unionByName(edges.select("space", F.col("b").alias("node"))).distinct())
    now, before = published(edges.filter("a <> b").select("space", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("space", "a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        now, before = published(_to_least(now)), state
    roots = now.groupBy("space", F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.join(roots, ["space", "node"], "left").withColumn("component", F.coalesce("component", "node"))
