"""Connected components of an edge table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.llm.common import cut

# Edges that a task takes at least, where there are so many.
EDGES_OF_TASK = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionByName(turned)


def _star(neighbours: DataFrame) -> DataFrame:
    """a, b, low: the neighbours of each a with the smallest of a and them."""
    lows = neighbours.groupBy("a").agg(F.min("b").alias("low"))
    lows = lows.select("a", F.least("a", "low").alias("low"))
    return neighbours.join(lows, "a")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b: long) to (node, root): the smallest node that each node can reach.

    Nodes without edges are not listed. Each round points the larger neighbours of every node
    at its smallest neighbour, then the smaller ones; rounds grow with the logarithm of the
    longest path. A hub's neighbours are never gathered: its smallest one is an aggregate that
    is joined back.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, state = cut(ordered.distinct()), None
    n_edges = current.count()
    while True:
        # Few edges take few tasks: each task of each shuffle leaves files of its own.
        few = -(-n_edges // EDGES_OF_TASK) or 1
        current = current.coalesce(few)
        large = _star(_both_ways(current)).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").coalesce(2 * few).distinct().coalesce(few)
        small = _star(large)
        small = (
            small.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(small.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .coalesce(2 * few)
            .distinct()
        )
        current = cut(small.coalesce(few))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, n_edges = now, now[0]
