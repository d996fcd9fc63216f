"""Connected components of a graph of 64-bit nodes, by alternating star joins.

Each round links every node's larger neighbours to its smallest one (large star)
and then its smaller neighbours to the smallest (small star), until each
component is one star around its smallest node. A round is two aggregations and
two joins on the node; only the smallest neighbour of a node is ever gathered,
so a node with very many links costs no more memory than any other, and Spark
splits the large side of the join. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.base import saved

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (no order) -> node, root for each node that is not its own root."""
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        edges = saved(_small_star(_large_star(edges)), "stars")
    raise RuntimeError("components did not settle")
