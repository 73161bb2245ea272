"""Connected components of a graph in a table, by alternating large and small stars.

Each round needs aggregations and joins on the node alone; edges are written between rounds. A node with very many
neighbours is joined with one row, its smallest neighbour, so its edges can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import saved


def _star(edges: DataFrame) -> DataFrame:
    """For each (u, v): v with the smallest of u and u's neighbours. Rows with v equal to it fall away."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _oriented(edges: DataFrame) -> DataFrame:
    """Larger end first, once each, without loops."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of an edge, component being its smallest reachable node.

    ``edges`` has two integer columns u and v; direction, repeats and loops do not matter, NULL ends are left out. A node with
    loops alone does not appear. Raises if the rounds do not suffice (they grow with the logarithm of the paths' length).
    """
    now = saved(_oriented(edges.select("u", "v").na.drop()), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = _oriented(large)
        small = _star(down)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = saved(_oriented(hung), "edges")
        if _state(after) == _state(now):
            return after.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        now = after
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
