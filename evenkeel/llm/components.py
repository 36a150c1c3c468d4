"""Connected components of a graph given as edges, by alternating star contraction.

Every round replaces each node's edges by edges to its smallest neighbour, once among the larger
and once among the smaller neighbours, until all components are stars around their smallest node.
The number of rounds grows with the logarithm of the graph. Only minima per node are aggregated,
so no node's neighbours are ever collected; the edges are written to the shared folder after each
round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenkeel.session import stored


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, for all practical purposes: their number and two digests."""
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "to")), F.bit_xor(F.xxhash64("to", "node", F.lit(1)))).first()
    )


def _towards_least(edges: DataFrame) -> DataFrame:
    """Of edges (node, to), each node's least ``to`` beside every edge. The minima are written
    first: an aggregation on the join's key would stop adaptive execution from splitting a hot node."""
    least = edges.groupBy("node").agg(F.min("to").alias("least"))
    return edges.join(stored(edges.sparkSession, least, "least"), "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Edges may repeat, point either way or be loops; those with a null end are ignored. A node
    that has no edge but loops is not in the result.
    """
    spark = edges.sparkSession
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct()
    now, before = stored(spark, now, "edges"), None
    while (state := _state(now)) != before:
        before = state
        # Smaller neighbours: all of them, and the node, go to the least one.
        small = _towards_least(now)
        now = small.select(
            F.explode(F.array(F.struct("node", F.col("least").alias("to")), F.struct(F.col("to").alias("node"), F.col("least").alias("to")))).alias("e")
        ).select("e.*").filter("node != to").distinct()
        # Larger neighbours: all of them go to the least one of the node's neighbours, or to the node.
        both = stored(spark, now.unionByName(now.select(F.col("to").alias("node"), F.col("node").alias("to"))), "edges")
        large = _towards_least(both).filter("to > node")
        now = large.select(F.col("to").alias("node"), F.least("least", "node").alias("to")).distinct()
        now = stored(spark, now, "edges")
    return now.select("node", F.col("to").alias("root"))
