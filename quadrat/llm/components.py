"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregate or a join on node ids; no neighbourhood is gathered in one task and the driver holds nothing.
The smallest neighbour of each node is written to the shared folder before it is joined, so both sides of the join are
plain exchanges and a hub with a third of all edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import Kept, is_empty


def _with_smallest(edges: DataFrame, kept: Kept) -> DataFrame:
    low = kept.keep(edges.groupBy("a").agg(F.min("b").alias("low")))
    return edges.join(low.hint("merge"), "a")


def components(edges: DataFrame, kept: Kept) -> DataFrame:
    """(node, component) of every node with an edge to another; component: the smallest id reachable.

    ``edges``: columns a, b of one integer type. Loops, repeated edges and either order are fine; an edge with a null
    end is dropped. An empty table gives an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = kept.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = kept.keep(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = _with_smallest(both, kept).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = kept.keep(large.distinct())
        joined = _with_smallest(large, kept)
        small = joined.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = kept.keep(small.select("e.a", "e.b").where("a <> b").distinct())
        rooted = edges.join(edges.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi")
        if is_empty(rooted) and is_empty(edges.groupBy("a").count().where("count > 1")):
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return kept.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
