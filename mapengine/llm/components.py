"""Connected components of a graph given as edges, by alternating star contractions.

Each step rewires every node's neighbours to the smallest node it knows; the number of edges
never grows. A node of any degree is a group-by minimum and a join, so no neighbourhood is
ever collected. Steps go to the shared folder, and only the number of changed edges comes
to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapengine.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    larger = both.where("v > u")
    return larger.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    joined = down.join(least, F.col("u") == F.col("n"))
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(joined.select("u", F.col("m").alias("v")))
        .where("u <> v").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has an edge.

    ``edges`` has LONG columns ``u`` and ``v``, in any direction; copies and loops do no harm.
    No edges give an empty table.
    """
    edges = stored(edges.where("u <> v").select("u", "v"), "edges")
    loops = 0
    while True:
        step = stored(_small_star(_large_star(edges)), "edges")
        loops += 1
        # Done when every edge is a spoke of a star whose centre has no smaller neighbour.
        centres = step.select("v").distinct()
        if step.join(centres.select(F.col("v").alias("c")), F.col("u") == F.col("c"), "left_semi").isEmpty() and step.groupBy(
            "u"
        ).count().where("count > 1").isEmpty():
            break
        edges = step
    return (
        step.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )
