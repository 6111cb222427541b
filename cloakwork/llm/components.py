"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def connected_components(edges: DataFrame, most_rounds: int = 60, written: bool = False) -> DataFrame:
    """Edges (a, b) of any orderable type -> (node, component), component being the least node reachable.

    Loops, repeated edges and edges with a null end are ignored; only nodes with an edge to another node
    are returned, as a written table. Each round is aggregations and equi-joins over the edge table, at most as long as before,
    and is written to the shared folder; a hub never meets in one task because the minimum is aggregated
    before the shuffle and the joins can be split. The rounds end when all edges form stars around least nodes, which
    the minima of a round already tell. written: the edges are written tables without repeated edges, and need not be written again.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    given = now if written else None
    if not written:
        now = materialise(now.distinct(), "edges")
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        # the minima are written first, so that Spark can split a hub's rows in the joins with them
        least = both.groupBy("node").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        least = materialise(least.select("node", F.least("node", "m").alias("component"), "k"), "least")
        found = least.select("node", "component")
        found._written_to = least._written_to
        if least.where("component < node and k > 1").isEmpty():
            if now is not given:
                discard(now)
            return found
        large = both.where("v > node").join(found.hint("merge"), "node").select(F.col("v").alias("hi"), F.col("component").alias("lo"))
        large = materialise(large, "large")
        lows = materialise(large.groupBy("hi").agg(F.min("lo").alias("m")), "lows")
        small = (
            large.join(lows.hint("merge"), "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(lows.select("hi", "m"))
            .distinct()
        )
        then, now = now, materialise(small, "edges")
        for old in (then, least, large, lows):
            if old is not given:
                discard(old)
    raise RuntimeError(f"no stars after {most_rounds} rounds")
