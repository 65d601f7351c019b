"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, merged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) with component = least node of the component, by alternating large-star and small-star rounds.

    ``edges`` has two columns of one orderable type; direction, loops, repeats and null ends do not matter (edges with a null
    end are ignored). Each round is two shuffles with pre-aggregated minima; a hub is never gathered in one task. The number of
    rounds grows with the logarithm of the longest path. An empty table gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select("u").union(e.select("v")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = merged(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(down, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return merged(nodes.withColumnRenamed("u", "node"), e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
