"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.lineage import cut


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an undirected edge table; a component is named by its smallest node.

    Each round links all larger neighbours of a node to its smallest neighbour, then all
    smaller ones (large and small stars), so that a chain of n nodes takes about log n
    rounds and no group is gathered in one row. Edges with a null end and loops link
    nothing, though a loop's node comes out; repeated edges count once. Rounds are cut
    with checkpoint(). Raises where most_rounds don't suffice.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).where("node is not null").distinct()
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = cut(e), None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
        after = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())
        if after == before:
            return nodes.join(e.groupBy("u").agg(F.min("v").alias("c")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("c", "node").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
