"""Connected components of an edge table, by contraction.

Each round every node points to its smallest neighbour, pointers are followed
twice, and edges are carried over to the nodes pointed at.  Edges inside one
node vanish; the rest is contracted again, so nodes at least halve per round.
Minima are aggregated before the shuffle, so a node with very many edges costs
no single task more than its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domquarry.llm.common import save, saved_within


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: any orderable type, not null) -> node, root: the
    smallest node of its component, for every node that an edge names."""
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = both.select(F.col("a").alias("node")).distinct()
    links, roots = save(both.filter("a != b").distinct(), "links"), None
    while not links.isEmpty():
        # what a round saved on its way goes at its end; its links and roots stay
        with saved_within(spark) as keep:
            up = save(links.groupBy(F.col("a").alias("node")).agg(
                F.least(F.col("a"), F.min("b")).alias("root")), "pointers")
            for _ in range(2):
                far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
                up = up.join(far, "root").select("node", F.col("far").alias("root"))
            up = save(up, "pointers")
            step = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            roots = keep(up if roots is None else roots.join(step, "root", "left").select(
                "node", F.coalesce("far", "root").alias("root")), "roots")
            left = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
            right = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            carried = links.join(left, "a").join(right, "b").filter("ra != rb")
            links = keep(carried.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if roots is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
