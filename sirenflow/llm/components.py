"""Connected components of a link table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, root long) for every node that has a link to another node.

    Each round hooks every node to its smallest neighbour, jumps pointers twice, and replaces both ends of
    each link by their parents; links inside one tree vanish. Node counts at least halve a round. Loops,
    repeated and null links are ignored; an empty table gives an empty result.
    """
    e = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    e = cut(e)
    found = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("root"))
    first = True
    while first or not e.isEmpty():
        first = False
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        up = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        for _ in range(2):
            over = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            up = up.join(over, "p").select("u", F.col("pp").alias("p"))
        up = cut(up)
        found = cut(found.join(up, found.root == up.u, "left").select("node", F.coalesce("p", "root").alias("root")))
        ua, ub = up.select(F.col("u").alias("a"), F.col("p").alias("pa")), up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        e = cut(e.join(ua, "a").join(ub, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return found
