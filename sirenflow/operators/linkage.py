"""Single linkage of points, and connected components of links, by contraction over DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.functions import geo
from sirenflow.operators.lineage import cut, saved


def components(links: DataFrame) -> DataFrame:
    """(node long, root long) for each node of ``links`` (a, b), where root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, follows the hooks by pointer doubling to the ends of their trees, and
    draws the links between these; at least half of the nodes that still have links vanish in a round, whatever their order,
    and a round takes as many doublings as the logarithm of the deepest tree. Loops, repeats and nulls do not matter.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = both(edges).select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    while not edges.isEmpty():
        hook, moved = cut(both(edges).groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))), True
        while moved:
            jump = hook.join(hook.select(F.col("a").alias("to"), F.col("to").alias("next")), "to")
            jump = cut(jump.select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            moved, hook = not jump.where("moved").isEmpty(), jump.drop("moved")
        labels = cut(labels.join(hook, labels["root"] == hook["a"], "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = edges.join(hook.select("a", F.col("to").alias("ta")), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b").where("ta != tb")
        edges = cut(ends.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    return labels


def linked_points(points: DataFrame, group: list[str], within_m: float) -> DataFrame:
    """``points`` (group columns, one at least, x, y; distinct, no nulls) with cluster: points of a group linked by steps of ``within_m`` metres.

    Cells are so small that points of one cell are always linked: they hang on the cell's first point. Points of cells near
    each other are compared, each pair of cells from one side. A group of any size is spread over its cells.
    """
    size = within_m / math.sqrt(2) * 0.999999
    mean = points.groupBy(*group).agg(F.cos(F.radians(F.avg("y"))).alias("__k"))
    p = points.select(*group, "x", "y").join(mean, group)
    p = p.withColumns({"north": F.col("y") * geo.DEGREE_M, "east": F.col("x") * geo.DEGREE_M * F.col("__k")}).drop("__k")
    p = saved(p.withColumns({"row": F.monotonically_increasing_id(), "cn": F.floor(F.col("north") / size), "ce": F.floor(F.col("east") / size)}))
    cell = [*group, "cn", "ce"]
    heads = p.groupBy(*cell).agg(F.min("row").alias("head"))
    own = p.join(heads, cell).select(F.col("row").alias("a"), F.col("head").alias("b"))
    # the cells that hold a point within reach: two steps each way, one of each two directions
    steps = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    around = p.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(j).alias("e")) for i, j in steps])))
    around = around.select(*group, (F.col("cn") + F.col("s.n")).alias("cn"), (F.col("ce") + F.col("s.e")).alias("ce"), F.col("row").alias("a"), F.col("north").alias("n1"), F.col("east").alias("e1"))
    near = around.join(p, cell).where(F.hypot(F.col("n1") - F.col("north"), F.col("e1") - F.col("east")) <= within_m).select("a", F.col("row").alias("b"))
    roots = components(own.unionByName(near))
    return p.join(roots, F.col("row") == F.col("node"), "left").select(*group, "x", "y", F.coalesce("root", "row").alias("cluster"))
