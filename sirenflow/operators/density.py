"""Cells that follow the density of places: a cell that holds too many is split in four, level by level."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenflow.functions import geo
from sirenflow.operators.lineage import saved

#: Cells of one level that may be split: with the bound below a table of them stays under 3 MB, however many places there are.
MOST_SPLIT = 100_000


def dense_cells(places: DataFrame, x: str, y: str, size: float, per_cell: int, levels: int) -> DataFrame:
    """(level, cx, cy): the cells of more than ``per_cell`` places, the whole ones at level 0, half as wide at each level on.

    Places are counted once, in the smallest cells, and the counts are added up level by level. Where places are so many that more
    than ``MOST_SPLIT`` cells of a level could be that full, a cell may hold as many times more.
    """
    fine = size / 2**levels
    counted = saved(places.groupBy(geo.cell(F.col(x), fine).alias("cx"), geo.cell(F.col(y), fine).alias("cy")).agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bound, up, out = max(per_cell, total // MOST_SPLIT), counted, None
    for level in range(levels - 1, -1, -1):
        up = up.groupBy(F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy")).agg(F.sum("n").alias("n"))
        dense = up.where(F.col("n") > bound).select(F.lit(level).alias("level"), "cx", "cy")
        out = dense if out is None else out.union(dense)
    return saved(out)


def _steps(dense: DataFrame, levels: int) -> Iterator[tuple[int, DataFrame]]:
    for level in range(levels):
        yield level, dense.where(F.col("level") == level).select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.lit(True).alias("__full"))


def in_leaf(places: DataFrame, dense: DataFrame, x: Column, y: Column, size: float, levels: int) -> DataFrame:
    """Places with level, cx, cy of their leaf, the largest cell around them that is not split."""
    p = places.withColumns({"level": F.lit(0), "cx": geo.cell(x, size), "cy": geo.cell(y, size)})
    for level, full in _steps(dense, levels):
        p = p.join(full, (F.col("level") == level) & (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")), "left")
        down, small = F.col("__full").isNotNull(), size / 2 ** (level + 1)
        p = p.withColumns({"level": F.when(down, level + 1).otherwise(F.col("level")), "cx": F.when(down, geo.cell(x, small)).otherwise(F.col("cx")), "cy": F.when(down, geo.cell(y, small)).otherwise(F.col("cy"))})
        p = p.drop("__cx", "__cy", "__full")
    return p


def to_leaves(boxes: DataFrame, dense: DataFrame, size: float, levels: int, narrowed) -> DataFrame:
    """Rows of whole cells (xlo, xhi, ylo, yhi, cx, cy) once in each leaf that their box touches, with level.

    ``narrowed(rows, width)`` is applied where rows enter smaller cells, so that a row can drop what lies outside its cell.
    """
    now, out = boxes, None
    for level, full in _steps(dense, levels):
        met = now.join(full, (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")), "left").drop("__cx", "__cy")
        leaf = met.where("__full is null").drop("__full").withColumn("level", F.lit(level))
        out = leaf if out is None else out.unionByName(leaf)
        small = size / 2 ** (level + 1)
        now = met.where("__full").drop("__full")
        for k in "xy":  # two halves each way
            now = now.withColumn(f"c{k}", F.explode(F.array(F.col(f"c{k}") * 2, F.col(f"c{k}") * 2 + 1)))
            now = now.where(F.col(f"c{k}").between(geo.cell(F.col(f"{k}lo"), small), geo.cell(F.col(f"{k}hi"), small)))
        now = narrowed(now, small)
    return out.unionByName(now.withColumn("level", F.lit(levels)))
