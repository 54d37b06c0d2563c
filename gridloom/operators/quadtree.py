"""Linear quadtrees: cells as Morton intervals, split where a field varies, kept in 2:1 balance.

A tree over 2^levels by 2^levels cells is the set of its split cells (level, ci, cj); level 0 is the whole
square. A cell is split where the field's values on its points differ by more than a limit, so a
split cell's parents are split too. Balance needs each level only once, from the finest up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.comparison import morton
from ..shared import checkpoint

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def cells(field: DataFrame, levels: int, value: str = "u") -> DataFrame:
    """(level, ci, cj, spread) of every cell that may be split: how much the field varies on its points, edges included."""
    i, j = F.col("i"), F.col("j")
    size = F.expr(f"shiftleft(1, {levels} - level)")
    each = field.select("i", "j", F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).withColumn("size", size)
    near = lambda c: F.array_distinct(F.array(F.floor(c / F.col("size")), F.floor((c - 1) / F.col("size"))))  # noqa: E731  # a point on an edge counts on both sides
    most = F.expr("shiftleft(1, level)")
    placed = each.withColumn("ci", F.explode(near(i))).withColumn("cj", F.explode(near(j))).where((F.col("ci") >= 0) & (F.col("cj") >= 0) & (F.col("ci") < most) & (F.col("cj") < most))
    return placed.groupBy("level", F.col("ci").cast("int").alias("ci"), F.col("cj").cast("int").alias("cj")).agg((F.max("v") - F.min("v")).alias("spread"))


def split_cells(field: DataFrame, levels: int, limit: float, value: str = "u", balanced: bool = True) -> DataFrame:
    """(level, ci, cj) of the split cells of the tree, in 2:1 balance if asked."""
    found = cells(field, levels, value).where(F.col("spread") > limit).select("level", "ci", "cj")
    return balance(found, levels) if balanced else found


def balance(split: DataFrame, levels: int) -> DataFrame:
    """Split what must be so that leaves that share an edge differ by one level at most.

    The four neighbours of a split cell must exist, so their parents are split, up to the root. A level
    gives its demands to the next coarser one only, so one pass does.
    """
    split, by_level = checkpoint(split), []
    wanted = None
    for level in range(levels - 1, -1, -1):
        here = split.where(F.col("level") == level)
        if wanted is not None:
            here = here.unionByName(wanted).distinct()
        by_level.append(here)
        most = (1 << level) - 1
        moved = F.array(*[F.struct((F.col("ci") + a).alias("ci"), (F.col("cj") + b).alias("cj")) for a, b in SIDES])
        near = here.select(F.explode(moved).alias("n")).select("n.*").where(F.col("ci").between(0, most) & F.col("cj").between(0, most))
        wanted = near.select(F.lit(level - 1).alias("level"), F.shiftright("ci", 1).alias("ci"), F.shiftright("cj", 1).alias("cj")).distinct()
    return reduce(DataFrame.unionByName, by_level)


def leaves(split: DataFrame, levels: int) -> DataFrame:
    """(level, ci, cj, size, z0, z1): the cells of the tree that are not split, each the Morton interval [z0, z1) of finest cells."""
    split = split.select("level", "ci", "cj")
    four = F.array(*[F.struct((F.col("ci") * 2 + a).alias("ci"), (F.col("cj") * 2 + b).alias("cj")) for a in (0, 1) for b in (0, 1)])
    children = split.select((F.col("level") + 1).alias("level"), F.explode(four).alias("c")).select("level", "c.*")
    root = split.sparkSession.range(1).selectExpr("0 AS level", "0 AS ci", "0 AS cj")
    out = children.unionByName(root).join(split, ["level", "ci", "cj"], "left_anti").withColumn("size", F.expr(f"shiftleft(1, {levels} - level)"))
    return out.withColumn("z0", morton(F.col("ci") * F.col("size"), F.col("cj") * F.col("size"))).withColumn("z1", F.col("z0") + F.col("size").cast("long") * F.col("size"))


def quality(found: DataFrame, levels: int) -> DataFrame:
    """(level, leaves, share): how many leaves each level has, and what share of the square they cover."""
    area = F.col("size").cast("double") * F.col("size") / F.lit(float(4**levels))
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("leaves"), F.sum(area).alias("share"))
