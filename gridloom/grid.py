"""Structured 2-D grids: metadata on the driver, points as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = ("left", "right", "bottom", "top")


@dataclass(frozen=True)
class Grid:
    """nx by ny points over x0..x1, y0..y1; a field on it is a frame (i, j, value columns)."""

    nx: int
    ny: int
    x0: float = 0.0
    x1: float = 1.0
    y0: float = 0.0
    y1: float = 1.0
    dtype: str = "double"

    def __post_init__(self):
        if self.nx < 3 or self.ny < 3:
            raise ValueError("a grid needs at least 3 points a side")
        if not (self.x1 > self.x0 and self.y1 > self.y0):
            raise ValueError("an empty domain")
        if self.dtype not in ("float", "double"):
            raise ValueError(f"no such field type: {self.dtype}")

    @property
    def hx(self) -> float:
        return (self.x1 - self.x0) / (self.nx - 1)

    @property
    def hy(self) -> float:
        return (self.y1 - self.y0) / (self.ny - 1)

    @property
    def h(self) -> float:
        return min(self.hx, self.hy)

    @property
    def cx(self) -> float:
        return 1.0 / (self.hx * self.hx)

    @property
    def cy(self) -> float:
        return 1.0 / (self.hy * self.hy)

    @property
    def diagonal(self) -> float:
        """Of minus the Laplacian."""
        return 2.0 * self.cx + 2.0 * self.cy

    def resized(self, nx: int, ny: int) -> Grid:
        return Grid(nx, ny, self.x0, self.x1, self.y0, self.y1, self.dtype)

    def can_coarsen(self) -> bool:
        return (self.nx - 1) % 2 == 0 and (self.ny - 1) % 2 == 0 and self.nx >= 5 and self.ny >= 5

    def coarsen(self) -> Grid:
        if not self.can_coarsen():
            raise ValueError(f"{self.nx} x {self.ny} cannot be halved")
        return self.resized((self.nx - 1) // 2 + 1, (self.ny - 1) // 2 + 1)

    def refine(self) -> Grid:
        return self.resized(2 * (self.nx - 1) + 1, 2 * (self.ny - 1) + 1)

    def clamped_coarsen(self) -> Grid:
        """Halved without a parity check, never below 5 points a side."""
        return self.resized(max(5, (self.nx - 1) // 2 + 1), max(5, (self.ny - 1) // 2 + 1))

    def hierarchy(self, max_levels: int = 20, smallest: int = 3) -> list[Grid]:
        """Level 0 is this grid; each next one is half as fine."""
        out = [self]
        while len(out) < max_levels and out[-1].can_coarsen() and min(out[-1].coarsen().nx, out[-1].coarsen().ny) >= smallest:
            out.append(out[-1].coarsen())
        return out

    def memory_bytes(self, levels: int = 20, copies: int = 4) -> int:
        """Of ``copies`` fields on every level."""
        size = 8 if self.dtype == "double" else 4
        return sum(g.nx * g.ny * size * copies for g in self.hierarchy(levels))

    def x(self, i: Column | str = "i") -> Column:
        return F.lit(self.x0) + F.col(i) * F.lit(self.hx) if isinstance(i, str) else F.lit(self.x0) + i * F.lit(self.hx)

    def y(self, j: Column | str = "j") -> Column:
        return F.lit(self.y0) + F.col(j) * F.lit(self.hy) if isinstance(j, str) else F.lit(self.y0) + j * F.lit(self.hy)

    def inside(self) -> Column:
        i, j = F.col("i"), F.col("j")
        return (i >= 1) & (i <= self.nx - 2) & (j >= 1) & (j <= self.ny - 2)

    def side(self, name: str) -> Column:
        found = {"left": F.col("i") == 0, "right": F.col("i") == self.nx - 1, "bottom": F.col("j") == 0, "top": F.col("j") == self.ny - 1}
        if name not in found:
            raise ValueError(f"no such side: {name}")
        return found[name]

    def points(self, spark: SparkSession) -> DataFrame:
        """(i, j, x, y) of every point; coordinates are computed, never stored."""
        ids = spark.range(self.nx * self.ny).select(F.expr(f"cast(id div {self.ny} as int)").alias("i"), (F.col("id") % self.ny).cast("int").alias("j"))
        return ids.withColumn("x", self.x()).withColumn("y", self.y())

    def evaluate(self, spark: SparkSession, **columns) -> DataFrame:
        """(i, j, name, …): each name a function (x, y) -> Column, evaluated in the JVM."""
        x, y = F.col("x"), F.col("y")
        return self.points(spark).select("i", "j", *[f(x, y).cast(self.dtype).alias(n) for n, f in columns.items()])


def hierarchy_frame(spark: SparkSession, grid: Grid, max_levels: int = 20) -> DataFrame:
    """One row of metadata for each level."""
    rows = [(level, g.nx, g.ny, g.hx, g.hy) for level, g in enumerate(grid.hierarchy(max_levels))]
    return spark.createDataFrame(rows, "level int, nx int, ny int, hx double, hy double")


def many_points(grids: DataFrame, x0: float = 0.0, x1: float = 1.0, y0: float = 0.0, y1: float = 1.0) -> DataFrame:
    """(nx, ny, i, j, x, y): the points of every grid (nx, ny) of a frame, over one domain."""
    i = grids.select("nx", "ny", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"))
    both = i.select("nx", "ny", "i", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"))
    at = lambda a, b, k, n: F.lit(a) + F.col(k) * (F.lit(b - a) / (F.col(n) - 1))
    return both.withColumn("x", at(x0, x1, "i", "nx")).withColumn("y", at(y0, y1, "j", "ny"))


def many_levels(grids: DataFrame, most: int = 20, smallest: int = 3) -> DataFrame:
    """(nx, ny, level, level_nx, level_ny): the hierarchy of every grid, halved as long as both sides can be."""
    levels = grids.select("nx", "ny", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("level"))
    step = F.expr("shiftleft(1, level)")
    size = lambda n: F.expr(f"({n} - 1) div shiftleft(1, level) + 1").cast("int")
    whole = ((F.col("nx") - 1) % step == 0) & ((F.col("ny") - 1) % step == 0) & (F.least(size("nx"), size("ny")) >= smallest)
    return levels.where((F.col("level") == 0) | whole).select("nx", "ny", "level", size("nx").alias("level_nx"), size("ny").alias("level_ny"))


def many_rules(grids: DataFrame) -> DataFrame:
    """Whether each grid can be halved, its refined and clamped sizes, Jacobi's spectral radius and the over-relaxation weight on the unit square."""
    nx, ny = F.col("nx"), F.col("ny")
    clamped = lambda n: F.greatest(F.lit(5), F.expr(f"({n} - 1) div 2 + 1").cast("int"))
    h = 1.0 / (F.greatest(nx, ny) - 1)
    return grids.select(
        "nx", "ny", ((nx % 2 == 1) & (ny % 2 == 1) & (F.least(nx, ny) >= 5)).alias("can_coarsen"), (2 * nx - 1).alias("refined_nx"), (2 * ny - 1).alias("refined_ny"), clamped("nx").alias("clamped_nx"), clamped("ny").alias("clamped_ny"),
        (F.cos(F.pi() / (nx - 1)) * F.cos(F.pi() / (ny - 1))).alias("radius"), (2.0 / (1 + F.sin(F.pi() * h))).alias("omega"),
    )
