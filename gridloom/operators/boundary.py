"""Boundary selection and conditions on frames (i, j, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..grid import SIDES, Grid
from .stencil import FIVE, gather

#: The neighbour just inside each side, and the spacing across it.
_INWARD = {"left": ("e", "hx"), "right": ("w", "hx"), "bottom": ("n", "hy"), "top": ("s", "hy")}


def interior(field: DataFrame, grid: Grid) -> DataFrame:
    return field.where(grid.inside())


def boundary(field: DataFrame, grid: Grid, side: str = "all") -> DataFrame:
    return field.where(~grid.inside() if side == "all" else grid.side(side))


def dirichlet(field: DataFrame, grid: Grid, g, side: str = "all", value: str = "u") -> DataFrame:
    """Set the value to g, a number, a Column or a function (x, y); of meeting sides the later wins."""
    out = F.col(value)
    for one in SIDES if side == "all" else (side,):
        given = g(grid.x(), grid.y()) if callable(g) else g if isinstance(g, Column) else F.lit(g)
        out = F.when(grid.side(one), given).otherwise(out)
    return field.withColumn(value, out)


def zero(field: DataFrame, grid: Grid, value: str = "u") -> DataFrame:
    return dirichlet(field, grid, 0.0, "all", value)


def _from_inside(field: DataFrame, grid: Grid, side: str, value: str, rule) -> DataFrame:
    """Set the value on a side, or on all sides in turn, by rule(inner value, spacing, side)."""
    near = gather(field, value, FIVE)
    out = F.col(value)
    for one in SIDES if side == "all" else (side,):
        name, across = _INWARD[one]
        out = F.when(grid.side(one), rule(F.col(f"{value}_{name}"), F.lit(getattr(grid, across)), one)).otherwise(out)
    return near.withColumn(value, out).drop(*[f"{value}_{n}" for n in FIVE])


def neumann(field: DataFrame, grid: Grid, g: float, side: str = "all", value: str = "u") -> DataFrame:
    """Outward normal derivative g: the value just inside plus spacing times g."""
    return _from_inside(field, grid, side, value, lambda v, h, _: v + h * F.lit(g))


def neumann_axis(field: DataFrame, grid: Grid, d: float, side: str = "all", value: str = "u") -> DataFrame:
    """Derivative along the axis: minus on left and bottom, plus on right and top."""
    return _from_inside(field, grid, side, value, lambda v, h, s: v - h * F.lit(d) if s in ("left", "bottom") else v + h * F.lit(d))


def robin(field: DataFrame, grid: Grid, alpha: float, beta: float, g: float, side: str = "all", value: str = "u") -> DataFrame:
    """alpha u + beta du/dn = g."""
    return _from_inside(field, grid, side, value, lambda v, h, _: (F.lit(g) + F.lit(beta) * v / h) / (F.lit(alpha) + F.lit(beta) / h))


def periodic(field: DataFrame, grid: Grid, axis: str = "both", value: str = "u") -> DataFrame:
    """Each side takes the value just inside the opposite one; x before y. An equi-join on the wrapped index."""
    if axis not in ("x", "y", "both"):
        raise ValueError(f"no such axis: {axis}")
    out = field
    for name, n in (("i", grid.nx), ("j", grid.ny)):
        if axis not in ("both", "x" if name == "i" else "y"):
            continue
        source = F.when(F.col(name) == 0, n - 2).when(F.col(name) == n - 1, 1).otherwise(F.col(name))
        other = "j" if name == "i" else "i"
        given = out.select(F.col(name).alias("__at"), F.col(other), F.col(value).alias("__v"))
        out = out.withColumn("__at", source.cast("int")).join(given, ["__at", other]).select(*[F.col("__v").alias(c) if c == value else F.col(c) for c in field.columns])
    return out


SEGMENTS = "side string, seg_no int, s0 double, s1 double, kind string, g double, alpha double, beta double"


def mixed(field: DataFrame, grid: Grid, segments: DataFrame, value: str = "u") -> DataFrame:
    """Boundary points meet the segments of their side by range; the first that holds them decides.

    Segments are a table of a few rows an analyst writes. A corner belongs to its later side.
    """
    side = F.when(grid.side("top"), "top").when(grid.side("bottom"), "bottom").when(grid.side("right"), "right").when(grid.side("left"), "left")
    along = F.when(side.isin("left", "right"), F.col("j") / F.lit(float(grid.ny - 1))).otherwise(F.col("i") / F.lit(float(grid.nx - 1)))
    near = gather(field, value, FIVE).withColumn("__side", side).withColumn("__s", along)
    edge = near.where("__side IS NOT NULL")
    met = edge.join(segments, (F.col("__side") == F.col("side")) & (F.col("s0") <= F.col("__s")) & (F.col("__s") <= F.col("s1")), "left")
    first = Window.partitionBy("i", "j").orderBy("seg_no")
    met = met.withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    inner = F.when(F.col("__side") == "left", F.col(f"{value}_e")).when(F.col("__side") == "right", F.col(f"{value}_w")).when(F.col("__side") == "bottom", F.col(f"{value}_n")).otherwise(F.col(f"{value}_s"))
    h = F.when(F.col("__side").isin("left", "right"), F.lit(grid.hx)).otherwise(F.lit(grid.hy))
    new = F.when(F.col("kind") == "dirichlet", F.col("g")).when(F.col("kind") == "neumann", inner + h * F.col("g")).when(F.col("kind") == "robin", (F.col("g") + F.col("beta") * inner / h) / (F.col("alpha") + F.col("beta") / h)).otherwise(F.col(value))
    keep = [c for c in field.columns if c != value]
    return near.where("__side IS NULL").select(*keep, value).unionByName(met.select(*keep, new.alias(value))).select(*field.columns)


def segment_gaps(segments: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(side, seg_no, problem): gaps and overlaps in the cover of [0, 1], by a running maximum."""
    before = Window.partitionBy("side").orderBy("s0", "seg_no").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("s1").over(before), F.lit(0.0))
    judged = segments.withColumn("problem", F.when(F.col("s0") > reached + tolerance, "gap").when(F.col("s0") < reached - tolerance, "overlap"))
    ends = segments.groupBy("side").agg(F.max("seg_no").alias("seg_no"), F.max("s1").alias("e")).where(F.col("e") < 1 - tolerance).select("side", "seg_no", F.lit("gap at end").alias("problem"))
    return judged.where("problem IS NOT NULL").select("side", "seg_no", "problem").unionByName(ends)


class BoundaryConditions:
    """One condition for each place, the last given wins; applied in the order first given."""

    def __init__(self, grid: Grid):
        self.grid, self.by_place = grid, {}

    def set(self, place: str, condition) -> BoundaryConditions:
        """condition: a function DataFrame -> DataFrame, such as ``lambda df: robin(df, …)``."""
        self.by_place[place] = condition
        return self

    def apply(self, field: DataFrame) -> DataFrame:
        for condition in self.by_place.values():
            field = field.transform(condition)
        return field


def homogeneous(grid: Grid, kind: str = "dirichlet") -> BoundaryConditions:
    """Zero values or zero fluxes on all sides."""
    one = {"dirichlet": lambda s: lambda df: dirichlet(df, grid, 0.0, s), "neumann": lambda s: lambda df: neumann(df, grid, 0.0, s)}[kind]
    out = BoundaryConditions(grid)
    for side in SIDES:
        out.set(side, one(side))
    return out


def radiation(grid: Grid, transfer: float, ambient: float) -> BoundaryConditions:
    """Robin on all sides: transfer u + du/dn = transfer ambient."""
    return BoundaryConditions(grid).set("all", lambda df: robin(df, grid, transfer, 1.0, transfer * ambient))


def from_config(grid: Grid, config: dict[str, dict], t: float = 0.0) -> BoundaryConditions:
    """Conditions written as settings, {side or "all": {"type": ..., ...}}, at time t.

    Types: dirichlet and neumann (``value``), robin (``alpha``, ``beta``, ``value``), periodic (``axis``). A
    ``value`` is a number or a function of t; ``amplitude`` and ``frequency`` in its place make it oscillate.
    """
    out = BoundaryConditions(grid)
    for side, given in config.items():
        if side not in (*SIDES, "all"):
            raise ValueError(f"no such side: {side}")
        value = oscillating(given["amplitude"], given["frequency"]) if "amplitude" in given else given.get("value", 0.0)
        value = value(t) if callable(value) else value
        kinds = {
            "dirichlet": lambda df, s=side, v=value: dirichlet(df, grid, v, s),
            "neumann": lambda df, s=side, v=value: neumann(df, grid, v, s),
            "robin": lambda df, s=side, v=value, c=given: robin(df, grid, c.get("alpha", 1.0), c.get("beta", 1.0), v, s),
            "periodic": lambda df, c=given: periodic(df, grid, c.get("axis", "both")),
        }
        if given["type"] not in kinds:
            raise ValueError(f"no such condition: {given['type']}")
        out.set(side, kinds[given["type"]])
    return out


def oscillating(amplitude: float, frequency: float):
    """t -> amplitude sin(2 pi frequency t), as a number for dirichlet()."""
    import math

    return lambda t: amplitude * math.sin(2 * math.pi * frequency * t)
