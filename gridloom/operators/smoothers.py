"""Smoothers as column expressions, and halo tiles for many sweeps an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..grid import Grid
from .stencil import FIVE, _cross, gather


def relax(field: DataFrame, grid: Grid, omega: float = 2.0 / 3.0, value: str = "u", rhs: str = "f", shift: float = 0.0, colour: int | None = None) -> DataFrame:
    """One weighted Jacobi step of -Laplacian + shift, on all inner points or on those of one colour."""
    near = gather(field, value, FIVE)
    new = F.lit(1.0 - omega) * F.col(value) + F.lit(omega) * (F.col(rhs) + _cross(grid, value)) / F.lit(grid.diagonal + shift)
    at = grid.inside() if colour is None else grid.inside() & ((F.col("i") + F.col("j")) % 2 == colour)
    return near.withColumn(value, F.when(at, new).otherwise(F.col(value))).drop(*[f"{value}_{n}" for n in FIVE])


def jacobi(field: DataFrame, grid: Grid, sweeps: int = 1, omega: float = 2.0 / 3.0, **kw) -> DataFrame:
    for _ in range(sweeps):
        field = relax(field, grid, omega, **kw)
    return field


def red_black(field: DataFrame, grid: Grid, sweeps: int = 1, omega: float = 1.0, **kw) -> DataFrame:
    """Gauss-Seidel on the even colour, then the odd; omega above 1 over-relaxes."""
    for _ in range(sweeps):
        for colour in (0, 1):
            field = relax(field, grid, omega, colour=colour, **kw)
    return field


def sor(field: DataFrame, grid: Grid, sweeps: int = 1, omega: float | None = None, **kw) -> DataFrame:
    return red_black(field, grid, sweeps, omega or float(kernels.optimal_sor(grid)), **kw)


def to_tiles(field: DataFrame, grid: Grid, tile: int, rim: int) -> DataFrame:
    """The points with (ti, tj) of every tile that holds them or has them within its rim."""
    if rim > tile:
        raise ValueError("a rim wider than a tile")
    low = lambda c: F.greatest(F.floor((F.col(c) - rim) / tile), F.lit(0))
    high = lambda c, n: F.least(F.floor((F.col(c) + rim) / tile), F.lit((n - 1) // tile))
    copies = field.withColumn("ti", F.explode(F.sequence(low("i"), high("i", grid.nx))))
    return copies.withColumn("tj", F.explode(F.sequence(low("j"), high("j", grid.ny))))


def tiled(field: DataFrame, grid: Grid, sweeps: int, tile: int = 512, omega: float = 0.8, value: str = "u", rhs: str = "f", shift: float = 0.0, kind: str = "jacobi", residual: str | None = None) -> DataFrame:
    """``sweeps`` Jacobi or red-black steps in one exchange, equal to as many separate steps.

    A tile gets a rim as wide as the values that reach into it: one ring for each Jacobi step, two for
    each red-black one, and one more for the residual, which ``residual`` names as a column to add
    (zero on the edge). Rim values go stale from outside in and are dropped. A tile with its rim, not
    the grid, must fit into a task.
    """
    rim = sweeps * {"jacobi": 1, "red_black": 2}[kind] + (residual is not None)
    copies = to_tiles(field.select("i", "j", value, rhs), grid, tile, rim)

    def run(key, pdf):
        import numpy as np

        ti, tj = int(key[0]), int(key[1])
        i0, j0 = int(pdf["i"].min()), int(pdf["j"].min())
        shape = int(pdf["i"].max()) - i0 + 1, int(pdf["j"].max()) - j0 + 1
        at = pdf["i"].to_numpy() - i0, pdf["j"].to_numpy() - j0
        u, f = np.zeros(shape), np.zeros(shape)
        u[at], f[at] = pdf[value], pdf[rhs]
        i, j = np.indices(shape)
        i, j = i + i0, j + j0
        inner = (i > 0) & (i < grid.nx - 1) & (j > 0) & (j < grid.ny - 1)

        def near():
            wide = np.pad(u, 1)
            return (wide[2:, 1:-1] + wide[:-2, 1:-1]) * grid.cx + (wide[1:-1, 2:] + wide[1:-1, :-2]) * grid.cy

        for _ in range(sweeps):
            for moved in [inner] if kind == "jacobi" else [inner & ((i + j) % 2 == colour) for colour in (0, 1)]:
                u = np.where(moved, (1 - omega) * u + omega * (f + near()) / (grid.diagonal + shift), u)
        own = pdf[(pdf["i"] // tile == ti) & (pdf["j"] // tile == tj)][["i", "j"]].copy()
        own[value], own[rhs] = u[own["i"] - i0, own["j"] - j0], f[own["i"] - i0, own["j"] - j0]
        if residual:
            r = np.where(inner, f + near() - u * (grid.diagonal + shift), 0.0)
            own[residual] = r[own["i"] - i0, own["j"] - j0]
        return own

    more = f", {residual} double" if residual else ""
    return copies.groupBy("ti", "tj").applyInPandas(run, f"i int, j int, {value} double, {rhs} double{more}")


def tiled_red_black(field: DataFrame, grid: Grid, sweeps: int = 1, shift: float = 0.0) -> DataFrame:
    """red_black with one exchange for all its sweeps."""
    return tiled(field.select("i", "j", "u", "f"), grid, sweeps, omega=1.0, shift=shift, kind="red_black")
