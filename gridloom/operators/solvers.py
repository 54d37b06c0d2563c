"""Iterative solvers: distributed cycles on one large grid, and whole solves of many small ones.

On a large grid the driver decides and executors compute: each level is a frame, lineage is
cut with a checkpoint each cycle, and only norms come back. Many small problems are keyed by run
and solved one run to a group, so the cluster works on as many as it has cores.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..grid import Grid
from ..shared import checkpoint
from . import smoothers, stencil

HISTORY = "run_id string, iteration int, residual_norm double, iteration_time double, precision_level string, grid_level int"
#: Grids of up to so many points are solved within one group.
GROUP_POINTS = 129 * 129
#: From this iteration on, five ratios that average so much end single precision.
SWITCH_FROM, SWITCH_RATE = 10, 0.95
#: Couplings below this factor are dropped by pcg_ilu_drop.
ILU_DROP = 0.27


@dataclass
class Solution:
    field: DataFrame
    history: list[tuple] = field(default_factory=list)
    converged: bool = False

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY)


def iterate(start: DataFrame, grid: Grid, step: Callable[[DataFrame], DataFrame], tolerance: float = 1e-6, most: int = 100, every: int = 1, run_id: str = "run", shift: float = 0.0) -> Solution:
    """Apply step until the scaled residual norm is below tolerance; norms are taken every few steps."""
    out = Solution(start)
    for n in range(1, most + 1):
        began = time.perf_counter()
        out.field = step(out.field)
        if n % every and n < most:
            continue
        out.field = checkpoint(out.field)
        norm = stencil.norms(stencil.residual(out.field, grid, shift=shift), grid, "r").first()["l2"]
        out.history.append((run_id, n, norm, time.perf_counter() - began, "double", 0))
        if norm < tolerance:
            out.converged = True
            break
    return out


def _coarse_group(frame: DataFrame, grid: Grid, shift: float) -> DataFrame:
    """Solve a small grid within one group; it has at most GROUP_POINTS rows."""

    def run(pdf):
        import numpy as np

        u, f = np.zeros((grid.nx, grid.ny)), np.zeros((grid.nx, grid.ny))
        u[pdf["i"], pdf["j"]], f[pdf["i"], pdf["j"]] = pdf["u"], pdf["f"]
        levels = grid.hierarchy()
        for _ in range(60):
            u = kernels.cycle(u, f, levels, shift=shift)
            if kernels.norm(kernels.residual(u, f, grid, shift), grid) < 1e-12:
                break
        return pdf.assign(u=u[pdf["i"], pdf["j"]])

    return frame.select("i", "j", "u", "f").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: run(pdf)[["i", "j", "u", "f"]], "i int, j int, u double, f double")


def cycle(frame: DataFrame, levels: list[Grid], kind: str = "V", before: int = 2, after: int = 2, level: int = 0, shift: float = 0.0, smooth=smoothers.tiled_red_black, group_points: int | None = None) -> DataFrame:
    """One multigrid cycle over frames (i, j, u, f); V, W, F or FV as in kernels.calls.

    Levels of at most ``group_points`` points are solved within one group; 0 keeps all but the coarsest distributed.
    """
    grid = levels[level]
    if level == len(levels) - 1 or grid.nx * grid.ny <= (GROUP_POINTS if group_points is None else group_points):
        return _coarse_group(frame, grid, shift)
    frame = checkpoint(smooth(frame, grid, before, shift=shift))
    down = stencil.restrict_full(stencil.residual(frame, grid, shift=shift), grid, "r", zero_edge=True)
    error = down.select("i", "j", F.lit(0.0).alias("u"), F.col("r").alias("f"))
    for k in kernels.calls(kind, len(levels) - level):
        error = cycle(error, levels, k, before, after, level + 1, shift, smooth, group_points)
    up = stencil.prolong_bilinear(error, grid)
    frame = stencil.combine(frame, up, lambda a, b: a + b)
    return checkpoint(smooth(frame, grid, after, shift=shift))


def solve(start: DataFrame, grid: Grid, kind: str = "V", tolerance: float = 1e-6, most: int = 30, shift: float = 0.0, **kw) -> Solution:
    """Multigrid on one grid of any size; start holds u (with its boundary values) and f."""
    levels = grid.hierarchy()
    return iterate(start, grid, lambda df: cycle(df, levels, kind, shift=shift, **kw), tolerance, most, shift=shift)


def subdomain_step(frame: DataFrame, grid: Grid, tile: int = 512, overlap: int = 8) -> DataFrame:
    """Every tile, widened by ``overlap`` points, solved with the values around it held; it keeps its own points.

    One exchange; a widened tile, not the grid, must fit into a task.
    """

    def run(key, pdf):
        import numpy as np

        ti, tj = int(key[0]), int(key[1])
        i0, j0 = int(pdf["i"].min()), int(pdf["j"].min())
        shape = int(pdf["i"].max()) - i0 + 1, int(pdf["j"].max()) - j0 + 1
        at = pdf["i"].to_numpy() - i0, pdf["j"].to_numpy() - j0
        u, f = np.zeros(shape), np.zeros(shape)
        u[at], f[at] = pdf["u"], pdf["f"]
        part = Grid(*shape, 0.0, grid.hx * (shape[0] - 1), 0.0, grid.hy * (shape[1] - 1))
        u, _ = kernels.conjugate_gradients(u, f, part, None, 1e-11, 20 * sum(shape))
        own = pdf[(pdf["i"] // tile == ti) & (pdf["j"] // tile == tj)][["i", "j"]].copy()
        own["u"], own["f"] = u[own["i"] - i0, own["j"] - j0], f[own["i"] - i0, own["j"] - j0]
        return own

    copies = smoothers.to_tiles(frame.select("i", "j", "u", "f"), grid, tile, overlap)
    return copies.groupBy("ti", "tj").applyInPandas(run, "i int, j int, u double, f double")


def coarse_correction(frame: DataFrame, grid: Grid, tile: int) -> DataFrame:
    """The field corrected on the tiles' corners: the residual summed there by bilinear weights, solved, and spread back.

    The corners are a grid of their own, solved within one group if it is small and by multigrid if it is not.
    """
    if (grid.nx - 1) % tile or (grid.ny - 1) % tile or min(grid.nx, grid.ny) <= 2 * tile:
        raise ValueError("a coarse level needs tiles that divide the grid, two a side at least")
    corners = grid.resized((grid.nx - 1) // tile + 1, (grid.ny - 1) // tile + 1)
    cell = lambda c: F.floor(F.col(c) / tile).cast("int")
    part = lambda c: F.col(c) % tile / F.lit(float(tile))
    frame = stencil.residual(frame.select("i", "j", "u", "f"), grid)
    sent = F.array(*[F.struct((cell("i") + a).alias("i"), (cell("j") + b).alias("j"), (F.col("r") * (part("i") if a else 1 - part("i")) * (part("j") if b else 1 - part("j"))).alias("f")) for a in (0, 1) for b in (0, 1)])
    sums = frame.select(F.explode(sent).alias("p")).select("p.*").where((F.col("i") < corners.nx) & (F.col("j") < corners.ny)).groupBy("i", "j").agg(F.sum("f").alias("f"))
    start = sums.select("i", "j", F.lit(0.0).alias("u"), (F.col("f") * F.lit(grid.hx * grid.hy / (corners.hx * corners.hy))).alias("f"))
    error = _coarse_group(start, corners, 0.0) if corners.nx * corners.ny <= GROUP_POINTS else solve(checkpoint(start), corners, tolerance=1e-10).field
    cells = stencil.gather(error.select("i", "j", "u"), "u", {"e": (1, 0), "n": (0, 1), "ne": (1, 1)}).select(F.col("i").alias("__ti"), F.col("j").alias("__tj"), *[F.col(c).alias(f"__{c}") for c in ("u", "u_e", "u_n", "u_ne")])
    x, y = part("i"), part("j")
    spread = (1 - y) * ((1 - x) * F.col("__u") + x * F.col("__u_e")) + y * ((1 - x) * F.col("__u_n") + x * F.col("__u_ne"))
    both = frame.withColumn("__ti", cell("i")).withColumn("__tj", cell("j")).join(cells, ["__ti", "__tj"])
    return both.select("i", "j", F.when(grid.inside(), F.col("u") + spread).otherwise(F.col("u")).alias("u"), "f")


def solve_subdomains(start: DataFrame, grid: Grid, tile: int = 512, overlap: int = 8, tolerance: float = 1e-6, most: int = 100, coarse: bool = False) -> Solution:
    """Overlapping subdomains, solved side by side and exchanged until the residual of the whole grid is small.

    Alone, the number of exchanges grows with the number of tiles. With ``coarse``, every exchange is followed
    by a correction on the tiles' corners, and it stays nearly level.
    """
    if overlap < 2:
        raise ValueError("subdomains need an overlap of at least 2")

    def step(df: DataFrame) -> DataFrame:
        df = subdomain_step(df, grid, tile, overlap)
        return coarse_correction(checkpoint(df), grid, tile) if coarse else df

    return iterate(start, grid, step, tolerance, most)


def two_grid(frame: DataFrame, grid: Grid, sweeps: int = 2, omega: float = 0.8) -> DataFrame:
    """Residual, restriction, Jacobi sweeps on the coarse grid, prolongation, correction; no solve below."""
    coarse = grid.coarsen()
    down = stencil.restrict_full(stencil.residual(frame, grid), grid, "r", zero_edge=True)
    error = smoothers.jacobi(down.select("i", "j", F.lit(0.0).alias("u"), F.col("r").alias("f")), coarse, sweeps, omega)
    return stencil.combine(frame, stencil.prolong_bilinear(error, grid), lambda a, b: a + b)


METHODS = ("V", "W", "F", "FV", "fmg", "jacobi", "weighted_jacobi", "gauss_seidel", "red_black", "symmetric", "sor", "cg", "pcg_diagonal", "pcg_lines", "pcg_ilu", "pcg_ilu_drop", "pcg_multigrid", "adaptive")


def solve_array(u, f, grid: Grid, method: str, tolerance: float, most: int, shift: float = 0.0):
    """(solution, rows (iteration, norm, precision)) of one run by any method."""
    import numpy as np

    levels = grid.hierarchy()
    rows: list[tuple[int, float, str]] = []
    if method.startswith(("cg", "pcg")):
        name = method.partition("_")[2]
        drop = ILU_DROP if name == "ilu_drop" else 0.0
        pivot = kernels.ilu0(grid, shift, drop=drop) if name.startswith("ilu") else None
        one_cycle = lambda r: kernels.cycle(np.zeros_like(r), r, levels, smoother="jacobi", shift=shift)
        maps = {"": None, "diagonal": lambda r: r / (grid.diagonal + shift), "lines": lambda r: kernels.lines(r, grid, shift=shift), "ilu": lambda r: kernels.ilu_apply(r, grid, pivot), "ilu_drop": lambda r: kernels.ilu_apply(r, grid, pivot, drop), "multigrid": one_cycle}
        u, norms = kernels.conjugate_gradients(u, f, grid, maps[name], tolerance, most, shift)
        return u, [(n, v, "double") for n, v in enumerate(norms[1:], 1)]
    precision = "float" if method == "adaptive" else "double"
    if method == "fmg":
        u = kernels.full_multigrid(f, levels, u)
    for n in range(1, most + 1):
        if method in ("V", "W", "F", "FV", "fmg", "adaptive"):
            u = kernels.cycle(u.astype(np.float32 if precision == "float" else np.float64), f, levels, method if method in ("V", "W", "F", "FV") else "V", shift=shift, precision=(lambda _: np.float32) if precision == "float" else None)
        else:
            u = kernels.SMOOTHERS[method](u, f, grid, shift=shift)
        rows.append((n, kernels.norm(kernels.residual(u.astype(np.float64), f, grid, shift), grid), precision))
        if rows[-1][1] < tolerance:
            break
        if precision == "float" and n >= SWITCH_FROM and (ratios := [b[1] / a[1] for a, b in zip(rows[-6:-1], rows[-5:]) if a[1] > 0]) and len(ratios) == 5 and sum(ratios) / 5 >= SWITCH_RATE:
            precision = "double"  # single precision gives no more
    return u.astype(np.float64), rows


def solve_runs(runs: DataFrame, grid: Grid, method: str = "V", tolerance: float = 1e-8, most: int = 100, shift: float = 0.0, want: str = "history") -> DataFrame:
    """Solve every run of a frame (run_id, i, j, u, f), one group each; its history or its field."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    if grid.nx * grid.ny > GROUP_POINTS * 16:
        raise ValueError("too large for one group; use solve()")

    def run(pdf):
        import numpy as np
        import pandas as pd

        u, f = np.zeros((grid.nx, grid.ny)), np.zeros((grid.nx, grid.ny))
        u[pdf["i"], pdf["j"]], f[pdf["i"], pdf["j"]] = pdf["u"], pdf["f"]
        u, rows = solve_array(u, f, grid, method, tolerance, most, shift)
        if want == "field":
            return pdf.assign(u=u[pdf["i"], pdf["j"]])[["run_id", "i", "j", "u"]]
        return pd.DataFrame([(pdf["run_id"].iloc[0], n, v, None, p, 0) for n, v, p in rows], columns=["run_id", "iteration", "residual_norm", "iteration_time", "precision_level", "grid_level"])

    schema = HISTORY if want == "history" else "run_id string, i int, j int, u double"
    return runs.select("run_id", "i", "j", "u", "f").groupBy("run_id").applyInPandas(run, schema)
