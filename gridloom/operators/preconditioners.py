"""Preconditioners as transforms of a residual column, and policies that choose among them."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..grid import Grid
from . import solvers


class Preconditioner(Protocol):
    def apply(self, frame: DataFrame) -> DataFrame:
        """The frame with z computed from r."""


class Identity:
    def apply(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("z", F.col("r"))


class Diagonal:
    """r over the diagonal inside, r itself on the boundary.

    With ``scale``, and only where the spacings differ by more than a tenth, times scale sqrt(aspect).
    """

    def __init__(self, grid: Grid, scale: float | None = None):
        self.grid = grid
        aspect = grid.hx / grid.hy
        self.factor = 1.0 if scale is None or abs(aspect - 1) <= 0.1 else scale * max(aspect, 1 / aspect) ** 0.5

    def apply(self, frame: DataFrame) -> DataFrame:
        inner = F.lit(self.factor) * F.col("r") / F.lit(self.grid.diagonal)
        return frame.withColumn("z", F.when(self.grid.inside(), inner).otherwise(F.col("r")))


class Lines:
    """Tridiagonal solves along x (or y): a group for each line, so lines spread over the cluster."""

    def __init__(self, grid: Grid, axis: str = "x"):
        self.grid, self.axis = grid, axis

    def apply(self, frame: DataFrame) -> DataFrame:
        g, along, across = self.grid, *(("i", "j") if self.axis == "x" else ("j", "i"))
        n, off = (g.nx, g.cx) if self.axis == "x" else (g.ny, g.cy)
        last = (g.ny if self.axis == "x" else g.nx) - 1

        def run(pdf):
            import numpy as np

            pdf = pdf.sort_values(along)
            r = pdf["r"].to_numpy()
            z = r.copy()
            if 0 < pdf[across].iloc[0] < last:
                c, d = np.zeros(n - 2), np.zeros(n - 2)
                for k in range(n - 2):
                    below = g.diagonal - (off * c[k - 1] if k else 0)
                    c[k], d[k] = off / below, (r[k + 1] + (off * d[k - 1] if k else 0)) / below
                for k in range(n - 3, -1, -1):
                    z[k + 1] = d[k] + (c[k] * z[k + 2] if k < n - 3 else 0)
            return pdf.assign(z=z)[["i", "j", "r", "z"]]

        return frame.select("i", "j", "r").groupBy(across).applyInPandas(run, "i int, j int, r double, z double")


class Grouped:
    """Sequential kernels, ILU(0) and multigrid cycles, on a grid small enough for one group."""

    def __init__(self, grid: Grid, kind: str = "ilu", cycles: int = 1, modified: float = 0.0, kind_of_cycle: str = "V", steps: int = 2):
        if grid.nx * grid.ny > solvers.GROUP_POINTS:
            raise ValueError("too large for one group")
        self.grid, self.kind, self.cycles, self.modified, self.kind_of_cycle, self.steps = grid, kind, cycles, modified, kind_of_cycle, steps

    def apply(self, frame: DataFrame) -> DataFrame:
        g, kind, cycles, modified, kind_of_cycle, steps = self.grid, self.kind, self.cycles, self.modified, self.kind_of_cycle, self.steps

        def run(pdf):
            import numpy as np

            r = np.zeros((g.nx, g.ny))
            r[pdf["i"], pdf["j"]] = pdf["r"]
            if kind == "ilu":
                z = kernels.ilu_apply(r, g, kernels.ilu0(g, modified=modified))
            else:
                levels = g.hierarchy(2 if kind == "two_level" else 20)
                z = np.zeros_like(r)
                for _ in range(cycles):
                    z = kernels.cycle(z, r, levels, kind_of_cycle, steps, steps)
            return pdf.assign(z=z[pdf["i"], pdf["j"]])[["i", "j", "r", "z"]]

        return frame.select("i", "j", "r").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "i int, j int, r double, z double")


class Composite:
    """One after another; ``transpose`` in reverse order."""

    def __init__(self, *parts: Preconditioner):
        self.parts = parts

    def _chain(self, frame: DataFrame, parts) -> DataFrame:
        first = frame.withColumn("z", F.col("r"))
        for p in parts:
            first = p.apply(first.select("i", "j", F.col("z").alias("r")))
        return frame.select("i", "j", "r").join(first.select("i", "j", "z"), ["i", "j"])

    def apply(self, frame: DataFrame) -> DataFrame:
        return self._chain(frame, self.parts)

    def transpose(self, frame: DataFrame) -> DataFrame:
        return self._chain(frame, self.parts[::-1])


class Adaptive:
    """Moves to the next part when the last window of norms fell by less than a tenth."""

    def __init__(self, *parts: Preconditioner, window: int = 5, limit: float = 0.9):
        self.parts, self.window, self.limit, self.at, self.norms = parts, window, limit, 0, []

    def observe(self, norm: float) -> None:
        self.norms.append(norm)
        last = self.norms[-self.window :]
        if len(last) == self.window and last[0] > 0 and last[-1] / last[0] > self.limit:
            self.at, self.norms = (self.at + 1) % len(self.parts), []

    def apply(self, frame: DataFrame) -> DataFrame:
        return self.parts[self.at].apply(frame)


class Flexible:
    """One multigrid cycle, whose kind and smoothing steps follow how the last applications went.

    The mean of the last three reductions |z| / |r| decides: above 0.8 a smoothing step more on either side,
    up to ``most_steps``; below 0.3, if their mean time exceeds ``slow`` seconds, one less, down to one. From
    six applications on, above 0.7 the next kind of V, W, F, and below 0.2 the one before.
    """

    KINDS = ("V", "W", "F")

    def __init__(self, grid: Grid, kind: str = "V", steps: int = 2, most_steps: int = 3, slow: float = 0.1):
        self.grid, self.kind, self.steps, self.most_steps, self.slow = grid, kind, steps, most_steps, slow
        self.seen: list[tuple[float, float]] = []

    def observe(self, reduction: float, seconds: float) -> None:
        self.seen.append((reduction, seconds))
        if len(self.seen) < 3:
            return
        mean, spent = (sum(x) / 3 for x in zip(*self.seen[-3:], strict=True))
        if mean > 0.8:
            self.steps = min(self.steps + 1, self.most_steps)
        elif mean < 0.3 and spent > self.slow:
            self.steps = max(self.steps - 1, 1)
        if len(self.seen) >= 6 and (step := (mean > 0.7) - (mean < 0.2)):
            self.kind = self.KINDS[min(max(self.KINDS.index(self.kind) + step, 0), 2)]

    def apply(self, frame: DataFrame) -> DataFrame:
        began = time.perf_counter()
        if self.grid.nx * self.grid.ny <= solvers.GROUP_POINTS:
            z = Grouped(self.grid, "multigrid", kind_of_cycle=self.kind, steps=self.steps).apply(frame)
        else:
            start = frame.select("i", "j", F.lit(0.0).alias("u"), F.col("r").alias("f"))
            done = solvers.cycle(start, self.grid.hierarchy(), self.kind, self.steps, self.steps)
            z = done.select("i", "j", F.col("f").alias("r"), F.col("u").alias("z"))
        z = solvers.checkpoint(z)
        after, before = z.agg(F.sqrt(F.sum(F.col("z") * F.col("z"))), F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
        self.observe(after / max(before, 1e-16), time.perf_counter() - began)
        return z


def conjugate_gradients(frame: DataFrame, grid: Grid, preconditioner: Preconditioner | None = None, tolerance: float = 1e-8, most: int = 200) -> solvers.Solution:
    """CG on frames (i, j, u, f) of any size: a stencil, a few products and a checkpoint a step."""
    from .stencil import residual

    to: Callable = (preconditioner or Identity()).apply
    inner = lambda df: df.withColumn("z", F.when(grid.inside(), F.col("z")).otherwise(0.0))
    state = residual(frame, grid).select("i", "j", "u", "f", "r")
    z = inner(to(state.select("i", "j", "r"))).select("i", "j", "z")
    state = solvers.checkpoint(state.join(z, ["i", "j"]).withColumn("p", F.col("z")))
    out = solvers.Solution(frame)
    rz = state.agg(F.sum(F.col("r") * F.col("z"))).first()[0]
    for n in range(1, most + 1):
        if not rz:
            break
        q = residual(state.withColumn("__zero", F.lit(0.0)), grid, "p", "__zero", "q").withColumn("q", -F.col("q"))
        q = solvers.checkpoint(q.drop("__zero"))
        step = rz / q.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = q.select("i", "j", (F.col("u") + step * F.col("p")).alias("u"), "f", (F.col("r") - step * F.col("q")).alias("r"), "p")
        z = inner(to(moved.select("i", "j", "r"))).select("i", "j", "z")
        moved = solvers.checkpoint(moved.join(z, ["i", "j"]))
        new, square = moved.agg(F.sum(F.col("r") * F.col("z")), F.sum(F.col("r") * F.col("r"))).first()
        state = moved.withColumn("p", F.col("z") + F.lit(new / rz) * F.col("p"))
        rz, norm = new, (grid.hx * grid.hy * square) ** 0.5
        out.field, out.history = state.select("i", "j", "u", "f"), [*out.history, ("cg", n, norm, None, "double", 0)]
        if norm < tolerance:
            out.converged = True
            break
    return out
