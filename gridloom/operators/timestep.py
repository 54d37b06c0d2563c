"""Time stepping of u_t = alpha Laplacian u + f on frames (i, j, u[, f])."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..grid import Grid
from . import boundary, solvers
from .stencil import laplacian

METHODS = {"forward_euler": 0.0, "backward_euler": 1.0, "crank_nicolson": 0.5, "bdf2": 1.0}  # theta; of BDF2, of its first step


def stable_step(grid: Grid, alpha: float, safety: float = 1.0) -> float:
    """Largest forward step: safety h^2 / (4 alpha)."""
    return safety * grid.h**2 / (4.0 * alpha)


def forward_euler(field: DataFrame, grid: Grid, alpha: float, dt: float, rhs: str | None = "f") -> DataFrame:
    """u + dt (alpha Laplacian u + f) inside; the boundary is held."""
    stepped = laplacian(field, grid, "u", "__lap", alpha)
    change = F.col("__lap") + F.col(rhs) if rhs else F.col("__lap")
    return stepped.withColumn("u", F.when(grid.inside(), F.col("u") + F.lit(dt) * change).otherwise(F.col("u"))).drop("__lap")


def theta_step(field: DataFrame, grid: Grid, alpha: float, dt: float, theta: float, tolerance: float = 1e-9, most: int = 30) -> DataFrame:
    """One implicit step: (-Laplacian + 1/(theta dt alpha)) u' = the explicit part, solved by multigrid.

    f is the source, held over the step.
    """
    if theta == 0:
        return forward_euler(field, grid, alpha, dt)
    shift = 1.0 / (theta * dt * alpha)
    known = laplacian(field, grid, "u", "__lap")
    right = F.col("u") * F.lit(shift) + F.lit((1.0 - theta) / theta) * F.col("__lap") + F.col("f") / F.lit(theta * alpha)
    start = solvers.checkpoint(known.select("i", "j", "u", right.alias("f")))
    done = solvers.solve(start, grid, "V", tolerance, most, shift).field.select("i", "j", F.col("u").alias("__new"))
    return field.join(done, ["i", "j"]).withColumn("u", F.col("__new")).drop("__new")


def bdf2_step(field: DataFrame, before: DataFrame, grid: Grid, alpha: float, dt: float, tolerance: float = 1e-9, most: int = 30) -> DataFrame:
    """(3 u' - 4 u + u_before) / (2 dt) = alpha Laplacian u' + f, for two steps of one length."""
    shift = 1.5 / (dt * alpha)
    both = field.join(before.select("i", "j", F.col("u").alias("__before")), ["i", "j"])
    right = (F.lit(2.0) * F.col("u") - F.lit(0.5) * F.col("__before")) / F.lit(dt * alpha) + F.col("f") / F.lit(alpha)
    start = solvers.checkpoint(both.select("i", "j", "u", right.alias("f")))
    done = solvers.solve(start, grid, "V", tolerance, most, shift).field.select("i", "j", F.col("u").alias("__new"))
    return field.join(done, ["i", "j"]).withColumn("u", F.col("__new")).drop("__new")


@dataclass
class Step:
    t: float
    dt: float
    field: DataFrame


def run(start: DataFrame, grid: Grid, alpha: float, dt: float, until: float, method: str = "crank_nicolson", source: Callable | None = None, edge: Callable | None = None, save_every: int = 1) -> list[Step]:
    """Steps to ``until``, the last one shortened to end there.

    source(x, y, t) and edge(x, y, t) are Column functions; states are saved every few steps.
    """
    theta, t, now, before, out, n = METHODS[method], 0.0, start, None, [Step(0.0, 0.0, start)], 0
    while t < until - 1e-12:
        step = min(dt, until - t)
        at = t + theta * step
        f = source(grid.x(), grid.y(), F.lit(at)) if source else F.lit(0.0)
        now = now.select("i", "j", "u", f.alias("f"))
        if edge:
            now = boundary.dirichlet(now, grid, lambda x, y, s=t + step: edge(x, y, F.lit(s)))
        if method == "bdf2" and before is not None and abs(step - dt) < 1e-12:
            made = bdf2_step(now, before, grid, alpha, step)
        else:  # the first step, and a shortened last one, have no pair of equal steps
            made = theta_step(now, grid, alpha, step, theta)
        before = now.select("i", "j", "u")
        now = solvers.checkpoint(made.select("i", "j", "u"))
        t, n = t + step, n + 1
        if n % save_every == 0 or t >= until - 1e-12:
            out.append(Step(t, step, now))
    return out


def states(steps: list[Step]) -> DataFrame:
    """(step, t, i, j, u): the saved states of a run in one frame."""
    frames = [s.field.select(F.lit(n).alias("step"), F.lit(s.t).alias("t"), "i", "j", "u") for n, s in enumerate(steps)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def march_runs(runs: DataFrame, grid: Grid, dt: float, steps: int, method: str | float = "backward_euler", tolerance: float = 1e-9, most: int = 30, want: str = "field") -> DataFrame:
    """(run_id, i, j, u) after ``steps`` implicit steps of every run (run_id, i, j, u, alpha, f, edge), one group each.

    f and edge are arrays with a value for each step: the source within it and the solution at its end.
    ``method`` is a name or a theta. With want="states", (run_id, step, i, j, u) of the start and every step.
    """
    theta = METHODS[method] if isinstance(method, str) else method
    if theta == 0:
        raise ValueError("march_runs takes implicit methods")
    if grid.nx * grid.ny > solvers.GROUP_POINTS:
        raise ValueError("too large for one group; use run()")

    def march(pdf):
        import numpy as np
        import pandas as pd

        at = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        alpha, levels = float(pdf["alpha"].iloc[0]), grid.hierarchy()
        u, f, edge = (np.zeros((grid.nx, grid.ny)) for _ in range(3))
        sources, edges = np.stack(pdf["f"].to_numpy()), np.stack(pdf["edge"].to_numpy())
        u[at] = pdf["u"]
        before, states = None, [pdf.assign(step=0)[["run_id", "step", "i", "j", "u"]]]
        for n in range(steps):
            f[at], edge[at] = sources[:, n], edges[:, n]
            if method == "bdf2" and before is not None:  # its first step is one of backward Euler
                shift = 1.5 / (dt * alpha)
                right = (2.0 * u - 0.5 * before) / (dt * alpha) + f / alpha
            else:
                shift = 1.0 / (theta * dt * alpha)
                right = u * shift - (1.0 - theta) / theta * kernels.apply(u, grid) + f / (theta * alpha)
            before = u
            edge[1:-1, 1:-1] = u[1:-1, 1:-1]
            u = edge.copy()
            for _ in range(most):
                u = kernels.cycle(u, right, levels, shift=shift)
                if kernels.norm(kernels.residual(u, right, grid, shift), grid) < tolerance:
                    break
            if want == "states":
                states.append(pdf.assign(step=n + 1, u=u[at])[["run_id", "step", "i", "j", "u"]])
        return pd.concat(states) if want == "states" else pdf.assign(u=u[at])[["run_id", "i", "j", "u"]]

    schema = "run_id string, step int, i int, j int, u double" if want == "states" else "run_id string, i int, j int, u double"
    return runs.select("run_id", "i", "j", "u", "alpha", "f", "edge").groupBy("run_id").applyInPandas(march, schema)


def next_step(dt: float, error: float, tolerance: float, order: int) -> tuple[bool, float]:
    """Whether a step is kept, and the step to take next: at most doubled where the error is below a quarter of the tolerance, at least a quarter where it is rejected."""
    grow = (tolerance / max(error, 1e-300)) ** (1.0 / (order + 1))
    if error < tolerance:
        return True, min(2 * dt, dt * grow) if error < tolerance / 4 else dt
    return False, max(dt / 4, 0.8 * dt * grow)


def doubled_step(field: DataFrame, grid: Grid, alpha: float, dt: float, tolerance: float, method: str = "crank_nicolson", tries: int = 10) -> tuple[DataFrame, float, float]:
    """(field, dt taken, next dt): one step against two half steps, retried smaller until close.

    The error is the root of the summed squares of their difference, a third of it for a method of second
    order. The half steps are returned; after ``tries`` rejections, the last single step is.
    """
    theta = METHODS[method]
    order = 2 if theta == 0.5 else 1
    for _ in range(tries):
        one = theta_step(field, grid, alpha, dt, theta).select("i", "j", F.col("u").alias("__one"))
        half = theta_step(theta_step(field, grid, alpha, dt / 2, theta), grid, alpha, dt / 2, theta)
        both = solvers.checkpoint(half.join(one, ["i", "j"]))
        square = both.agg(F.sum(F.pow(F.col("u") - F.col("__one"), F.lit(2.0)))).first()[0]
        kept, following = next_step(dt, square**0.5 / (3.0 if order == 2 else 1.0), tolerance, order)
        if kept:
            return both.drop("__one"), dt, following
        taken, dt = dt, following
    return both.withColumn("u", F.col("__one")).drop("__one"), taken, dt


def march_adaptive(runs: DataFrame, grid: Grid, dt: float, until: float, tolerance: float, method: str = "backward_euler", tries: int = 10, solved_to: float = 1e-10, most: int = 60) -> DataFrame:
    """(run_id, step, t, dt, error, tries, norm): the accepted steps of every run (run_id, i, j, u, alpha), without a source, its edge held.

    Every run has a time, a step and a verdict of its own: a step is held against two half steps, as in
    ``doubled_step``, and runs are one group each. ``norm`` is the root of the summed squares after the step.
    """
    theta = METHODS[method]
    if theta == 0:
        raise ValueError("march_adaptive takes implicit methods")
    if grid.nx * grid.ny > solvers.GROUP_POINTS:
        raise ValueError("too large for one group; use doubled_step")
    order = 2 if theta == 0.5 else 1

    def march(pdf):
        import numpy as np
        import pandas as pd

        at, levels = (pdf["i"].to_numpy(), pdf["j"].to_numpy()), grid.hierarchy()
        alpha, u = float(pdf["alpha"].iloc[0]), np.zeros((grid.nx, grid.ny))
        u[at] = pdf["u"]

        def step(u, h):
            shift = 1.0 / (theta * h * alpha)
            right = u * shift - (1.0 - theta) / theta * kernels.apply(u, grid)
            for _ in range(most):
                u = kernels.cycle(u, right, levels, shift=shift)
                if kernels.norm(kernels.residual(u, right, grid, shift), grid) < solved_to * shift:
                    break
            return u

        t, h, rows = 0.0, dt, []
        while t < until - 1e-12:
            for attempt in range(1, tries + 1):
                taken = min(h, until - t)
                one, two = step(u, taken), step(step(u, taken / 2), taken / 2)
                error = float(np.sqrt(np.sum((two - one) ** 2))) / (3.0 if order == 2 else 1.0)
                kept, h = next_step(taken, error, tolerance, order)
                if kept:
                    break
            u, t = two if kept else one, t + taken
            rows.append((pdf["run_id"].iloc[0], len(rows) + 1, t, taken, error, attempt, float(np.sqrt(np.sum(u * u)))))
        return pd.DataFrame(rows, columns=["run_id", "step", "t", "dt", "error", "tries", "norm"])

    return runs.select("run_id", "i", "j", "u", "alpha").groupBy("run_id").applyInPandas(march, "run_id string, step int, t double, dt double, error double, tries int, norm double")


def stability_scan(field: DataFrame, grid: Grid, alpha: float, steps: list[float], count: int = 20) -> DataFrame:
    """(dt, largest, stable) of forward Euler for each dt: below 1e6 and not NaN after ``count`` steps."""
    spark, rows = field.sparkSession, []
    for dt in steps:
        now = field
        for n in range(count):
            now = forward_euler(now, grid, alpha, dt)
            if n % 4 == 3:
                now = solvers.checkpoint(now)
        largest = now.agg(F.max(F.abs("u"))).first()[0]
        rows.append((dt, largest, bool(largest == largest and largest < 1e6)))
    return spark.createDataFrame(rows, "dt double, largest double, stable boolean")


def feedback_step(dt: float, iterations: int, grid: Grid, alpha: float, cfl: float = 1.0) -> float:
    """The next dt from the solver's work: a tenth more below 5 iterations, a fifth less above 20; never beyond the CFL bound."""
    dt = dt * 1.1 if iterations < 5 else dt * 0.8 if iterations > 20 else dt
    return min(dt, cfl * grid.h**2 / (4.0 * alpha))


def feedback_steps(work: DataFrame, grid: Grid, alpha: float, cfl: float = 1.0) -> DataFrame:
    """Add ``next_dt`` to rows (dt, iterations), by the rule of ``feedback_step``."""
    changed = F.when(F.col("iterations") < 5, F.col("dt") * 1.1).when(F.col("iterations") > 20, F.col("dt") * 0.8).otherwise(F.col("dt"))
    return work.withColumn("next_dt", F.least(changed, F.lit(cfl * grid.h**2 / (4.0 * alpha))))
