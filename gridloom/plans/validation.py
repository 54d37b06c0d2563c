"""Validation runs: solve problems of the catalog on several grids, and judge errors, orders and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convergence, statistics
from ..grid import Grid
from ..operators import boundary, solvers, stencil, timestep
from ..sources.problems import HEAT, POISSON


def problem_field(spark: SparkSession, grid: Grid, name: str) -> DataFrame:
    """(i, j, u, f, exact): zero inside, the exact values on the boundary."""
    p = POISSON[name]
    made = grid.evaluate(spark, exact=p.exact, f=p.source)
    return boundary.boundary(made, grid).select("i", "j", F.col("exact").alias("u"), "f", "exact").unionByName(boundary.interior(made, grid).select("i", "j", F.lit(0.0).alias("u"), "f", "exact"))


#: Factors (key, a) of solutions and sources: a problem is solved once for each, as run name:key.
Scales = list[tuple[str, float]]


def _run(name: str, key: str) -> str:
    return f"{name}:{key}" if key else name


def problem_runs(spark: SparkSession, grid: Grid, names: list[str], scales: Scales = [("", 1.0)]) -> DataFrame:
    """(run_id, i, j, u, f, exact): the fields of several problems from one pass over the points."""
    x, y = F.col("x"), F.col("y")
    each = F.array(*[F.struct(F.lit(_run(n, k)).alias("run_id"), (a * POISSON[n].source(x, y).cast("double")).alias("f"), (a * POISSON[n].exact(x, y).cast("double")).alias("exact")) for n in names for k, a in scales])
    made = grid.points(spark).select("i", "j", F.explode(each).alias("p")).select("i", "j", "p.*")
    return made.select("run_id", "i", "j", F.when(grid.inside(), 0.0).otherwise(F.col("exact")).alias("u"), "f", "exact")


def _errors(solved: DataFrame, grid: Grid, n: int) -> DataFrame:
    """(problem, n, h, l2_error, max_error) of solved runs (run_id, u, exact)."""
    off = F.col("u") - F.col("exact")
    return solved.groupBy(F.col("run_id").alias("problem")).agg(F.sqrt(F.lit(grid.hx * grid.hy) * F.sum(off * off)).alias("l2_error"), F.max(F.abs(off)).alias("max_error")).select("problem", F.lit(n).alias("n"), F.lit(grid.h).alias("h"), "l2_error", "max_error")


def error_table(spark: SparkSession, names: list[str], sizes: list[int], method: str = "V", tolerance: float = 1e-10, scales: Scales = [("", 1.0)]) -> DataFrame:
    """(problem, n, h, l2_error, max_error) after solving every problem on every grid; each grid's problems are solved in one job."""
    parts = []
    for n in sizes:
        grid = Grid(n, n)
        runs = problem_runs(spark, grid, names, scales)
        solved = solvers.solve_runs(runs, grid, method, tolerance, 60, want="field")
        parts.append(_errors(solved.join(runs.select("run_id", "i", "j", "exact"), ["run_id", "i", "j"]), grid, n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def heat_error_table(spark: SparkSession, names: list[str], sizes: list[int], dt: float = 0.01, until: float = 0.1, method: str = "backward_euler", scales: Scales = [("", 1.0)]) -> DataFrame:
    """(problem, n, h, l2_error, max_error) at ``until``; dt is the first grid's step and falls with the spacing's square, so both errors do."""
    out = None
    for n in sizes:
        grid = Grid(n, n)
        steps = round(until / dt * (Grid(sizes[0], sizes[0]).h / grid.h) ** 2)
        step, theta = until / steps, timestep.METHODS[method]
        x, y, each = F.col("x"), F.col("y"), []
        for name in names:
            p = HEAT[name]
            over = lambda made, at: F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: made(x, y, (k + F.lit(at)) * F.lit(step)))  # noqa: B023, E731
            for key, a in scales:
                times = lambda made: lambda *at: a * made(*at)  # noqa: B023, E731
                fields = {"run_id": F.lit(_run(name, key)), "alpha": F.lit(p.alpha), "u": a * p.exact(x, y, F.lit(0.0)), "f": over(times(p.source), theta), "edge": over(times(p.exact), 1.0), "exact": a * p.exact(x, y, F.lit(until))}
                each.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
        runs = grid.points(spark).select("i", "j", F.explode(F.array(*each)).alias("p")).select("i", "j", "p.*")
        solved = timestep.march_runs(runs, grid, step, steps, method)
        part = _errors(solved.join(runs.select("run_id", "i", "j", "exact"), ["run_id", "i", "j"]), grid, n)
        out = part if out is None else out.unionByName(part)
    return out


#: Errors up to here are rounding and what the solver leaves.
ROUNDING = 1e-8


def order_study(errors: DataFrame, least: float = 1.8, most: float = 2.2) -> DataFrame:
    """(problem, slope, r2, margin, fitted, passed): log-log fit of the L2 error over the spacing.

    Where the scheme is exact only rounding and the solver's tolerance are left, below ``ROUNDING``: no order can be
    fitted there, ``fitted`` is false and ``passed`` null.
    """
    fit = convergence.loglog_fit(errors, ["problem"], "h", "l2_error")
    size = errors.groupBy("problem").agg((F.max("l2_error") > ROUNDING).alias("fitted"))
    return fit.join(size, "problem").select("problem", "slope", "r2", "margin", "fitted", F.when(F.col("fitted"), F.col("slope").between(least, most)).alias("passed"))


def suite(spark: SparkSession, quick: bool = True, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(results, summary): order and rate tests of the catalogs, and their pass rates with a total row.

    quick takes three problems on small grids; else every Poisson and heat problem of the catalogs is a row,
    also those whose order the scheme misses. Problems that the scheme solves exactly are rows that are not fitted
    and do not count in the rates.
    """
    names = ["trigonometric", "polynomial", "anisotropic"] if quick else list(POISSON)
    sizes = [9, 17, 33] if quick else [17, 33, 65]
    judged = lambda study, kind: study.select(F.col("problem").alias("test"), F.lit(kind).alias("kind"), "fitted", "passed", F.col("slope").alias("value"))
    scales = [("", scale)]
    order = judged(order_study(error_table(spark, names, sizes, scales=scales)), "order")
    if not quick:
        order = order.unionByName(judged(order_study(heat_error_table(spark, list(HEAT), sizes, scales=scales), 1.6, 2.4), "heat_order"))
    grid = Grid(sizes[-1], sizes[-1])
    history = solvers.solve_runs(problem_runs(spark, grid, names, scales), grid, "V", 1e-9, 30)
    rates = statistics.geometric_mean(convergence.ratios(history, ["run_id"], "iteration", "residual_norm").where("iteration > 1"), ["run_id"], "ratio")
    rate = rates.select(F.col("run_id").alias("test"), F.lit("rate").alias("kind"), F.lit(True).alias("fitted"), (F.col("geometric_mean") < 0.2).alias("passed"), F.col("geometric_mean").alias("value"))
    results = solvers.checkpoint(order.unionByName(rate))
    return results, statistics.pass_rates(results.where("fitted").withColumn("elapsed", F.lit(None).cast("double")), "kind", "passed", "elapsed")


def transfer_accuracy(spark: SparkSession, grid: Grid, name: str = "trigonometric") -> DataFrame:
    """How far a field moves when it is restricted and prolonged again."""
    p = POISSON[name]
    u = grid.evaluate(spark, u=p.exact)
    back = stencil.prolong_bilinear(stencil.restrict_full(u, grid), grid)
    return stencil.norms(stencil.combine(u, back, lambda a, b: a - b), grid)


def region_scales(spark: SparkSession, sf_dir: str) -> Scales:
    """A factor for each region, of which there are a handful: the mean balance of its suppliers, in thousands."""
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    means = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).groupBy("n_regionkey").agg(F.round(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 1000, 6).alias("a"))
    return [(str(r["n_regionkey"]), r["a"]) for r in means.orderBy("n_regionkey").collect()]


def _mean_scale(spark: SparkSession, sf_dir: str) -> float:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.round(F.avg("s_acctbal") / 1000, 6)).first()[0] or 1.0


QUERIES = {
    "validation_suite": lambda spark, sf_dir: suite(spark, quick=False, scale=_mean_scale(spark, sf_dir))[0],
    "validation_summary": lambda spark, sf_dir: suite(spark, quick=False, scale=_mean_scale(spark, sf_dir))[1],
}
