"""Records and summaries of solves, devices, memory pools and scaling runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .convergence import loglog_fit

#: Theoretical smoothing factors of the 2-D Poisson problem, and what a usual transfer pair keeps.
SMOOTHING = {"gauss_seidel": 0.25, "jacobi": 0.5, "red_black_gs": 0.5, "weighted_jacobi": 0.33}
TRANSFER, TWO_GRID_MOST = 0.8, 0.5


def _converging(residual: str, before: Column) -> Column:
    """The ratio to the residual before, where it lies in (0, 1)."""
    ratio = F.when(before > 0, F.col(residual) / before)
    return F.when((ratio > 0) & (ratio < 1), ratio)


def convergence_info(history: DataFrame, keys: list[str], order: str, residual: str, elapsed: str, precision: str, tolerance: float) -> DataFrame:
    """The record of each run: converged, iterations, final residual, rate, times and precisions used.

    The rate is the mean of the ratios in (0, 1) among the last five residuals; 0 if there is none, or
    fewer than three residuals.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    rows = history.withColumn("__ratio", _converging(residual, F.lag(residual).over(w))).withColumn("__back", back)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iterations"), F.max_by(residual, order).alias("final_residual"), F.avg(F.when(F.col("__back") <= 4, F.col("__ratio"))).alias("rate"),
        F.sum(elapsed).alias("total_time"), F.avg(elapsed).alias("mean_time"), F.array_join(F.array_sort(F.collect_set(precision)), ",").alias("precisions"),
    )
    rate = F.when(F.col("iterations") < 3, 0.0).otherwise(F.coalesce("rate", F.lit(0.0)))
    return out.withColumn("converged", F.col("final_residual") < tolerance).withColumn("rate", rate)


def solve_profile(history: DataFrame, keys: list[str], order: str, residual: str, elapsed: str, levels: int) -> DataFrame:
    """Iterations, final residual, mean rate (1 if no step converges), times and work units: iterations times 2^levels - 1."""
    before = F.lag(residual).over(Window.partitionBy(*keys).orderBy(order))
    rows = history.withColumn("__ratio", _converging(residual, before))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("iterations"), F.max_by(residual, order).alias("final_residual"), F.coalesce(F.avg("__ratio"), F.lit(1.0)).alias("mean_rate"), F.avg(elapsed).alias("mean_time"), F.sum(elapsed).alias("total_time"))
    return out.withColumn("work_units", F.col("iterations") * F.lit(2**levels - 1))


def level_breakdown(events: DataFrame, level: str, op: str, elapsed: str) -> DataFrame:
    """(level, op, time, op_percent, level_time, level_percent): shares of an operation in its level and of a level in all."""
    own = events.groupBy(level, op).agg(F.sum(elapsed).alias("time"))
    per = own.groupBy(level).agg(F.sum("time").alias("level_time"))
    whole = per.agg(F.sum("level_time").alias("__whole"))
    out = own.join(per, level).join(F.broadcast(whole))  # a single row is sent
    share = lambda a, b: F.lit(100.0) * F.col(a) / F.greatest(F.col(b), F.lit(1e-9))
    return out.select(level, op, "time", share("time", "level_time").alias("op_percent"), "level_time", share("level_time", "__whole").alias("level_percent"))


def cycle_stats(events: DataFrame, cycle: str, elapsed: str) -> DataFrame:
    return events.groupBy(cycle).agg(F.count(F.lit(1)).alias("n"), F.avg(elapsed).alias("mean"), F.min(elapsed).alias("least"), F.max(elapsed).alias("most"), F.stddev_pop(elapsed).alias("deviation"))


def device_summary(infos: DataFrame, keys: list[str], iterations: str, residual: str, converged: str) -> DataFrame:
    """One record of a solve on several devices: the most iterations, the worst residual, converged if all are."""
    return infos.groupBy(*keys).agg(F.max(iterations).alias("iterations"), F.avg(iterations).alias("mean_iterations"), F.max(residual).alias("final_residual"), F.bool_and(converged).alias("converged"), F.count(F.lit(1)).alias("devices"))


def pool_statistics(requests: DataFrame, blocks: DataFrame, limit: float) -> DataFrame:
    """Hit rate of requests (hit boolean), and use of blocks (kind, size, in_use) against the pool's limit: one row."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    asked = requests.agg((hits / F.greatest(hits + misses, F.lit(1))).alias("hit_rate"))
    held = blocks.agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("size"), F.count(F.lit(1)).alias("blocks"), F.count_if("in_use").alias("in_use"), F.count_distinct("kind").alias("kinds"))
    both = held.join(F.broadcast(asked))  # a single row is sent
    return both.select("hit_rate", "size", "blocks", "in_use", (F.col("blocks") - F.col("in_use")).alias("available"), "kinds", (F.col("size") / F.lit(limit)).alias("utilization"))


def gpu_profiles(events: DataFrame, name: str, gpu: str, cpu: str, launches: str, size: str, most: int = 10) -> DataFrame:
    """The operations with most device time: calls, times, share of all, efficiency and bandwidth."""
    own = events.groupBy(name).agg(F.count(F.lit(1)).alias("calls"), F.sum(gpu).alias("gpu_time"), F.avg(gpu).alias("mean_gpu_time"), F.sum(cpu).alias("cpu_time"), F.sum(launches).alias("launches"), F.sum(size).alias("bytes"))
    whole = own.agg(F.sum("gpu_time").alias("whole"))
    positive = F.col("gpu_time") > 0
    out = own.join(F.broadcast(whole)).select(  # a single row is sent
        name, "calls", "gpu_time", "mean_gpu_time", (F.lit(100.0) * F.col("gpu_time") / F.greatest(F.col("whole"), F.lit(1e-9))).alias("percent"),
        F.when(F.col("gpu_time") + F.col("cpu_time") > 0, F.col("gpu_time") / (F.col("gpu_time") + F.col("cpu_time"))).alias("efficiency"), F.when(positive, F.col("bytes") / F.col("gpu_time")).alias("bandwidth"), "launches",
    )
    return out.orderBy(F.col("gpu_time").desc(), name).limit(most)


def gpu_efficiency(events: DataFrame, name: str, gpu: str, cpu: str, launches: str) -> DataFrame:
    """Device over host time, and launches and operations for each second of device time: one row."""
    sums = events.agg(F.sum(gpu).alias("g"), F.sum(cpu).alias("c"), F.sum(launches).alias("n"), F.count_distinct(name).alias("ops"))
    return sums.where("g > 0").select((F.col("g") / F.greatest(F.col("c"), F.lit(1e-9))).alias("gpu_cpu_ratio"), (F.col("n") / F.col("g")).alias("launches_per_second"), (F.col("ops") / F.col("g")).alias("operations_per_second"))


def throughput_ratios(runs: DataFrame, keys: list[str], size: str, work: str, elapsed: str) -> DataFrame:
    """(keys, size, throughput, ratio): the throughput at each size, over that at the first size; null there."""
    own = runs.groupBy(*keys, size).agg((F.sum(work) / F.sum(elapsed)).alias("throughput"))
    w = Window.partitionBy(*keys).orderBy(size)
    first = F.first_value("throughput").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("ratio", F.when(F.row_number().over(w) > 1, F.col("throughput") / first))


def scaling_ranking(runs: DataFrame, key: str, size: str, work: str, elapsed: str) -> DataFrame:
    """Best and worst configuration by mean throughput ratio (higher is better) and by time exponent (lower is): one row.

    Of equals the first name.
    """
    efficiency = throughput_ratios(runs, [key], size, work, elapsed).groupBy(key).agg(F.avg("ratio").alias("efficiency"))
    both = efficiency.join(loglog_fit(runs, [key], work, elapsed).select(key, F.col("slope").alias("exponent")), key)
    pick = lambda least, c: F.min(F.struct((F.col(c) if least else -F.col(c)).alias("v"), F.col(key).alias("k")))["k"]
    return both.agg(pick(False, "efficiency").alias("best_efficiency"), pick(True, "efficiency").alias("worst_efficiency"), pick(True, "exponent").alias("best_exponent"), pick(False, "exponent").alias("worst_exponent"))


def kind_summary(results: DataFrame, kind: str, passed: str, orders: list[str]) -> DataFrame:
    """Tests, passes, rate, and mean and deviation of each order, for each kind of problem."""
    out = results.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(passed)).alias("passed"), *[x for o in orders for x in (F.avg(o).alias(f"mean_{o}"), F.stddev_pop(o).alias(f"deviation_{o}"))])
    return out.withColumn("pass_rate", F.col("passed") / F.col("total"))


def within_limits(runs: DataFrame, limits: DataFrame, key: str, elapsed: str) -> DataFrame:
    """Each run that has a limit (key, target, most): whether it keeps the target and the most."""
    return runs.join(limits, key).select(key, elapsed, (F.col(elapsed) <= F.col("target")).alias("on_target"), (F.col(elapsed) <= F.col("most")).alias("ok"))


def method_comparison(runs: DataFrame, method: str, group: str, elapsed: str, groups: list) -> DataFrame:
    """One row a method with its mean time in every group, and its place by the overall mean."""
    wide = runs.groupBy(method).pivot(group, groups).agg(F.avg(elapsed))
    whole = runs.groupBy(method).agg(F.avg(elapsed).alias("mean"))
    return wide.join(whole, method).withColumn("place", F.row_number().over(Window.orderBy("mean", method)))  # a row for each method


def precision_impact(runs: DataFrame, keys: list[str], precision: str, elapsed: str, error: str, base: str, other: str) -> DataFrame:
    """Speedup and error ratio of one precision against another, for each key."""
    at = lambda c, p: F.avg(F.when(F.col(precision) == p, F.col(c)))
    out = runs.groupBy(*keys).agg((at(elapsed, base) / at(elapsed, other)).alias("speedup"), (at(error, other) / at(error, base)).alias("error_ratio"))
    return out.where("speedup IS NOT NULL")


def predicted_factors(steps: DataFrame) -> DataFrame:
    """(before, after, smoother, smoothing, two_grid) by theory, for every pair (before, after) of smoothing steps in a frame."""
    each = F.array(*[F.struct(F.lit(name).alias("smoother"), F.lit(mu).alias("smoothing")) for name, mu in SMOOTHING.items()])
    return steps.select("before", "after", F.inline(each)).withColumn("two_grid", F.least(F.pow("smoothing", F.col("before") + F.col("after")) * TRANSFER, F.lit(TWO_GRID_MOST)))


def run_aggregates(runs: DataFrame, keys: list[str], metrics: list[str], iterations: str) -> DataFrame:
    """Mean and deviation of each metric over repeated runs, and mean, deviation and range of their iterations."""
    spread = [x for name, c in [*((m, m) for m in metrics), ("iterations", iterations)] for x in (F.avg(c).alias(f"avg_{name}"), F.stddev_pop(c).alias(f"std_{name}"))]
    return runs.groupBy(*keys).agg(*spread, F.max(iterations).alias("max_iterations"), F.min(iterations).alias("min_iterations"))


def memory_3d(sizes: DataFrame, levels: int = 5, copies: int = 4, width: int = 8) -> DataFrame:
    """(nx, ny, nz, points, levels, mb) of a 3-D hierarchy, each level an eighth of the one before, ended below 1000 points."""
    points = F.col("nx").cast("long") * F.col("ny") * F.col("nz")
    at = sizes.select("nx", "ny", "nz", points.alias("points"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).withColumn("here", F.expr("points div cast(power(8, level) as bigint)"))
    own = at.where((F.col("level") == 0) | (F.col("here") >= 1000))
    return own.groupBy("nx", "ny", "nz", "points").agg(F.count(F.lit(1)).alias("levels"), (F.sum("here") * F.lit(copies * width) / F.lit(1024.0 * 1024.0)).alias("mb"))
