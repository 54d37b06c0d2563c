"""Aggregates over timings, runs and samples; population deviation and interpolated percentiles throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import student


def t_quantile(freedom: Column, confidence: float = 0.95) -> Column:
    """Two-sided quantile of Student's t; null for none."""
    return student.quantile(freedom, confidence)


#: Tasks that share the quantiles of ``with_t_quantile``.
QUANTILE_PARTS = 64


def with_t_quantile(df: DataFrame, freedom: str, name: str, confidence: float = 0.95) -> DataFrame:
    """Add ``name``, the two-sided quantile for the column ``freedom``, worked out once for each value that there is.

    A quantile costs thousands of steps, and many groups share their size.
    """
    place = F.least(F.col(freedom).cast("double"), F.lit(float(student.MOST_FREEDOM)))
    each = df.select(place.alias("__v")).where("__v IS NOT NULL").distinct().repartition(QUANTILE_PARTS, "__v")
    return df.withColumn("__v", place).join(each.select("__v", t_quantile(F.col("__v"), confidence).alias(name)), "__v", "left").drop("__v")


def timing_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("deviation"), F.percentile(v, F.lit(0.95)).alias("p95"),
    )


def timing_moments(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """The statistics of times that partial sums give, and further aggregates in the same pass; percentiles: ``scans.order_statistics``."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("deviation"), *more)


def variation(df: DataFrame, keys: list[str], value: str, work: Column) -> DataFrame:
    """Mean time, coefficient of variation and throughput (work over time)."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.sum(work).alias("work"), F.sum(value).alias("total"))
    return out.select(*keys, "mean", F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")).alias("cv"), F.when(F.col("total") > 0, F.col("work") / F.col("total")).alias("throughput"))


def share_of_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, total, share): the whole comes from the keys' sums, so that the source is aggregated once."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    whole = sums.agg(F.sum("total").alias("whole"))
    return sums.join(F.broadcast(whole)).select(*keys, "total", (F.col("total") / F.col("whole")).alias("share"))  # a single row is sent


def level_rollup(df: DataFrame, name: str, value: str) -> DataFrame:
    """Totals by level and operation from names such as level_2_smooth."""
    parts = F.split(name, "_")
    named = df.where(F.col(name).startswith("level_")).select(parts[1].cast("int").alias("level"), F.array_join(F.slice(parts, 3, 20), "_").alias("op"), F.col(value).alias("v"))
    return named.groupBy("level", "op").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def pass_rates(df: DataFrame, kind: str, passed: str, elapsed: str) -> DataFrame:
    """Tests, passes, rate and mean time of each kind, and of all in a row whose kind is null."""
    out = df.rollup(kind).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col(passed)).alias("passed"), F.avg(elapsed).alias("mean_time"))
    return out.withColumn("rate", F.col("passed") / F.col("tests"))


def op_profile(df: DataFrame, keys: list[str], elapsed: str, flops: str, size: str) -> DataFrame:
    """Calls, time, share, FLOP/s and bytes/s of each operation."""
    own = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum(elapsed).alias("total"), F.min(elapsed).alias("least"), F.max(elapsed).alias("most"), F.sum(flops).alias("flops"), F.sum(size).alias("bytes"))
    whole = own.agg(F.sum("total").alias("whole"))
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total"))
    return own.join(F.broadcast(whole)).select(*keys, "calls", "total", "least", "most", (F.lit(100.0) * F.col("total") / F.col("whole")).alias("percent"), rate("flops").alias("flop_rate"), rate("bytes").alias("byte_rate"))


def run_average(df: DataFrame, keys: list[str], elapsed: str, iterations: str, converged: str) -> DataFrame:
    """One record for repeated runs; converged only if all were."""
    return df.groupBy(*keys).agg(F.avg(elapsed).alias("mean_time"), F.stddev_pop(elapsed).alias("time_deviation"), F.avg(iterations).cast("int").alias("iterations"), F.bool_and(converged).alias("all_converged"))


def summary(df: DataFrame, value: str, size: str) -> DataFrame:
    return df.agg(F.min(value).alias("best"), F.avg(value).alias("mean"), F.max(value).alias("worst"), F.stddev_pop(value).alias("deviation"), F.count_distinct(size).alias("sizes"))


def speedup_counts(df: DataFrame, speedup: str) -> DataFrame:
    s = F.col(speedup)
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s >= k).alias(f"at_least_{k}") for k in (2, 5, 10)], F.max(s).alias("most"), F.avg(s).alias("mean"))


def geometric_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of the positive finite values."""
    return df.where((F.col(value) > 0) & (F.col(value) < float("inf"))).groupBy(*keys).agg(F.exp(F.avg(F.log(value))).alias("geometric_mean"))


def log_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(F.log(F.col(a) + 1e-16), F.log(F.col(b) + 1e-16)).alias("correlation"))


def trend(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First, last and largest value of each key, and the growth between."""
    out = df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max(value).alias("peak"))
    return out.withColumn("growth", F.col("last") - F.col("first"))


def usage_share(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("whole")))).select(key, "n", (F.col("n") / F.col("whole")).alias("share"))


def reliability(df: DataFrame, inner: list[str], outer: list[str], converged: str) -> DataFrame:
    """Converged share of each inner group, then the mean over each outer group."""
    first = df.groupBy(*dict.fromkeys([*outer, *inner])).agg((F.count_if(F.col(converged)) / F.count(F.lit(1))).alias("r"))
    return first.groupBy(*outer).agg(F.avg("r").alias("reliability"))


def mean_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean with its 95 % t interval, from the sample deviation."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    half = F.col("__t") * F.col("s") / F.sqrt(F.col("n").cast("double"))
    return with_t_quantile(out.withColumn("__freedom", F.col("n") - 1), "__freedom", "__t").select(*keys, "n", "mean", half.alias("half_width"))


def outliers(df: DataFrame, keys: list[str], value: str, z: float = 3.0) -> DataFrame:
    """Add ``z`` and ``outlier``; one row of moments for each key is joined back."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    out = df.join(moments, keys).withColumn("z", F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0))
    return out.withColumn("outlier", F.abs("z") > z).drop("__m", "__s")


def error_budget(df: DataFrame, parts: list[str]) -> DataFrame:
    """Add the root of the summed squares and each part's share of it."""
    total = sum((F.col(p) * F.col(p) for p in parts[1:]), F.col(parts[0]) * F.col(parts[0]))
    out = df.withColumn("total_error", F.sqrt(total))
    for p in parts:
        out = out.withColumn(f"{p}_share", F.when(F.col("total_error") > 0, F.col(p) * F.col(p) / (F.col("total_error") * F.col("total_error"))).otherwise(0.0))
    return out


def complexity(exponent: Column) -> Column:
    """A label for a scaling exponent in the number of unknowns."""
    return F.when(exponent < 1.2, "linear").when(exponent < 1.6, "n log n").when(exponent < 2.2, "quadratic").otherwise("worse than quadratic")


def best_device(df: DataFrame, keys: list[str], name: str, load: str, free: str) -> DataFrame:
    """The name with the largest 0.6 (1 - load) + 0.4 free; of equals the smaller name."""
    score = F.lit(0.6) * (F.lit(1.0) - F.col(load)) + F.lit(0.4) * F.col(free)
    ranked = df.withColumn("score", score)
    best = ranked.groupBy(*keys).agg(F.max("score").alias("score")) if keys else ranked.agg(F.max("score").alias("score"))
    return ranked.join(best, [*keys, "score"]).groupBy(*keys, "score").agg(F.min(name).alias(name))


def first_config(df: DataFrame, keys: list[str], order: str, elapsed: str) -> DataFrame:
    """Add ``speedup`` over the first configuration of each key, and ``efficiency`` by place."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.first_value(elapsed).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("speedup", F.when(F.col(elapsed) > 0, first / F.col(elapsed)))
    return out.withColumn("efficiency", F.col("speedup") / F.row_number().over(w))


def weak_efficiency(df: DataFrame, keys: list[str], order: str, elapsed: str) -> DataFrame:
    """Add ``weak_efficiency``: the first time over this one, where work grows with the workers."""
    first = F.first_value(elapsed).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("weak_efficiency", F.when(F.col(elapsed) > 0, first / F.col(elapsed)))
