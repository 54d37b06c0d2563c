"""Convergence analytics over histories (keys…, iteration order, residual): windows and tails.

``keys`` name the run, ``order`` the iteration; both are columns. Every function is one
exchange on the keys, so runs spread over the cluster; a run's history stays together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import student
from .statistics import with_t_quantile


def _window(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def ratios(history: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """Add ``ratio`` to the previous residual; null where that is not positive."""
    before = F.lag(residual).over(_window(keys, order))
    return history.withColumn("ratio", F.when(before > 0, F.col(residual) / before))


def finite(*names: str) -> Column:
    """Whether all these columns are numbers, neither NaN nor infinite."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return out


def rate_window(history: DataFrame, keys: list[str], order: str, residual: str, width: int = 5) -> DataFrame:
    """Add ``rate``: mean of the ratios in (0, 1) among the last ``width``; 1 if none, 0 before there are so many."""
    w = _window(keys, order)
    near = w.rowsBetween(-(width - 1), 0)
    valid = F.when((F.col("ratio") > 0) & (F.col("ratio") < 1), F.col("ratio"))
    out = ratios(history, keys, order, residual).withColumn("__n", F.row_number().over(w)).withColumn("__valid", valid)
    return out.withColumn("rate", F.when(F.col("__n") > width, F.coalesce(F.avg("__valid").over(near), F.lit(1.0))).otherwise(0.0)).drop("__n", "__valid")


def _tail(history: DataFrame, keys: list[str], order: str, length: Column) -> DataFrame:
    """The last rows of each run, as many as ``length`` of the run's size n."""
    every = Window.partitionBy(*keys)
    ranked = history.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("__back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))
    return ranked.where(F.col("__back") <= length).drop("__back")


def asymptotic_rate(history: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """(keys, n_ratios, rate, label): mean of the last quarter of the valid ratios of each run."""
    valid = ratios(history, keys, order, residual).where((F.col("ratio") > 0) & (F.col("ratio") < 2))
    tail = _tail(valid, keys, order, F.greatest(F.lit(1), F.expr("n div 4")))
    return tail.groupBy(*keys).agg(F.first("n").alias("n_ratios"), F.avg("ratio").alias("rate")).withColumn("label", classify(F.col("rate")))


def classify(rate: Column) -> Column:
    return F.when(rate < 0.1, "superlinear").when(rate < 0.9, "linear").when(rate < 0.99, "slow").otherwise("stagnating")


def asymptotic_fit(history: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """(keys, n, factor, r2): exp of the slope of ln(residual + 1e-16) over the last half, of runs of 10 or more.

    Zeros count, in n and in the fit; residuals that are not finite, and negative ones, do not count at
    all. r2 is 0 where all residuals of the tail are equal.
    """
    known = history.where((F.col(residual) >= 0) & finite(residual))
    place = F.row_number().over(_window(keys, order)).cast("double")
    tail = _tail(known.withColumn("__x", place), keys, order, F.greatest(F.lit(5), F.expr("n div 2"))).where("n >= 10")
    y = F.log(F.col(residual) + 1e-16)
    fit = tail.groupBy(*keys).agg(F.first("n").alias("n"), F.exp(F.regr_slope(y, F.col("__x"))).alias("factor"), F.regr_r2(y, F.col("__x")).alias("r2"), (F.min(y) == F.max(y)).alias("__flat"))
    return fit.withColumn("r2", F.when(F.col("__flat"), 0.0).otherwise(F.col("r2"))).drop("__flat")


def stagnation(history: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """(keys, change, stagnating, slow): mean relative change within the last fifth of a run, three rows at least.

    Only changes between two rows of that tail count, and only from positive residuals; where none
    counts, all three are null. Runs of fewer than five rows have no row.
    """
    tail = _tail(history, keys, order, F.greatest(F.lit(3), F.expr("n div 5"))).where("n >= 5")
    before = F.lag(residual).over(_window(keys, order))
    changed = tail.withColumn("__c", F.when(before > 0, F.abs(F.col(residual) - before) / before))
    return changed.groupBy(*keys).agg(F.avg("__c").alias("change")).select(*keys, "change", (F.col("change") < 1e-6).alias("stagnating"), (F.col("change") < 1e-3).alias("slow"))


def divergence(history: DataFrame, keys: list[str], order: str, residual: str, factor: float = 1e3) -> DataFrame:
    """Add ``diverging``: from the third iteration on, beyond ``factor`` times the first residual."""
    w = _window(keys, order)
    first = F.first_value(residual).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return history.withColumn("diverging", (F.row_number().over(w) >= 3) & (F.col(residual) > first * factor))


def best_so_far(history: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """(keys, best, best_at): the least residual and the first iteration that had it."""
    return history.groupBy(*keys).agg(F.min(residual).alias("best"), F.min_by(order, F.struct(residual, order)).alias("best_at"))


def running_best(history: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """Add ``best``: the least residual up to each iteration."""
    return history.withColumn("best", F.min(residual).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def promotion(history: DataFrame, keys: list[str], order: str, residual: str) -> DataFrame:
    """Add ``promote``: over five residuals the mean ratio exceeds 0.9, or the mean change is below
    1e-3, or each is at least 0.99 of the one before."""
    w = _window(keys, order)
    before = F.lag(residual).over(w)
    out = history.withColumn("__n", F.row_number().over(w)).withColumn("__r", F.when(before > 0, F.col(residual) / before)).withColumn("__c", F.when(before > 0, F.abs(F.col(residual) - before) / before))
    out = out.withColumn("__flat", F.col(residual) >= 0.99 * before)
    four = w.rowsBetween(-3, 0)  # four ratios lie between five residuals
    rule = (F.avg("__r").over(four) > 0.9) | (F.avg("__c").over(four) < 1e-3) | F.bool_and("__flat").over(four)
    return out.withColumn("promote", (F.col("__n") >= 5) & F.coalesce(rule, F.lit(False))).drop("__n", "__r", "__c", "__flat")


def switch_precision(history: DataFrame, keys: list[str], order: str, residual: str, limit: float = 0.95) -> DataFrame:
    """(keys, switch_at): the first iteration from the tenth on whose last five ratios average ``limit`` or more."""
    w = _window(keys, order)
    out = ratios(history, keys, order, residual).withColumn("__n", F.row_number().over(w)).withColumn("__m", F.avg("ratio").over(w.rowsBetween(-4, 0)))
    return out.where((F.col("__n") >= 10) & (F.col("__m") >= limit)).groupBy(*keys).agg(F.min(order).alias("switch_at"))


def preconditioner_switch(history: DataFrame, keys: list[str], order: str, residual: str, width: int = 5, limit: float = 0.9) -> DataFrame:
    """Add ``switch``: the last residual of a full window is above ``limit`` times its first.

    Every such row is marked; ``preconditioners.Adaptive`` is the policy that forgets its history after a switch.
    """
    w = _window(keys, order)
    first = F.first_value(residual).over(w.rowsBetween(-(width - 1), 0))
    full = F.row_number().over(w) >= width
    return history.withColumn("switch", full & (first > 0) & (F.col(residual) > first * limit))


def monitor_stagnation(history: DataFrame, keys: list[str], order: str, residual: str, width: int = 10, least: float = 1e-6) -> DataFrame:
    """Add ``stagnant``: the mean relative change within the last ``width`` residuals is below ``least``.

    Changes from a residual that is not positive do not count; where none counts, the last judgement stays.
    """
    w = _window(keys, order)
    before = F.lag(residual).over(w)
    changed = history.withColumn("__c", F.when(before > 0, F.abs(F.col(residual) - before) / before)).withColumn("__n", F.row_number().over(w))
    judged = changed.withColumn("__j", F.when(F.col("__n") >= width, F.avg("__c").over(w.rowsBetween(-(width - 2), 0)) < least))
    last = F.last("__j", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("stagnant", F.coalesce(last, F.lit(False))).drop("__c", "__n", "__j")


def stall(history: DataFrame, keys: list[str], order: str, value: str, width: int = 50) -> DataFrame:
    """Add ``stalled``: more than ``width`` values so far and the last ``width`` all equal."""
    w = _window(keys, order)
    near = w.rowsBetween(-(width - 1), 0)
    return history.withColumn("stalled", (F.row_number().over(w) > width) & (F.min(value).over(near) == F.max(value).over(near)))


def last_rows(history: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return history.withColumn("__back", back).where(F.col("__back") <= count).drop("__back")


def relative_time(history: DataFrame, keys: list[str], micros: str) -> DataFrame:
    """Add ``seconds`` since the run's first row; ``micros`` is a long column."""
    return history.withColumn("seconds", (F.col(micros) - F.min(micros).over(Window.partitionBy(*keys))) / F.lit(1e6))


def trailing(history: DataFrame, keys: list[str], seconds: str, value: str, span: int = 10) -> DataFrame:
    """Add mean and count of the last ``span`` seconds; ``seconds`` is a long column."""
    near = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-span, 0)
    return history.withColumn("trailing_mean", F.avg(value).over(near)).withColumn("trailing_count", F.count(value).over(near))


def orders(errors: DataFrame, keys: list[str], h: str, error: str) -> DataFrame:
    """Add ``order``: ln of the error ratio over ln of the spacing ratio, from coarse to fine."""
    w = Window.partitionBy(*keys).orderBy(F.col(h).desc())
    e0, h0 = F.lag(error).over(w), F.lag(h).over(w)
    return errors.withColumn("order", F.when((e0 > 0) & (F.col(error) > 0) & (h0 > F.col(h)), F.log(e0 / F.col(error)) / F.log(h0 / F.col(h))))


def loglog_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of ln y over ln x: slope, intercept, r2, standard error, 95 % margin, SSR and p-value.

    Rows whose logarithms are not finite are left out. The margin is 1.96 standard errors, the usual
    approximation; ``t_margin`` takes Student's quantile. ``p_value`` is that of a slope of zero, two-sided;
    0 for an exact fit, null for fewer than three rows.
    """
    fine = df.where((F.col(x) > 0) & (F.col(y) > 0) & finite(x, y)).select(*keys, F.log(x).alias("a"), F.log(y).alias("b"))
    sums = fine.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"), F.regr_r2("b", "a").alias("r2"),
        F.regr_sxx("b", "a").alias("sxx"), F.regr_syy("b", "a").alias("syy"), F.regr_sxy("b", "a").alias("sxy"),
    )
    ssr = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    out = sums.withColumn("ssr", ssr).withColumn("stderr", F.when(F.col("n") > 2, F.sqrt(F.col("ssr") / (F.col("n") - 2) / F.col("sxx"))))
    t = F.when(F.col("stderr") > 0, F.col("slope") / F.col("stderr")).otherwise(F.when(F.col("slope") == 0, 0.0).otherwise(float("inf")))
    out = with_t_quantile(out.withColumn("__freedom", F.col("n") - 2), "__freedom", "__t")
    out = out.withColumn("margin", F.lit(1.96) * F.col("stderr")).withColumn("t_margin", F.col("__t") * F.col("stderr"))
    return out.withColumn("p_value", student.two_sided(t, F.col("n") - 2)).drop("sxx", "syy", "sxy", "__freedom", "__t")
