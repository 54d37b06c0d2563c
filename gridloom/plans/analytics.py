"""Queries of convergence, benchmark and monitoring analytics over events, lineitem, orders and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import comparison as C
from ..functions import convergence as V
from ..functions import statistics as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, ts, r): each user's events in time order are one residual history."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("r"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows: solver, precision, platform, size, elapsed and a time stamp from lineitem and orders.

    A prime divisor leaves times that do not end, so that no rounding meets a tie.
    """
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_linenumber", "l_discount", "l_tax")
    head = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("at"))
    joined = rows.join(head, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_returnflag").alias("solver"), F.col("l_linestatus").alias("prec"), F.col("o_orderpriority").alias("platform"), F.col("l_linenumber").alias("size"), (F.col("l_extendedprice") / 9973.0).alias("elapsed"), F.col("l_quantity").alias("work"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), "at")


HIST = "h AS (SELECT user_id AS run, ts, value AS r FROM events)"
BENCH = "b AS (SELECT l_returnflag AS solver, l_linestatus AS prec, o_orderpriority AS platform, l_linenumber AS size, l_extendedprice / 9973.0::DOUBLE AS elapsed, l_quantity AS work, l_discount AS discount, l_tax AS tax, o_orderdate AS stamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
W = "OVER (PARTITION BY run ORDER BY ts)"
LAGGED = f"l AS (SELECT *, lag(r) {W} AS p, row_number() {W} AS k, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY ts DESC) AS back FROM h)"
RATIO = "CASE WHEN p > 0 THEN r / p END"
K, T, R = ["run"], "ts", "r"


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def near(width: int) -> str:
    return f"OVER (PARTITION BY run ORDER BY ts ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


def on_history(name: str, sql: str):
    def add(f):
        query(name, f"WITH {HIST}, {LAGGED}{sql}" if sql.startswith(",") else f"WITH {HIST}, {LAGGED} {sql}")(lambda spark, sf_dir: f(hist(spark, sf_dir)))
        return f

    return add


@on_history("ratios", f"SELECT run, epoch_us(ts) AS ts, r, {RATIO} AS ratio FROM l")
def ratios(h):
    return V.ratios(h, K, T, R).withColumn("ts", F.unix_micros("ts"))


@query("rate_window", f"WITH {HIST}, {LAGGED}, q AS (SELECT *, {RATIO} AS ratio FROM l), v AS (SELECT *, CASE WHEN ratio > 0 AND ratio < 1 THEN ratio END AS ok FROM q) SELECT run, k, round(CASE WHEN k > 5 THEN coalesce(avg(ok) {near(5)}, 1.0) ELSE 0.0 END, 6) AS rate FROM v")
def rate_window(spark, sf_dir):
    from pyspark.sql.window import Window

    out = V.rate_window(hist(spark, sf_dir), K, T, R).withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("ts")).cast("long"))
    return rounded(out, 6, "rate").select("run", "k", "rate")


@on_history(
    "asymptotic_tail",
    f", q AS (SELECT run, ts, {RATIO} AS ratio FROM l), v AS (SELECT *, count(*) OVER (PARTITION BY run) AS m, row_number() OVER (PARTITION BY run ORDER BY ts DESC) AS d FROM q WHERE ratio > 0 AND ratio < 2), "
    "a AS (SELECT run, min(m) AS n_ratios, avg(ratio) AS rate FROM v WHERE d <= greatest(1, m // 4) GROUP BY run) "
    "SELECT run, n_ratios, round(rate, 6) AS rate, CASE WHEN rate < 0.1 THEN 'superlinear' WHEN rate < 0.9 THEN 'linear' WHEN rate < 0.99 THEN 'slow' ELSE 'stagnating' END AS label FROM a",
)
def asymptotic_tail(h):
    return rounded(V.asymptotic_rate(h, K, T, R), 6, "rate")


@query(
    "asymptotic_fit",
    f"WITH {HIST}, v AS (SELECT run, ln(r + 1e-16) AS y, row_number() {W} AS x, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY ts DESC) AS d FROM h WHERE r >= 0) "
    "SELECT run, min(n) AS n, round(exp(regr_slope(y, x)), 6) AS factor, round(CASE WHEN min(y) = max(y) THEN 0 ELSE regr_r2(y, x) END, 6) AS r2 FROM v WHERE n >= 10 AND d <= greatest(5, n // 2) GROUP BY run",
)
def asymptotic_fit(spark, sf_dir):
    return rounded(V.asymptotic_fit(hist(spark, sf_dir), K, T, R), 6, "factor", "r2")


@on_history(
    "stagnation",
    ", t AS (SELECT *, lag(r) OVER (PARTITION BY run ORDER BY ts) AS q FROM l WHERE n >= 5 AND back <= greatest(3, n // 5)) "
    "SELECT run, round(c, 6) AS change, c < 1e-6 AS stagnating, c < 1e-3 AS slow FROM (SELECT run, avg(CASE WHEN q > 0 THEN abs(r - q) / q END) AS c FROM t GROUP BY run)",
)
def stagnation(h):
    return rounded(V.stagnation(h, K, T, R), 6, "change")


@on_history("divergence", "SELECT run, r, k >= 3 AND r > first * 10.0 AS diverging FROM (SELECT *, first_value(r) OVER (PARTITION BY run ORDER BY ts) AS first FROM l)")
def divergence(h):
    return V.divergence(h, K, T, R, 10.0).select("run", "r", "diverging")


@on_history("best_so_far", "SELECT run, min(r) AS best, epoch_us(arg_min(ts, (r, ts))) AS best_at FROM l GROUP BY run")
def best_so_far(h):
    return V.best_so_far(h, K, T, R).withColumn("best_at", F.unix_micros("best_at"))


@on_history("running_best", f"SELECT run, r, min(r) {W} AS best FROM l")
def running_best(h):
    return V.running_best(h, K, T, R).select("run", "r", "best")


@on_history("classify_rate", f"SELECT run, r, CASE WHEN q < 0.1 THEN 'superlinear' WHEN q < 0.9 THEN 'linear' WHEN q < 0.99 THEN 'slow' ELSE 'stagnating' END AS label FROM (SELECT *, {RATIO} AS q FROM l)")
def classify_rate(h):
    return V.ratios(h, K, T, R).select("run", "r", V.classify(F.col("ratio")).alias("label"))


@query(
    "promote_precision",
    f"WITH {HIST}, {LAGGED}, c AS (SELECT *, {RATIO} AS q, CASE WHEN p > 0 THEN abs(r - p) / p END AS ch, r >= 0.99 * p AS flat FROM l) "
    f"SELECT run, r, k >= 5 AND coalesce((avg(q) {near(4)} > 0.9) OR (avg(ch) {near(4)} < 1e-3) OR bool_and(flat) {near(4)}, false) AS promote FROM c",
)
def promote_precision(spark, sf_dir):
    return V.promotion(hist(spark, sf_dir), K, T, R).select("run", "r", "promote")


@query("switch_precision", f"WITH {HIST}, {LAGGED}, c AS (SELECT *, avg({RATIO}) {near(5)} AS m FROM l) SELECT run, epoch_us(min(ts)) AS switch_at FROM c WHERE k >= 10 AND m >= 0.95 GROUP BY run")
def switch_precision(spark, sf_dir):
    return V.switch_precision(hist(spark, sf_dir), K, T, R).withColumn("switch_at", F.unix_micros("switch_at"))


@on_history("preconditioner_switch", f"SELECT run, r, k >= 5 AND f > 0 AND r > f * 0.9 AS switch FROM (SELECT *, first_value(r) {near(5)} AS f FROM l)")
def preconditioner_switch(h):
    return V.preconditioner_switch(h, K, T, R).select("run", "r", "switch")


@on_history("monitor_stagnation", f", c AS (SELECT *, CASE WHEN p > 0 THEN abs(r - p) / p END AS change FROM l), j AS (SELECT *, CASE WHEN k >= 10 THEN avg(change) {near(9)} < 3.0 END AS judged FROM c) SELECT run, r, coalesce(last_value(judged IGNORE NULLS) {W}, false) AS stagnant FROM j")
def monitor_stagnation(h):
    return V.monitor_stagnation(h, K, T, R, 10, 3.0).select("run", "r", "stagnant")


@on_history("stall_last_n", f"SELECT run, r, k > 5 AND hi = lo AS stalled FROM (SELECT *, max(floor(r / 50)) {near(5)} AS hi, min(floor(r / 50)) {near(5)} AS lo FROM l)")
def stall_last_n(h):
    return V.stall(h.withColumn("step", F.floor(F.col("r") / 50)), K, T, "step", 5).select("run", "r", "stalled")


@on_history("last_n_rows", "SELECT run, epoch_us(ts) AS ts, r FROM l WHERE back <= 5")
def last_n_rows(h):
    return V.last_rows(h, K, T, 5).withColumn("ts", F.unix_micros("ts"))


@query("relative_time", f"WITH {HIST} SELECT run, r, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run)) / 1e6::DOUBLE AS seconds FROM h")
def relative_time(spark, sf_dir):
    h = hist(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    return V.relative_time(h, K, "us").select("run", "r", "seconds")


@query("trailing_window", f"WITH {HIST}, s AS (SELECT run, r / 97.0::DOUBLE AS r, epoch_us(ts) // 1000000 AS sec FROM h) SELECT run, sec, r, round(avg(r) OVER w, 6) AS trailing_mean, count(r) OVER w AS trailing_count FROM s WINDOW w AS (PARTITION BY run ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def trailing_window(spark, sf_dir):
    h = hist(spark, sf_dir).select("run", (F.col("r") / 97.0).alias("r"), F.expr("unix_micros(ts) div 1000000").alias("sec"))
    return rounded(V.trailing(h, K, "sec", R, 86_400), 6, "trailing_mean").select("run", "sec", "r", "trailing_mean", "trailing_count")


@query("threshold_alerts", "SELECT event_id, event_type, CASE WHEN value > 200 THEN 'critical' ELSE 'warning' END AS level FROM events WHERE value > 90")
def threshold_alerts(spark, sf_dir):
    return _table(spark, sf_dir, "events").where("value > 90").select("event_id", "event_type", F.when(F.col("value") > 200, "critical").otherwise("warning").alias("level"))


@query("convergence_order", f"WITH {BENCH}, e AS (SELECT solver, size, 1.0::DOUBLE / size AS h, avg(elapsed) AS err FROM b GROUP BY ALL) SELECT solver, size, round(CASE WHEN p > 0 AND err > 0 THEN ln(p / err) / ln(ph / h) END, 5) AS conv_order FROM (SELECT *, lag(err) OVER (PARTITION BY solver ORDER BY h DESC) AS p, lag(h) OVER (PARTITION BY solver ORDER BY h DESC) AS ph FROM e)")
def convergence_order(spark, sf_dir):
    e = bench(spark, sf_dir).groupBy("solver", "size").agg(F.avg("elapsed").alias("err")).withColumn("h", 1.0 / F.col("size"))
    return V.orders(e, ["solver"], "h", "err").select("solver", "size", F.round("order", 5).alias("conv_order"))


FIT = "count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) AS ssr, regr_sxx(y, x) AS sxx"


@query("loglog_fit", f"WITH {BENCH}, f AS (SELECT platform, ln(elapsed) AS y, ln(work) AS x FROM b WHERE elapsed > 0 AND work > 0), g AS (SELECT platform, {FIT} FROM f GROUP BY platform) SELECT platform, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(ssr, 3) AS ssr, round(sqrt(ssr / (n - 2) / sxx), 6) AS stderr, round(1.96 * sqrt(ssr / (n - 2) / sxx), 6) AS margin FROM g")
def loglog_fit(spark, sf_dir):
    return rounded(rounded(V.loglog_fit(bench(spark, sf_dir), ["platform"], "work", "elapsed"), 6, "slope", "intercept", "r2", "stderr", "margin"), 3, "ssr").drop("t_margin", "p_value")


#: Times that are NaN, infinite, zero or negative on some lines.
MASKED = "m AS (SELECT *, CASE size WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN 0.0 WHEN 4 THEN -elapsed ELSE elapsed END AS odd FROM b)"


@query("finite_mask_fit", f"WITH {BENCH}, {MASKED}, f AS (SELECT prec, ln(odd) AS y, ln(work) AS x FROM m WHERE isfinite(odd) AND odd > 0 AND work > 0), g AS (SELECT prec, {FIT} FROM f GROUP BY prec), q AS (SELECT prec, exp(avg(y)) AS gm FROM f GROUP BY prec) SELECT prec, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(1.96 * sqrt(ssr / (n - 2) / sxx), 6) AS margin, round(gm, 6) AS geometric_mean FROM g JOIN q USING (prec)")
def finite_mask_fit(spark, sf_dir):
    size = F.col("size")
    odd = F.when(size == 1, float("nan")).when(size == 2, float("inf")).when(size == 3, 0.0).when(size == 4, -F.col("elapsed")).otherwise(F.col("elapsed"))
    rows = bench(spark, sf_dir).withColumn("odd", odd)
    fit = V.loglog_fit(rows, ["prec"], "work", "odd").join(S.geometric_mean(rows, ["prec"], "odd"), "prec")
    return rounded(fit, 6, "slope", "intercept", "r2", "margin", "geometric_mean").select("prec", "n", "slope", "intercept", "r2", "margin", "geometric_mean")


@query("log_correlation", f"WITH {BENCH} SELECT solver, round(corr(ln(elapsed + 1e-16), ln(work + 1e-16)), 6) AS correlation FROM b GROUP BY solver")
def log_correlation(spark, sf_dir):
    return rounded(S.log_correlation(bench(spark, sf_dir), ["solver"], "elapsed", "work"), 6, "correlation")


@query("timing_stats", f"WITH {BENCH} SELECT solver, prec, count(elapsed) AS n, round(sum(elapsed), 4) AS total, round(avg(elapsed), 6) AS mean, min(elapsed) AS least, max(elapsed) AS most, round(quantile_cont(elapsed, 0.5), 6) AS median, round(stddev_pop(elapsed), 6) AS deviation, round(quantile_cont(elapsed, 0.95), 6) AS p95 FROM b GROUP BY ALL")
def timing_stats(spark, sf_dir):
    return rounded(rounded(S.timing_stats(bench(spark, sf_dir), ["solver", "prec"], "elapsed"), 6, "mean", "median", "deviation", "p95"), 4, "total")


@query("variation", f"WITH {BENCH} SELECT platform, round(avg(elapsed), 6) AS mean, round(stddev_pop(elapsed) / avg(elapsed), 6) AS cv, round(sum(work) / sum(elapsed), 6) AS throughput FROM b GROUP BY platform")
def variation(spark, sf_dir):
    return rounded(S.variation(bench(spark, sf_dir), ["platform"], "elapsed", F.col("work")), 6, "mean", "cv", "throughput")


@query("share_of_total", f"WITH {BENCH} SELECT solver, round(sum(elapsed), 4) AS total, round(sum(elapsed) / (SELECT sum(elapsed) FROM b), 6) AS share FROM b GROUP BY solver")
def share_of_total(spark, sf_dir):
    return rounded(rounded(S.share_of_total(bench(spark, sf_dir), ["solver"], "elapsed"), 4, "total"), 6, "share")


@query("level_rollup", f"WITH {BENCH} SELECT size AS level, prec || '_' || solver AS op, round(sum(elapsed), 4) AS total, count(*) AS n FROM b GROUP BY ALL")
def level_rollup(spark, sf_dir):
    named = bench(spark, sf_dir).withColumn("name", F.concat_ws("_", F.lit("level"), "size", "prec", "solver"))
    return rounded(S.level_rollup(named, "name", "elapsed"), 4, "total")


@query("pass_rate_rollup", f"WITH {BENCH} SELECT platform, count(*) AS tests, count(*) FILTER (elapsed < 3) AS passed, round(avg(elapsed), 6) AS mean_time, round(count(*) FILTER (elapsed < 3) / count(*), 6) AS rate FROM b GROUP BY ROLLUP (platform)")
def pass_rate_rollup(spark, sf_dir):
    tests = bench(spark, sf_dir).withColumn("passed", F.col("elapsed") < 3)
    return rounded(S.pass_rates(tests, "platform", "passed", "elapsed"), 6, "mean_time", "rate")


@query("op_profile", f"WITH {BENCH}, o AS (SELECT solver, prec, count(*) AS calls, sum(elapsed) AS total, min(elapsed) AS least, max(elapsed) AS most, sum(work) AS fl, sum(size) AS by_ FROM b GROUP BY ALL) SELECT solver, prec, calls, round(total, 4) AS total, least, most, round(100.0 * total / sum(total) OVER (), 6) AS percent, round(fl / total, 6) AS flop_rate, round(by_ / total, 6) AS byte_rate FROM o")
def op_profile(spark, sf_dir):
    return rounded(rounded(S.op_profile(bench(spark, sf_dir), ["solver", "prec"], "elapsed", "work", "size"), 6, "percent", "flop_rate", "byte_rate"), 4, "total")


@query("run_average", f"WITH {BENCH} SELECT solver, prec, round(avg(elapsed), 6) AS mean_time, round(stddev_pop(elapsed), 6) AS time_deviation, CAST(trunc(avg(size)) AS INTEGER) AS iterations, bool_and(elapsed < 9) AS all_converged FROM b GROUP BY ALL")
def run_average(spark, sf_dir):
    return rounded(S.run_average(bench(spark, sf_dir).withColumn("ok", F.col("elapsed") < 9), ["solver", "prec"], "elapsed", "size", "ok"), 6, "mean_time", "time_deviation")


@query("bench_summary", f"WITH {BENCH} SELECT min(elapsed) AS best, round(avg(elapsed), 6) AS mean, max(elapsed) AS worst, round(stddev_pop(elapsed), 6) AS deviation, count(DISTINCT size) AS sizes FROM b")
def bench_summary(spark, sf_dir):
    return rounded(S.summary(bench(spark, sf_dir), "elapsed", "size"), 6, "mean", "deviation")


@query("speedup_counts", f"WITH {BENCH} SELECT count(*) AS n, count(*) FILTER (elapsed >= 2) AS at_least_2, count(*) FILTER (elapsed >= 5) AS at_least_5, count(*) FILTER (elapsed >= 10) AS at_least_10, max(elapsed) AS most, round(avg(elapsed), 6) AS mean FROM b")
def speedup_counts(spark, sf_dir):
    return rounded(S.speedup_counts(bench(spark, sf_dir), "elapsed"), 6, "mean")


@query("geometric_mean", f"WITH {BENCH} SELECT solver, round(exp(avg(ln(elapsed))), 6) AS geometric_mean FROM b WHERE elapsed > 0 GROUP BY solver")
def geometric_mean(spark, sf_dir):
    return rounded(S.geometric_mean(bench(spark, sf_dir), ["solver"], "elapsed"), 6, "geometric_mean")


@query("memory_trend", f"WITH {HIST} SELECT run, arg_min(r, ts) AS first, arg_max(r, ts) AS last, max(r) AS peak, arg_max(r, ts) - arg_min(r, ts) AS growth FROM h GROUP BY run")
def memory_trend(spark, sf_dir):
    return S.trend(hist(spark, sf_dir), K, T, R)


@query("precision_usage", f"WITH {BENCH} SELECT prec, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY prec")
def precision_usage(spark, sf_dir):
    return rounded(S.usage_share(bench(spark, sf_dir), "prec"), 6, "share")


@query("reliability", f"WITH {BENCH}, r AS (SELECT prec, solver, platform, count(*) FILTER (elapsed < 4) / count(*) AS q FROM b GROUP BY ALL) SELECT prec, round(avg(q), 6) AS reliability FROM r GROUP BY prec")
def reliability(spark, sf_dir):
    tests = bench(spark, sf_dir).withColumn("ok", F.col("elapsed") < 4)
    return rounded(S.reliability(tests, ["solver", "platform"], ["prec"], "ok"), 6, "reliability")


@query("outlier_z", f"WITH {HIST}, m AS (SELECT run, avg(r) AS m, stddev_pop(r) AS s FROM h GROUP BY run) SELECT run, r, round(CASE WHEN s > 0 THEN (r - m) / s ELSE 0.0 END, 6) AS z, CASE WHEN s > 0 THEN abs((r - m) / s) > 2.5 ELSE false END AS outlier FROM h JOIN m USING (run)")
def outlier_z(spark, sf_dir):
    return rounded(S.outliers(hist(spark, sf_dir), K, R, 2.5), 6, "z").select("run", "r", "z", "outlier")


@query("error_budget", f"WITH {BENCH}, t AS (SELECT elapsed, discount, tax, sqrt(elapsed * elapsed + discount * discount + tax * tax) AS e FROM b) SELECT elapsed, discount, tax, round(e, 9) AS total_error, round(CASE WHEN e > 0 THEN elapsed * elapsed / (e * e) ELSE 0.0 END, 9) AS elapsed_share, round(CASE WHEN e > 0 THEN discount * discount / (e * e) ELSE 0.0 END, 9) AS discount_share, round(CASE WHEN e > 0 THEN tax * tax / (e * e) ELSE 0.0 END, 9) AS tax_share FROM t")
def error_budget(spark, sf_dir):
    out = S.error_budget(bench(spark, sf_dir).select("elapsed", "discount", "tax"), ["elapsed", "discount", "tax"])
    return rounded(out, 9, "total_error", "elapsed_share", "discount_share", "tax_share")


@query("complexity_label", "SELECT p_partkey, CASE WHEN p_size / 20.0 < 1.2 THEN 'linear' WHEN p_size / 20.0 < 1.6 THEN 'n log n' WHEN p_size / 20.0 < 2.2 THEN 'quadratic' ELSE 'worse than quadratic' END AS label FROM part")
def complexity_label(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.complexity(F.col("p_size") / 20.0).alias("label"))


RUNS = "r AS (SELECT solver, prec, size, avg(elapsed) AS elapsed FROM b WHERE NOT (prec = 'O' AND size > 5) GROUP BY ALL)"


def _runs(spark, sf_dir):
    return bench(spark, sf_dir).where("NOT (prec = 'O' AND size > 5)").groupBy("solver", "prec", "size").agg(F.avg("elapsed").alias("elapsed"))


@query("speedup_vs_baseline", f"WITH {BENCH}, {RUNS} SELECT a.solver, a.size, round(a.elapsed, 6) AS elapsed, round(coalesce(c.elapsed / a.elapsed, 1.0), 6) AS speedup FROM r a LEFT JOIN r c ON c.prec = 'O' AND c.solver = a.solver AND c.size = a.size WHERE a.prec = 'F'")
def speedup_vs_baseline(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    out = C.speedup_vs_baseline(runs.where("prec = 'F'").drop("prec"), runs.where("prec = 'O'").drop("prec"), ["solver", "size"], "elapsed")
    return rounded(out, 6, "elapsed", "speedup").select("solver", "size", "elapsed", "speedup")


@query("precision_pivot", f"WITH {BENCH} SELECT solver, size, round(avg(elapsed) FILTER (prec = 'F'), 6) AS F, round(avg(elapsed) FILTER (prec = 'O'), 6) AS O FROM b GROUP BY ALL")
def precision_pivot(spark, sf_dir):
    return rounded(C.precision_pivot(bench(spark, sf_dir), ["solver", "size"], "prec", "elapsed", ["F", "O"]), 6, "F", "O")


@query("regression_check", f"WITH {BENCH}, {RUNS} SELECT a.solver, a.size, round(a.elapsed, 6) AS now, round(c.elapsed, 6) AS stored, round(a.elapsed / c.elapsed, 6) AS ratio, a.elapsed / c.elapsed <= 1.01 AS ok FROM r a JOIN r c ON c.prec = 'O' AND c.solver = a.solver AND c.size = a.size WHERE a.prec = 'F'")
def regression_check(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    out = C.regression_check(runs.where("prec = 'F'").drop("prec"), runs.where("prec = 'O'").drop("prec"), ["solver", "size"], "elapsed", 1.01)
    return rounded(out, 6, "now", "stored", "ratio").select("solver", "size", "now", "stored", "ratio", "ok")


@query("speedup_first_config", f"WITH {BENCH}, r AS (SELECT solver, size, avg(elapsed) AS t FROM b GROUP BY ALL), s AS (SELECT *, first_value(t) OVER w / t AS sp, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY solver ORDER BY size)) SELECT solver, size, round(sp, 6) AS speedup, round(sp / k, 6) AS efficiency FROM s")
def speedup_first_config(spark, sf_dir):
    r = bench(spark, sf_dir).groupBy("solver", "size").agg(F.avg("elapsed").alias("t"))
    return rounded(S.first_config(r, ["solver"], "size", "t"), 6, "speedup", "efficiency").drop("t")


@query("weak_scaling", f"WITH {BENCH}, r AS (SELECT solver, size, avg(elapsed) AS t FROM b GROUP BY ALL) SELECT solver, size, round(first_value(t) OVER (PARTITION BY solver ORDER BY size) / t, 6) AS weak_efficiency FROM r")
def weak_scaling(spark, sf_dir):
    r = bench(spark, sf_dir).groupBy("solver", "size").agg(F.avg("elapsed").alias("t"))
    return rounded(S.weak_efficiency(r, ["solver"], "size", "t"), 6, "weak_efficiency").drop("t")


@query("name_matches", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%'")
def name_matches(spark, sf_dir):
    terms = spark.createDataFrame([("ring",), ("BOLT",)], "term string")
    return C.name_matches(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), terms, "p_name")


NOW = "(SELECT max(o_orderdate) FROM orders)"


def _now(spark, sf_dir):
    """The latest order date stands for the present, so that results do not drift."""
    return F.lit(_table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])


@query("latest_summary", f"WITH {BENCH} SELECT solver, prec, round(avg(elapsed), 6) AS mean, min(elapsed) AS least, max(elapsed) AS most, count(*) AS n, epoch_us(max(stamp)) AS last_at FROM b WHERE stamp > {NOW} - INTERVAL 30 DAYS GROUP BY ALL")
def latest_summary(spark, sf_dir):
    out = C.latest_summary(bench(spark, sf_dir), ["solver", "prec"], "at", "elapsed", _now(spark, sf_dir))
    return rounded(out, 6, "mean").withColumn("last_at", F.unix_micros("last_at"))


@query("daily_trend", f"WITH {BENCH} SELECT epoch_us(CAST(date_trunc('day', stamp) AS TIMESTAMP)) AS day, solver, round(avg(elapsed), 6) AS mean, count(*) AS n FROM b WHERE stamp > {NOW} - INTERVAL 90 DAYS GROUP BY ALL")
def daily_trend(spark, sf_dir):
    out = C.daily_trend(bench(spark, sf_dir), ["solver"], "at", "elapsed", _now(spark, sf_dir))
    return rounded(out, 6, "mean").withColumn("day", F.unix_micros("day"))


@query("retention_keep", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= {NOW} - INTERVAL 180 DAYS")
def retention_keep(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return C.retained(orders, "at", _now(spark, sf_dir), 180).select("o_orderkey")


@query("topk_ops", f"WITH {BENCH} SELECT platform, solver, round(sum(elapsed), 4) AS total FROM b GROUP BY ALL ORDER BY sum(elapsed) DESC LIMIT 10")
def topk_ops(spark, sf_dir):
    sums = bench(spark, sf_dir).groupBy("platform", "solver").agg(F.sum("elapsed").alias("total"))
    return rounded(sums.orderBy(F.col("total").desc(), "platform", "solver").limit(10), 4, "total")


@query("hotspots", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def hotspots(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").where("l_extendedprice > 50000")
    return rows.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(10)


@query("rank_by_gap", f"WITH {BENCH}, g AS (SELECT platform, solver, avg(elapsed) AS a FROM b GROUP BY ALL) SELECT platform, solver, round(abs(a - 3.0), 6) AS gap, CAST(row_number() OVER (ORDER BY abs(a - 3.0), platform, solver) AS INTEGER) AS place FROM g")
def rank_by_gap(spark, sf_dir):
    from pyspark.sql.window import Window

    g = bench(spark, sf_dir).groupBy("platform", "solver").agg(F.abs(F.avg("elapsed") - 3.0).alias("gap"))  # a row for each study
    return rounded(g.withColumn("place", F.row_number().over(Window.orderBy("gap", "platform", "solver"))), 6, "gap")


@query("best_device", "WITH s AS (SELECT s_nationkey, s_name, 0.6 * (1.0 - (s_suppkey % 97) / 97.0::DOUBLE) + 0.4 * ((s_suppkey % 13) / 13.0::DOUBLE) AS score FROM supplier) SELECT s_nationkey, round(max(score), 9) AS score, min(s_name) AS s_name FROM s WHERE (s_nationkey, score) IN (SELECT (s_nationkey, max(score)) FROM s GROUP BY s_nationkey) GROUP BY s_nationkey")
def best_device(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", ((F.col("s_suppkey") % 97) / 97.0).alias("load"), ((F.col("s_suppkey") % 13) / 13.0).alias("free"))
    return rounded(S.best_device(s, ["s_nationkey"], "s_name", "load", "free"), 9, "score")


@query("lru_evict", "WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS size, o_orderdate FROM orders) SELECT o_custkey, o_orderkey, CAST(size AS DOUBLE) AS size, CAST(before AS DOUBLE) AS freed_before FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) WHERE before < 500000")
def lru_evict(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("size"))
    out = C.lru_evicted(o, "o_custkey", ["o_orderdate", "o_orderkey"], "size", 500_000)
    return out.select("o_custkey", "o_orderkey", F.col("size").cast("double").alias("size"), F.col("freed_before").cast("double").alias("freed_before"))


@query("precision_cast", "SELECT vec_id, CAST(k - 1 AS INTEGER) AS place, CAST(CAST(embedding[k] AS DOUBLE) * 0.1::DOUBLE AS FLOAT) AS v FROM embeddings, range(1, 65) t(k)")
def precision_cast(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(F.transform("embedding", lambda x: (x.cast("double") * F.lit(0.1)).cast("float"))).alias("place", "v"))


@query("axpy_array", "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: CAST(z[1] AS DOUBLE) + 2.0::DOUBLE * CAST(z[2] AS DOUBLE))), 6) AS s FROM embeddings")
def axpy_array(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    summed = F.zip_with("embedding", F.reverse("embedding"), lambda a, b: a.cast("double") + F.lit(2.0) * b.cast("double"))
    return e.select("vec_id", F.round(F.aggregate(summed, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("norm_array", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def norm_array(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("norm"))
