"""Queries of solve records, profiles and scaling summaries over events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles as P
from .analytics import BENCH, K, LAGGED, RATIO, R, T, _table, bench, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Each user's events are a history; values are residuals, thousandths of them times, event types precisions.
RUNS = "h AS (SELECT user_id AS run, ts, value AS r, value / 1000.0::DOUBLE AS t, event_type AS prec FROM events)"
GOOD = f"q AS (SELECT *, CASE WHEN {RATIO} > 0 AND {RATIO} < 1 THEN {RATIO} END AS ratio FROM l)"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def runs(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("r"), (F.col("value") / 1000.0).alias("t"), F.col("event_type").alias("prec"))


@query("convergence_info", f"WITH {RUNS}, {LAGGED}, {GOOD} SELECT run, count(*) AS iterations, arg_max(r, ts) AS final_residual, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE coalesce(avg(CASE WHEN back <= 4 THEN ratio END), 0.0) END, 6) AS rate, round(sum(t), 6) AS total_time, round(avg(t), 6) AS mean_time, string_agg(DISTINCT prec, ',' ORDER BY prec) AS precisions, arg_max(r, ts) < 40.0 AS converged FROM q GROUP BY run")
def convergence_info(spark, sf_dir):
    return rounded(P.convergence_info(runs(spark, sf_dir), K, T, R, "t", "prec", 40.0), 6, "rate", "total_time", "mean_time")


@query("solve_profile", f"WITH {RUNS}, {LAGGED}, {GOOD} SELECT run, count(*) AS iterations, arg_max(r, ts) AS final_residual, round(coalesce(avg(ratio), 1.0), 6) AS mean_rate, round(avg(t), 6) AS mean_time, round(sum(t), 6) AS total_time, count(*) * 15 AS work_units FROM q GROUP BY run")
def solve_profile(spark, sf_dir):
    return rounded(P.solve_profile(runs(spark, sf_dir), K, T, R, "t", 4), 6, "mean_rate", "mean_time", "total_time")


@query("level_breakdown", f"WITH {BENCH}, o AS (SELECT size AS level, prec AS op, sum(elapsed) AS time FROM b GROUP BY ALL), p AS (SELECT *, sum(time) OVER (PARTITION BY level) AS level_time, sum(time) OVER () AS whole FROM o) SELECT level, op, round(time, 4) AS time, round(100 * time / level_time, 6) AS op_percent, round(level_time, 4) AS level_time, round(100 * level_time / whole, 6) AS level_percent FROM p")
def level_breakdown(spark, sf_dir):
    events = bench(spark, sf_dir).select(F.col("size").alias("level"), F.col("prec").alias("op"), "elapsed")
    return rounded(rounded(P.level_breakdown(events, "level", "op", "elapsed"), 4, "time", "level_time"), 6, "op_percent", "level_percent")


@query("cycle_stats", f"WITH {BENCH} SELECT solver, count(*) AS n, round(avg(elapsed), 6) AS mean, min(elapsed) AS least, max(elapsed) AS most, round(stddev_pop(elapsed), 6) AS deviation FROM b GROUP BY solver")
def cycle_stats(spark, sf_dir):
    return rounded(P.cycle_stats(bench(spark, sf_dir), "solver", "elapsed"), 6, "mean", "deviation")


@query("device_summary", f"WITH {BENCH} SELECT platform, solver, max(work) AS iterations, round(avg(work), 6) AS mean_iterations, max(elapsed) AS final_residual, bool_and(discount < 0.1) AS converged, count(*) AS devices FROM b WHERE size >= 6 GROUP BY platform, solver")
def device_summary(spark, sf_dir):
    infos = bench(spark, sf_dir).where("size >= 6").withColumn("converged", F.col("discount") < 0.1)
    return rounded(P.device_summary(infos, ["platform", "solver"], "work", "elapsed", "converged"), 6, "mean_iterations")


@query("pool_statistics", "SELECT round(sum(CASE WHEN value < 30 THEN 1 ELSE 0 END) / count(*), 6) AS hit_rate, round(sum(value), 4) AS size, count(*) AS blocks, count(*) FILTER (WHERE event_id % 3 = 0) AS in_use, count(*) FILTER (WHERE event_id % 3 <> 0) AS available, count(DISTINCT event_type) AS kinds, round(sum(value) / 1e6, 6) AS utilization FROM events")
def pool_statistics(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    out = P.pool_statistics(events.select((F.col("value") < 30).alias("hit")), events.select(F.col("event_type").alias("kind"), F.col("value").alias("size"), (F.col("event_id") % 3 == 0).alias("in_use")), 1e6)
    return rounded(rounded(out, 6, "hit_rate", "utilization"), 4, "size")


@query("gpu_profiles", f"WITH {BENCH}, o AS (SELECT platform || '-' || solver AS name, count(*) AS calls, sum(elapsed) AS g, sum(tax) AS c, sum(size) AS launches, sum(work) AS bytes, avg(elapsed) AS m FROM b GROUP BY ALL), p AS (SELECT *, sum(g) OVER () AS whole, row_number() OVER (ORDER BY g DESC, name) AS place FROM o) SELECT name, calls, round(g, 4) AS gpu_time, round(m, 6) AS mean_gpu_time, round(100 * g / whole, 6) AS percent, round(g / (g + c), 6) AS efficiency, round(bytes / g, 6) AS bandwidth, CAST(launches AS BIGINT) AS launches FROM p WHERE place <= 10")
def gpu_profiles(spark, sf_dir):
    events = bench(spark, sf_dir).withColumn("name", F.concat_ws("-", "platform", "solver"))
    return rounded(rounded(P.gpu_profiles(events, "name", "elapsed", "tax", "size", "work"), 6, "mean_gpu_time", "percent", "efficiency", "bandwidth"), 4, "gpu_time")


@query("gpu_efficiency", f"WITH {BENCH} SELECT round(sum(elapsed) / sum(tax), 6) AS gpu_cpu_ratio, round(sum(size) / sum(elapsed), 6) AS launches_per_second, round(count(DISTINCT solver) / sum(elapsed), 9) AS operations_per_second FROM b")
def gpu_efficiency(spark, sf_dir):
    return rounded(rounded(P.gpu_efficiency(bench(spark, sf_dir), "solver", "elapsed", "tax", "size"), 6, "gpu_cpu_ratio", "launches_per_second"), 9, "operations_per_second")


THROUGHPUT = "o AS (SELECT platform, size, sum(work) / sum(elapsed) AS throughput FROM b GROUP BY ALL), t AS (SELECT *, CASE WHEN row_number() OVER x > 1 THEN throughput / first_value(throughput) OVER x END AS ratio FROM o WINDOW x AS (PARTITION BY platform ORDER BY size))"


@query("throughput_ratios", f"WITH {BENCH}, {THROUGHPUT} SELECT platform, size, round(throughput, 6) AS throughput, round(ratio, 6) AS ratio FROM t")
def throughput_ratios(spark, sf_dir):
    return rounded(P.throughput_ratios(bench(spark, sf_dir), ["platform"], "size", "work", "elapsed"), 6, "throughput", "ratio")


@query("scaling_ranking", f"WITH {BENCH}, {THROUGHPUT}, e AS (SELECT platform, avg(ratio) AS efficiency FROM t GROUP BY platform), f AS (SELECT platform, ln(elapsed) AS y, ln(work) AS x FROM b), s AS (SELECT platform, regr_slope(y, x) AS exponent FROM f GROUP BY platform), j AS (SELECT * FROM e JOIN s USING (platform)) SELECT arg_min(platform, (-efficiency, platform)) AS best_efficiency, arg_min(platform, (efficiency, platform)) AS worst_efficiency, arg_min(platform, (exponent, platform)) AS best_exponent, arg_min(platform, (-exponent, platform)) AS worst_exponent FROM j")
def scaling_ranking(spark, sf_dir):
    return P.scaling_ranking(bench(spark, sf_dir), "platform", "size", "work", "elapsed")


@query("kind_summary", f"WITH {BENCH} SELECT solver, count(*) AS total, count(*) FILTER (WHERE discount <= 0.05) AS passed, round(avg(discount), 6) AS mean_discount, round(stddev_pop(discount), 6) AS deviation_discount, round(avg(tax), 6) AS mean_tax, round(stddev_pop(tax), 6) AS deviation_tax, round(count(*) FILTER (WHERE discount <= 0.05) / count(*), 6) AS pass_rate FROM b GROUP BY solver")
def kind_summary(spark, sf_dir):
    results = bench(spark, sf_dir).withColumn("ok", F.col("discount") <= 0.05)
    return rounded(P.kind_summary(results, "solver", "ok", ["discount", "tax"]), 6, "mean_discount", "deviation_discount", "mean_tax", "deviation_tax", "pass_rate")


LIMITS = [(1, 2.0, 8.0), (2, 4.0, 9.0), (5, 1.0, 3.0)]


@query("within_limits", f"WITH {BENCH}, m(size, target, most) AS (VALUES {', '.join(map(str, LIMITS))}) SELECT size, elapsed, elapsed <= target AS on_target, elapsed <= most AS ok FROM b JOIN m USING (size)")
def within_limits(spark, sf_dir):
    return P.within_limits(bench(spark, sf_dir), spark.createDataFrame(LIMITS, "size int, target double, most double"), "size", "elapsed")


@query("method_comparison", f"WITH {BENCH}, o AS (SELECT solver, round(avg(elapsed) FILTER (WHERE prec = 'F'), 6) AS F, round(avg(elapsed) FILTER (WHERE prec = 'O'), 6) AS O, avg(elapsed) AS m FROM b GROUP BY solver) SELECT solver, F, O, round(m, 6) AS mean, CAST(row_number() OVER (ORDER BY m, solver) AS INTEGER) AS place FROM o")
def method_comparison(spark, sf_dir):
    return rounded(P.method_comparison(bench(spark, sf_dir), "solver", "prec", "elapsed", ["F", "O"]), 6, "F", "O", "mean")


@query("precision_impact", f"WITH {BENCH}, o AS (SELECT platform, size, avg(CASE WHEN prec = 'F' THEN elapsed END) AS tf, avg(CASE WHEN prec = 'O' THEN elapsed END) AS tt, avg(CASE WHEN prec = 'F' THEN tax END) AS ef, avg(CASE WHEN prec = 'O' THEN tax END) AS eo FROM b GROUP BY ALL) SELECT platform, size, round(tf / tt, 6) AS speedup, round(eo / ef, 6) AS error_ratio FROM o WHERE tf / tt IS NOT NULL")
def precision_impact(spark, sf_dir):
    return rounded(P.precision_impact(bench(spark, sf_dir), ["platform", "size"], "prec", "elapsed", "tax", "F", "O"), 6, "speedup", "error_ratio")
