"""Monthly benchmark report with a regression gate.

    python -m jobs.benchmark_release --runs PATH --heads PATH --out PATH [--settings FILE] [--since YYYY-MM] [--until YYYY-MM]

Reads the rows of benchmark runs and the heads that date them, and writes one row for each
month and configuration (solver, precision, platform): timing statistics with exact median and
95th percentile, throughput, the scaling exponent with its label, the ratio to the
month before with a regression mark, and the speedup over the baseline month.

Output is Parquet partitioned by month. A run replaces the months it covers and no others, so the
same call gives the same output, and a late month can be done again by itself. With ``--since`` the
scan starts one month earlier, for the ratio, beside the baseline month.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import comparison, scans, statistics

from . import settings as files

log = logging.getLogger("jobs.benchmark_release")

KEYS = ["month", "solver", "precision", "platform"]
CONFIGURATION = KEYS[1:]


@dataclass
class Settings:
    #: A month (YYYY-MM) whose means are the baseline of speedups; empty: the first month there is.
    baseline_month: str = ""
    #: A mean this many times the month before's is a regression.
    most_ratio: float = 1.2
    #: A month with fewer runs of a configuration is not judged.
    least_runs: int = 3
    #: What elapsed time is divided by to get seconds.
    time_unit: float = 9973.0

    def validate(self) -> None:
        if not self.most_ratio > 0 or self.least_runs < 1 or not self.time_unit > 0:
            raise ValueError("ratio, runs and unit are positive")
        if self.baseline_month and not (len(self.baseline_month) == 7 and self.baseline_month[4] == "-"):
            raise ValueError("months are written YYYY-MM")


def benchmark_runs(runs: DataFrame, heads: DataFrame, unit: float) -> DataFrame:
    """(month, solver, precision, platform, size, work, elapsed) of each run; runs without a date are left out."""
    dated = heads.where("o_orderdate IS NOT NULL").select("o_orderkey", F.col("o_orderpriority").alias("platform"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    rows = runs.select("l_orderkey", F.col("l_returnflag").alias("solver"), F.col("l_linestatus").alias("precision"), F.col("l_linenumber").alias("size"), F.col("l_quantity").alias("work"), (F.col("l_extendedprice") / F.lit(unit)).alias("elapsed"))
    joined = rows.join(dated, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.date_format("at", "yyyy-MM").alias("month"), *CONFIGURATION, "size", "work", "elapsed")


def month_start(month: str, shift: int = 0) -> Column:
    return F.add_months(F.to_date(F.lit(f"{month}-01")), shift).cast("timestamp_ntz")


def monthly(rows: DataFrame, baseline_month: str, s: Settings) -> DataFrame:
    """The report's rows from those of ``benchmark_runs``."""
    sized = (F.col("size") > 0) & (F.col("elapsed") > 0)
    x, y = F.when(sized, F.log("size")), F.when(sized, F.log("elapsed"))
    fit = (F.regr_slope(y, x).alias("exponent"), F.sum("work").alias("work"))
    stats = statistics.timing_moments(rows, KEYS, "elapsed", *fit)
    ranks = scans.order_statistics(rows, KEYS, "elapsed", {"median": 0.5, "p95": 0.95})
    same = F.lit(True)
    for k in KEYS:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    all_stats = stats.alias("a").join(ranks.alias("b"), same, "left").select("a.*", "b.median", "b.p95")
    all_stats = all_stats.withColumn("throughput", F.when(F.col("total") > 0, F.col("work") / F.col("total"))).withColumn("label", statistics.complexity(F.col("exponent")))
    first = F.to_date(F.concat("month", F.lit("-01")))
    w = Window.partitionBy(*CONFIGURATION).orderBy("month")
    before = F.when(F.lag(first).over(w) == F.add_months(first, -1), F.lag("mean").over(w))
    enough = (F.col("n") >= s.least_runs) & (F.when(F.col("before").isNotNull(), F.lag("n").over(w)) >= s.least_runs)
    judged = all_stats.withColumn("before", before).withColumn("ratio", F.when(enough & (F.col("before") > 0), F.col("mean") / F.col("before")))
    judged = judged.withColumn("regressed", F.coalesce(F.col("ratio") > s.most_ratio, F.lit(False)))
    return comparison.speedup_vs_baseline(judged, all_stats.where(F.col("month") == baseline_month), CONFIGURATION, "mean")


def run(spark: SparkSession, runs: str, heads: str, out: str, settings: Settings | None = None, since: str = "", until: str = "") -> dict:
    """Write the report of all months, or of those from ``since`` to ``until``; returns what was read and written."""
    s = settings or Settings()
    all_heads = spark.read.parquet(heads)
    base = s.baseline_month or all_heads.agg(F.date_format(F.min(F.col("o_orderdate").cast("timestamp_ntz")), "yyyy-MM")).first()[0] or ""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    covered = F.lit(True)
    if since:
        covered = covered & (at >= month_start(since, -1))
    if until:
        covered = covered & (at < month_start(until, 1))
    if base:
        covered = covered | ((at >= month_start(base)) & (at < month_start(base, 1)))
    rows = benchmark_runs(spark.read.parquet(runs), all_heads.where(covered), s.time_unit)
    rows = rows.persist()  # read several times below
    report = monthly(rows, base, s)
    if since:
        report = report.where(F.col("month") >= since)
    if until:
        report = report.where(F.col("month") <= until)
    report.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(out)
    rows.unpersist()
    written = read(spark, out)
    if since:
        written = written.where(F.col("month") >= since)
    if until:
        written = written.where(F.col("month") <= until)
    done = written.agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("rows"), F.count_distinct("month").alias("months"), F.count_if("regressed").alias("regressions")).first().asDict()
    log.info("read %s runs of %s and %s; wrote %s rows of %s months to %s, %s regressions, baseline %s", done["runs"] or 0, runs, heads, done["rows"], done["months"], out, done["regressions"], base)
    return done | {"baseline": base}


SCHEMA = (
    "solver string, precision string, platform string, n long, total double, mean double, least double, most double, deviation double, exponent double, work double, "
    "median double, p95 double, throughput double, label string, before double, ratio double, regressed boolean, speedup double, month string"
)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The report as it stands."""
    return spark.read.schema(SCHEMA).parquet(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("runs", "heads", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--settings")
    p.add_argument("--since", default="")
    p.add_argument("--until", default="")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("benchmark-release").getOrCreate()
    try:
        run(spark, a.runs, a.heads, a.out, files.read(Settings, a.settings), a.since, a.until)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
