"""The results database as tables: schemas, reading, appending, export and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "benchmark_results": "created_at timestamp, benchmark_name string, problem_size string, grid_dimensions string, solver_type string, precision_mode string, platform string, execution_time_seconds decimal(12,6), memory_usage_mb int, iterations_count int, final_residual double, convergence_rate decimal(8,6), energy_consumption_joules decimal(12,3), gpu_utilization_percent decimal(5,2), cpu_utilization_percent decimal(5,2), metadata string",
    "performance_profiles": "created_at timestamp, profile_name string, solver_config string, performance_data string, system_info string, tags array<string>",
    "validation_results": "created_at timestamp, test_name string, test_category string, problem_description string, grid_size string, analytical_solution string, numerical_solution_hash string, l2_error double, max_error double, convergence_order decimal(8,4), validation_status string, error_analysis string, statistical_data string",
    "system_metrics": "recorded_at timestamp, hostname string, cpu_usage_percent decimal(5,2), memory_usage_percent decimal(5,2), memory_available_mb long, gpu_count int, gpu_memory_usage_mb array<int>, gpu_utilization_percent array<decimal(5,2)>, disk_usage_percent decimal(5,2), network_io_mb decimal(12,3), temperature_celsius decimal(5,2), power_consumption_watts decimal(8,2)",
    "experiments": "created_at timestamp, updated_at timestamp, experiment_name string, description string, parameters string, results string, status string, start_time timestamp, end_time timestamp, duration_seconds int, created_by string, tags array<string>",
}
TIME = {name: "recorded_at" if name == "system_metrics" else "created_at" for name in SCHEMAS}
#: How many of the asked days each table is kept, as a function of the days.
KEEP_DAYS = {"benchmark_results": lambda n: n, "system_metrics": lambda n: min(n, 30), "validation_results": lambda n: 2 * n}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table, without a scan of its files for a schema; days that a filter excludes are not opened."""
    return spark.read.schema(SCHEMAS[name] + ", day date").parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    """Rows added under the table's schema, partitioned by day, sorted by time within files."""
    columns = [c.strip().split(" ")[0] for c in _columns(SCHEMAS[name])]
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], SCHEMAS[name]).schema}
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]).withColumn("day", F.to_date(TIME[name]))
    out.repartition("day").sortWithinPartitions(TIME[name]).write.mode("append").partitionBy("day").parquet(f"{root}/{name}")


def _columns(ddl: str) -> list[str]:
    """Column definitions of a DDL string, split at commas outside brackets."""
    out, depth, at = [], 0, 0
    for n, c in enumerate(ddl):
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            out.append(ddl[at:n])
            at = n + 1
    return [*out, ddl[at:]]


def clean_up(spark: SparkSession, root: str, name: str, days: int, now) -> int:
    """Drop rows older than the table's share of ``days``; the number dropped.

    The day of the limit is replaced by what it keeps, in one dynamic overwrite; only then whole days
    before it are removed. A failure in between leaves rows too many, never too few.
    """
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {KEEP_DAYS.get(name, lambda n: n)(days)} DAYS")
    table = read(spark, root, name)
    count = table.where((F.col("day") <= F.to_date(limit)) & (F.col(TIME[name]) < limit)).count()
    if not count:
        return 0
    edge = spark.range(1).select(F.to_date(limit).cast("string")).first()[0]
    staged = f"{root}/_{name}_edge"
    table.where((F.col("day") == F.to_date(limit)) & (F.col(TIME[name]) >= limit)).write.mode("overwrite").parquet(staged)
    kept = spark.read.parquet(staged)
    gone = "<="
    if not kept.isEmpty():
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/{name}")
        gone = "<"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = path(f"{root}/{name}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.listStatus(place):  # folders, one a day
        day = found.getPath().getName().removeprefix("day=")
        if found.isDirectory() and (day < edge or gone == "<=" and day == edge):
            files.delete(found.getPath(), True)
    files.delete(path(staged), True)
    return count


def save_baseline(metrics: DataFrame, path: str) -> None:
    """A baseline (metric, value) as JSON lines, for later runs to be held against."""
    metrics.select("metric", F.col("value").cast("double").alias("value")).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of a stored baseline; no rows where there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "metric string, value double")
    return spark.read.schema("metric string, value double").json(path)


def system_info(spark: SparkSession) -> DataFrame:
    """One row on the driver's machine and the cluster's cores, to be stored beside results; memory where it can be read."""
    import os
    import platform

    pages = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else None
    row = (platform.system(), platform.version(), platform.python_version(), platform.machine(), os.cpu_count(), pages, spark.version, spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([row], "platform string, platform_version string, python_version string, machine string, logical_cores int, memory long, spark_version string, cluster_cores int")


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as JSON lines, CSV with a header, or Parquet; NaN becomes null."""
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    if kind == "csv":
        nested = [c for c, t in clean.dtypes if t.startswith(("array", "map", "struct"))]
        clean.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)
    elif kind in ("json", "parquet"):
        getattr(clean.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"no such format: {kind}")


def export_benchmarks(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Results and summary as CSV, and all with the system's information as one JSON document, beside each other.

    ``path/results`` and ``path/summary`` are CSV folders, ``path/benchmark`` one JSON line with ``system_info``,
    ``summary`` and the number of results; results themselves stay out of it, as they may be many.
    """
    export(results, f"{path}/results", "csv")
    export(summary, f"{path}/summary", "csv")
    info = system_info(results.sparkSession).select(F.struct("*").alias("system_info"))
    listed = summary.limit(10_000).agg(F.collect_list(F.struct("*")).alias("summary"))
    count = results.agg(F.count(F.lit(1)).alias("results"))
    info.join(listed).join(count).coalesce(1).write.mode("overwrite").json(f"{path}/benchmark")  # one row each


def export_suite(results: DataFrame, summary: DataFrame, path: str) -> None:
    """A validation suite's results as JSON lines and its report as a text file, written by Spark."""
    export(results, f"{path}/results", "json")
    text = report(summary, "Validation summary") + "\n" + report(results, "Tests")
    results.sparkSession.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def clean_streams(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ("stream-", "wavelet-", "pipeline-", "job1-", "job2-")) -> int:
    """Remove the folders under ``root`` that queries left for their results; the number removed."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(place) if f.isDirectory() and f.getPath().getName().startswith(prefixes)] if files.exists(place) else []
    for f in found:
        files.delete(f, True)
    return len(found)


def report(df: DataFrame, title: str, most: int = 200) -> str:
    """A short table as text; at most ``most`` rows come to the driver."""
    rows = df.limit(most).collect()
    shown = [[f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[n]) for r in shown)]) for n, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(df.columns), *map(line, shown)]) + "\n"
