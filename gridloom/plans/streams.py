"""Streaming monitors driven once over the events table, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import shared_dir
from ..streaming import monitor

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LIMITS = [("click", 90.0, "warning"), ("error", 50.0, "critical")]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, be it one file or a folder of part files."""
    return monitor.from_files(spark, f"{sf_dir}/events.parquet", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Everything there is now, as Parquet in the shared folder: new rows appended, or, with ``keys``, what changed in each batch.

    In the second case the query runs in update mode, so that the watermark lets go of old state; a batch
    replaces its own partition, and of each key the row of the latest batch counts.
    """
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}-progress")
    if not keys:
        writer.outputMode("append").format("parquet").option("path", place).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(place)

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(place)

    writer.outputMode("update").foreachBatch(put).start().awaitTermination()
    every = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(place)
    others = [c for c in stream.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*").select(*stream.columns)


@query("stream_alerts", "SELECT event_id, event_type AS metric, value, CASE WHEN event_type = 'click' THEN 'warning' ELSE 'critical' END AS level FROM events WHERE (event_type = 'click' AND value > 90) OR (event_type = 'error' AND value > 50)")
def stream_alerts(spark, sf_dir):
    out = monitor.alerts(_events(spark, sf_dir).withColumn("metric", F.col("event_type")), LIMITS)
    return _drained(out.select("event_id", "metric", "value", "level"))


@query("stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type AS metric, max(value) AS most, count(value) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    metrics = _events(spark, sf_dir).select("ts", F.lit("all").alias("host"), F.col("event_type").alias("metric"), "value")
    out = monitor.trailing(metrics, "1 day", "1 day")
    return _drained(out.select(F.unix_micros("start").alias("start"), "metric", "most", "n"), ("start", "metric"))


@query(
    "stream_watch",
    "WITH e AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), "
    "w AS (SELECT user_id, event_id, value, min(value) OVER o AS best, first_value(value) OVER o AS first, row_number() OVER o AS k, "
    "avg(CASE WHEN p > 0 THEN abs(value - p) / p END) OVER t AS change, "
    "arg_min(event_id, (value, event_id)) OVER o AS best_at FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id), t AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) "
    "SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(event_id AS INTEGER) AS iteration, value AS residual_norm, best, CAST(best_at AS INTEGER) AS best_at, k >= 10 AND coalesce(change < 0.9, false) AS stagnating, k >= 3 AND value > 10.0 * first AS diverging FROM w",
)
def stream_watch(spark, sf_dir):
    runs = _events(spark, sf_dir).select("ts", F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("iteration"), F.col("value").alias("residual_norm"))
    return _drained(monitor.watch(runs, 10, 0.9, 10.0))


@query(
    "stream_last_values",
    "WITH e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) "
    "SELECT event_type AS metric, CAST(count(*) AS INTEGER) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most FROM e WHERE back <= 200 GROUP BY event_type",
)
def stream_last_values(spark, sf_dir):
    """The last 200 values of every event type, held as state of a stream."""
    metrics = _events(spark, sf_dir).select("ts", F.lit("all").alias("host"), F.col("event_type").alias("metric"), "value")
    last = _drained(monitor.last_values(metrics, 200), ("host", "metric"))
    return last.select("metric", "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.array_min("values").alias("least"), F.array_max("values").alias("most"))
