"""The jobs as registered queries: each runs twice into one new folder and returns its whole output."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shared import shared_dir

from . import benchmark_release, corpus_monitor, settings

HERE = Path(__file__).parent


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = _new_folder(spark, "job1"), settings.read(benchmark_release.Settings, str(HERE / "benchmark_release.json"))
    for _ in range(2):
        benchmark_release.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet", out, s)
    return _rounded(benchmark_release.read(spark, out))


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and alerts in one table; ``output`` tells which."""
    out, s = _new_folder(spark, "job2"), settings.read(corpus_monitor.Settings, str(HERE / "corpus_monitor.json"))
    for _ in range(2):
        corpus_monitor.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/progress", s)
    groups = corpus_monitor.read(spark, out, "summary").drop("part").withColumn("output", F.lit("summary"))
    found = corpus_monitor.read(spark, out, "alerts").drop("batch").withColumn("output", F.lit("alerts"))
    return _rounded(groups.unionByName(found, allowMissingColumns=True))


JOB1_SQL = """
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, l_returnflag AS solver, l_linestatus AS precision, o_orderpriority AS platform, l_linenumber AS size, l_quantity AS work, l_extendedprice / 9973.0::DOUBLE AS elapsed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate IS NOT NULL),
s AS (SELECT month, solver, precision, platform, count(elapsed) AS n, sum(elapsed) AS total, avg(elapsed) AS mean, min(elapsed) AS least, max(elapsed) AS most, stddev_pop(elapsed) AS deviation,
  regr_slope(CASE WHEN size > 0 AND elapsed > 0 THEN ln(elapsed) END, CASE WHEN size > 0 AND elapsed > 0 THEN ln(size) END) AS exponent, sum(work) AS work,
  quantile_cont(elapsed, 0.5) AS median, quantile_cont(elapsed, 0.95) AS p95 FROM r GROUP BY ALL),
j AS (SELECT *, lag(month) OVER w AS m0, lag(mean) OVER w AS p, lag(n) OVER w AS pn FROM s WINDOW w AS (PARTITION BY solver, precision, platform ORDER BY month)),
k AS (SELECT *, CASE WHEN CAST(m0 || '-01' AS DATE) + INTERVAL 1 MONTH = CAST(month || '-01' AS DATE) THEN p END AS before FROM j),
b AS (SELECT solver, precision, platform, mean AS base FROM s WHERE month = (SELECT min(month) FROM r)),
q AS (SELECT k.*, CASE WHEN n >= 3 AND pn >= 3 AND before > 0 THEN mean / before END AS ratio, coalesce(CASE WHEN mean > 0 THEN base / mean END, 1.0) AS speedup FROM k LEFT JOIN b USING (solver, precision, platform))
SELECT month, solver, precision, platform, n, round(total, 6) AS total, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most, round(deviation, 6) AS deviation, round(exponent, 6) AS exponent, round(work, 6) AS work,
  round(median, 6) AS median, round(p95, 6) AS p95, round(CASE WHEN total > 0 THEN work / total END, 6) AS throughput,
  CASE WHEN exponent < 1.2 THEN 'linear' WHEN exponent < 1.6 THEN 'n log n' WHEN exponent < 2.2 THEN 'quadratic' ELSE 'worse than quadratic' END AS label,
  round(before, 6) AS before, round(ratio, 6) AS ratio, coalesce(ratio > 1.2, false) AS regressed, round(speedup, 6) AS speedup FROM q
"""

JOB2_SQL = r"""
WITH m AS (SELECT doc_id, source, lang, CAST(text IS NULL AS BIGINT) AS missing, strlen(coalesce(text, '')) AS bytes, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents),
d AS (SELECT *, len(l) AS lines, len(l) - len(list_distinct(l)) AS repeated, length(bin(bytes)) AS band FROM m),
g AS (SELECT source, lang, count(*) AS n, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (words = 0) AS blank, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(words) AS BIGINT) AS words, CAST(sum(lines) AS BIGINT) AS lines,
  CAST(sum(repeated) AS BIGINT) AS repeated, min(words) AS least_words, max(words) AS most_words, sum(words * words) AS squares, quantile_disc(band, 0.5) AS band FROM d GROUP BY ALL)
SELECT 'summary' AS output, source, lang, n, missing, blank, bytes, words, lines, repeated, least_words, most_words, round(words / n, 6) AS mean_words,
  round(CASE WHEN words > 0 THEN sqrt(greatest(squares::DOUBLE / n - (words / n) * (words / n), 0)) / (words / n) END, 6) AS cv, CAST(power(2, band - 1) AS BIGINT) AS typical_bytes,
  round(CASE WHEN lines > 0 THEN repeated / lines END, 6) AS repeated_share, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS level FROM g
UNION ALL BY NAME
SELECT 'alerts' AS output, doc_id, source, lang, metric, round(value, 6) AS value, level FROM (
  SELECT doc_id, source, lang, 'bytes' AS metric, bytes::DOUBLE AS value, 'warning' AS level FROM d WHERE bytes > 20000
  UNION ALL SELECT doc_id, source, lang, 'repeated_share', repeated / lines, 'critical' FROM d WHERE lines > 0 AND repeated / lines > 0.5
  UNION ALL SELECT doc_id, source, lang, 'blank', 1, 'warning' FROM d WHERE words = 0)
"""

QUERIES = {"job1_benchmark_release": job1, "job2_corpus_monitor": job2}
ORACLES = {"job1_benchmark_release": JOB1_SQL, "job2_corpus_monitor": JOB2_SQL}
