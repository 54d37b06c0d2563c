"""Incremental monitor of a table of texts.

    python -m jobs.corpus_monitor --documents PATH --out PATH --checkpoint PATH [--settings FILE]

A file stream takes the files that have come since the last call (``availableNow``, its progress in the
checkpoint), measures every text, and writes for each batch partial sums and the alerts of texts beyond a
limit; then the summary is made anew from all partial sums, which are few. Measures are bytes, words,
lines that are not empty, and how many of those repeat an earlier line of the same text.

    out/partials   batch=N/   sums by source, language and size band
    out/alerts     batch=N/   doc_id, source, lang, metric, value, level
    out/summary    part=LANG/ one row for each source and language

A batch that is taken again after a failure has the same number and the same files, and replaces its own
partitions; a call with nothing new writes the same summary again. Null and empty texts count as blank,
null as missing too; null sources and languages are groups of their own.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.streaming import monitor

from . import settings as files

log = logging.getLogger("jobs.corpus_monitor")

PARTIALS = "source string, lang string, band int, n long, missing long, blank long, bytes long, words long, squares decimal(38,0), lines long, repeated long, least_words long, most_words long, batch long"
ALERTS = "doc_id long, source string, lang string, metric string, value double, level string, batch long"
SUMMARY = "source string, lang string, n long, missing long, blank long, bytes long, words long, lines long, repeated long, least_words long, most_words long, mean_words double, cv double, typical_bytes long, repeated_share double, part string"


@dataclass
class Settings:
    #: (metric, above, level); metrics are bytes, words, blank (0 or 1) and repeated_share.
    limits: list = field(default_factory=lambda: [["bytes", 20000.0, "warning"], ["repeated_share", 0.5, "critical"], ["blank", 0.5, "warning"]])
    #: Files of a batch at most.
    files_per_batch: int = 1000

    def validate(self) -> None:
        known = ("bytes", "words", "blank", "repeated_share")
        if any(len(x) != 3 or x[0] not in known for x in self.limits):
            raise ValueError(f"limits are (metric, above, level) of {known}")
        if self.files_per_batch < 1:
            raise ValueError("a batch has at least one file")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, missing, bytes, words, lines, repeated) of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").isNull().cast("long").alias("missing"), text.alias("t"))
    rows = rows.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x != ""))
    words = F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    lines = F.size("l").cast("long")
    return rows.select("doc_id", "source", "lang", "missing", F.octet_length("t").cast("long").alias("bytes"), words.alias("words"), lines.alias("lines"), (lines - F.size(F.array_distinct("l"))).alias("repeated"))


def partial_sums(rows: DataFrame) -> DataFrame:
    """Sums that add up over batches, by source, language and band: texts of 2^(band-1) bytes up to twice that."""
    words = F.col("words").cast("decimal(19,0)")
    return rows.groupBy("source", "lang", F.length(F.bin("bytes")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"), F.count_if(F.col("words") == 0).alias("blank"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"),
        F.sum(words * words).cast("decimal(38,0)").alias("squares"), F.sum("lines").alias("lines"), F.sum("repeated").alias("repeated"), F.min("words").alias("least_words"), F.max("words").alias("most_words"),
    )


def alerts(rows: DataFrame, limits: list) -> DataFrame:
    """A row for each text and metric beyond its limit."""
    share = F.when(F.col("lines") > 0, F.col("repeated") / F.col("lines")).otherwise(0.0)
    values = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in (("bytes", F.col("bytes")), ("words", F.col("words")), ("blank", (F.col("words") == 0).cast("int")), ("repeated_share", share))])
    named = rows.select("doc_id", "source", "lang", F.inline(values))
    return monitor.alerts(named, [tuple(x) for x in limits])


def summary(partials: DataFrame) -> DataFrame:
    """One row for each source and language from the partial sums of all batches."""
    keys = ["source", "lang"]
    sums = ["n", "missing", "blank", "bytes", "words", "squares", "lines", "repeated"]
    bands = partials.groupBy(*keys, "band").agg(*[F.sum(c).alias(c) for c in sums], F.min("least_words").alias("least_words"), F.max("most_words").alias("most_words"))
    w = Window.partitionBy(*keys)
    reached = F.sum("n").over(w.orderBy("band")) * 2 >= F.sum("n").over(w)
    whole = bands.withColumn("typical", F.when(reached, F.col("band"))).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.min("least_words").alias("least_words"), F.max("most_words").alias("most_words"), F.min("typical").alias("band"))
    mean = F.col("words") / F.col("n")
    variance = F.greatest(F.col("squares").cast("double") / F.col("n") - mean * mean, F.lit(0.0))
    return whole.select(
        *keys, *[F.col(c).cast("long").alias(c) for c in sums if c != "squares"], "least_words", "most_words", mean.alias("mean_words"), F.when(mean > 0, F.sqrt(variance) / mean).alias("cv"),
        F.pow(F.lit(2.0), F.col("band") - 1).cast("long").alias("typical_bytes"), F.when(F.col("lines") > 0, F.col("repeated") / F.col("lines")).alias("repeated_share"),
        F.when(F.coalesce(F.col("lang"), F.lit("")) == "", "none").otherwise(F.col("lang")).alias("part"),
    )


def _replace(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: Settings | None = None) -> dict:
    """Take what is new, write it, and make the summary anew; returns what was read and written by this call."""
    s = settings or Settings()
    for name, schema in (("partials", PARTIALS), ("alerts", ALERTS)):  # so that they can be read before there are rows
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{out}/{name}")
    done = {"batches": 0, "documents": 0, "alerts": 0}

    def take(df: DataFrame, batch: int) -> None:
        rows = measured(df).persist()
        try:
            _replace(partial_sums(rows).withColumn("batch", F.lit(batch).cast("long")).coalesce(1), f"{out}/partials", "batch")
            _replace(alerts(rows, s.limits).withColumn("batch", F.lit(batch).cast("long")), f"{out}/alerts", "batch")
        finally:
            rows.unpersist()
        n = read(spark, out, "partials").where(F.col("batch") == batch).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found = read(spark, out, "alerts").where(F.col("batch") == batch).count()
        done["batches"], done["documents"], done["alerts"] = done["batches"] + 1, done["documents"] + n, done["alerts"] + found
        log.info("batch %s: read %s documents of %s, wrote %s alerts", batch, n, documents, found)

    stream = monitor.from_files(spark, documents, spark.read.parquet(documents).schema, maxFilesPerTrigger=s.files_per_batch)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    _replace(summary(read(spark, out, "partials")).repartition("part"), f"{out}/summary", "part")
    rows = read(spark, out, "summary").agg(F.count(F.lit(1)), F.sum("n")).first()
    done |= {"groups": rows[0], "documents_so_far": rows[1] or 0}
    log.info("read %s new documents in %s batches, wrote %s alerts; summary of %s documents in %s groups at %s/summary", done["documents"], done["batches"], done["alerts"], done["documents_so_far"], rows[0], out)
    return done


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the outputs as it stands: partials, alerts or summary."""
    return spark.read.schema({"partials": PARTIALS, "alerts": ALERTS, "summary": SUMMARY}[name]).parquet(f"{out}/{name}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--settings")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("corpus-monitor").getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, files.read(Settings, a.settings))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
