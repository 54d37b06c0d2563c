"""Shared pieces: table access, lineage cuts and Arrow plumbing."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpoint, shared_dir  # noqa: F401


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; batches for Python workers are bounded in bytes, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for as long as the block lasts."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def utf8_crc32(column: str):
    """Unsigned CRC-32 of a string column's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that other columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def settled(df: DataFrame, rows_per_partition: int = 100_000) -> DataFrame:
    """A checkpoint read by as many tasks as its rows ask for, so that small steps stay small."""
    out = checkpoint(df)
    return out.coalesce(max(1, -(-out.count() // rows_per_partition)))


def slices(batch, column: int, most: int = 1 << 22):
    """Parts of a record batch, without copies, each with about ``most`` bytes of text in a column."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory of this worker to the system; workers serve many tasks of many stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A batch function for mapInArrow that gives its memory back when the task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage between the steps of a long operator.

    Spark drops shuffle files and checkpoints only of frames that were collected, and an idle
    driver may not collect for a long time.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
