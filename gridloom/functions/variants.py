"""JSON columns of the result tables as VARIANT: parsed once, read by path and type, and their schema found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """The JSON text of a column as VARIANT; what is no JSON, and null, is null."""
    return df.withColumn(out or column, F.try_parse_json(column))


def extracted(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Add name: (path, type) for each field of a VARIANT column.

    A missing path, a value that cannot be cast to the type, and JSON null give null.
    """
    return df.withColumns({name: F.try_variant_get(column, path, kind) for name, (path, kind) in fields.items()})


def discovered(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, schema): the one type that fits all values of a VARIANT column; partial schemas are merged."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(column).alias("schema"))


def flattened(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep…, path, kind, text): a row for each top-level key of the objects of a VARIANT column."""
    spread = df.select(*keep, F.col(column).alias("__v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    return spread.where("key IS NOT NULL").select(*keep, F.col("key").alias("path"), F.schema_of_variant("value").alias("kind"), F.try_variant_get("value", "$", "string").alias("text"))
