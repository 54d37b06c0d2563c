"""Ordered scans of runs of any length, and exact order statistics, without one task for each run.

A run is cut into segments by bounds of its order column, the same for all runs. One pass
reduces each segment of each run to a row of state; a window over those few rows gives what
comes before each segment; a second pass puts that in front of the segment's rows, as a row
of its own, and scans each segment by itself. Rows are exchanged once, by run and segment, so a
single run with all rows is spread like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Segments of a run, as many at most; a bound parameter, as the bounds are part of the plan.
PARTS = 64
SEGMENT, IS_ROW = "__segment", "__is_row"
KINDS = ("min", "max", "sum", "sum_before", "count", "last", "lag", "total")


def _place(df: DataFrame, order: str) -> Column:
    kind = df.schema[order].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.unix_date(order) if kind == "date" else F.col(order)


def bounds(df: DataFrame, order: str, parts: int = PARTS) -> list:
    """At most ``parts - 1`` values of a numeric or time column that cut its rows into about equal parts."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(_place(df, order), [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    return sorted({x for x in found or [] if x == x})


def segment(place: Column, cuts: list) -> Column:
    """The number of bounds that are not above a value; 0 for null, the last for NaN. A balanced search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(place < F.lit(cuts[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(place.isNull(), F.lit(0)).otherwise(search(0, len(cuts)))


def running(df: DataFrame, keys: list[str], order: list[str], parts: int = PARTS, **wanted: tuple[str, str]) -> DataFrame:
    """Add a column ``name=(kind, column)`` for each one wanted, over each run's rows in the order given.

    ``min``, ``max``, ``sum``, ``count`` (of values) and ``last`` (value that is not null) reach from the run's first
    row to this one; ``sum_before`` stops before this row, 0 at the first; ``lag`` is the row before's value,
    ``total`` the whole run's sum. The first order column cuts the segments and must be a number or a
    time; nulls come first. Rows that are equal in all order columns come in any order. Sums of
    doubles are added segment by segment, so their last bits may differ from a plain window's.
    Null keys are a run like any other; an empty table gives none.
    """
    if bad := [k for k, _ in wanted.values() if k not in KINDS]:
        raise ValueError(f"no such scan: {bad}")
    columns = df.columns
    cut = df.withColumn(SEGMENT, segment(_place(df, order[0]), bounds(df, order[0], parts)))
    at = F.struct(*order)
    value = lambda kind, c: F.struct(c).alias(c) if kind == "lag" else F.when(F.col(c).isNotNull(), 1).otherwise(0).cast("long") if kind == "count" else F.col(c)
    rows = cut.select(*columns, SEGMENT, F.lit(1).alias(IS_ROW), *[value(kind, c).alias(f"__{n}") for n, (kind, c) in wanted.items()])

    def state(n: str, kind: str) -> Column:
        c = F.col(f"__{n}")
        if kind in ("min", "max"):
            return getattr(F, kind)(c)
        return F.max_by(c, F.when(c.isNotNull(), at)) if kind in ("last", "lag") else F.sum(c)

    states = rows.groupBy(*keys, SEGMENT).agg(*[state(n, kind).alias(f"__{n}") for n, (kind, _) in wanted.items()])
    every = Window.partitionBy(*keys)
    before = every.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)

    def carried(n: str, kind: str) -> Column:
        c = F.col(f"__{n}")
        if kind in ("last", "lag"):
            return F.last(c, ignorenulls=True).over(before)
        if kind == "total":
            return F.sum(c).over(every)
        return getattr(F, kind if kind in ("min", "max") else "sum")(c).over(before)

    ahead = states.select(*keys, SEGMENT, F.lit(0).alias(IS_ROW), *[carried(n, kind).cast(rows.schema[f"__{n}"].dataType).alias(f"__{n}") for n, (kind, _) in wanted.items()])
    both = rows.unionByName(ahead, allowMissingColumns=True)
    here = Window.partitionBy(*keys, SEGMENT)
    scan = here.orderBy(IS_ROW, *order)
    to_here = scan.rowsBetween(Window.unboundedPreceding, 0)

    def result(n: str, kind: str) -> Column:
        c = F.col(f"__{n}")
        if kind in ("min", "max", "sum", "count"):
            return getattr(F, kind if kind in ("min", "max") else "sum")(c).over(to_here)
        if kind == "sum_before":
            return F.coalesce(F.sum(c).over(scan.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(rows.schema[f"__{n}"].dataType))
        if kind == "last":
            return F.last(c, ignorenulls=True).over(to_here)
        if kind == "lag":
            return F.lag(c).over(scan)[wanted[n][1]]
        return F.max(F.when(F.col(IS_ROW) == 0, c)).over(here)

    return both.select(*columns, IS_ROW, *[result(n, kind).alias(n) for n, (kind, _) in wanted.items()]).where(f"{IS_ROW} = 1").drop(IS_ROW)


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """(keys, name…): exact percentiles of each key, interpolated between neighbours.

    Rows are counted by key and segment of the values, and only those of the segments that hold a wanted rank go on;
    there equal values are counted, and ranks come from a running sum. No task holds a key's values, and
    the other rows are never exchanged.
    Nulls do not count; a key of nulls alone has no row. Without keys, no values give one row of nulls.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    cut = rows.withColumn(SEGMENT, segment(F.col("__v"), bounds(rows, "__v", parts)))
    every = Window.partitionBy(*keys)
    sizes = cut.groupBy(*keys, SEGMENT).agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(every.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    placed = sizes.withColumn("__all", F.sum("__n").over(every)).withColumn("__ahead", ahead).withColumn("__upto", F.col("__ahead") + F.col("__n"))
    place = {name: (F.col("__all") - 1) * F.lit(float(p)) for name, p in shares.items()}
    holds = lambda rank: (rank >= F.col("__upto") - F.col("__n")) & (rank < F.col("__upto"))
    held = F.lit(False)
    for p in place.values():
        held = held | holds(F.floor(p)) | holds(F.ceil(p))
    wanted = placed.where(held).select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col(SEGMENT).alias("__in"), "__all", "__ahead")
    same = F.col(SEGMENT) == F.col("__in")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    counts = cut.join(wanted, same).groupBy(*keys, SEGMENT, "__all", "__ahead", "__v").agg(F.count(F.lit(1)).alias("__n"))
    here = Window.partitionBy(*keys, SEGMENT).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.col("__ahead") + F.sum("__n").over(here))
    ends = [f for n, p in place.items() for f in (F.max(F.when(holds(F.floor(p)), F.col("__v"))).alias(f"__a_{n}"), F.max(F.when(holds(F.ceil(p)), F.col("__v"))).alias(f"__b_{n}"))]
    found = ranked.where(held).groupBy(*keys).agg(F.max("__all").alias("__all"), *ends)
    share = {n: p - F.floor(p) for n, p in place.items()}
    return found.select(*keys, *[(F.when(share[n] == 0, F.col(f"__a_{n}")).otherwise((1 - share[n]) * F.col(f"__a_{n}") + share[n] * F.col(f"__b_{n}"))).alias(n) for n in shares])
