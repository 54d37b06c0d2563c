"""Joins that compare runs, and the ordered and theta joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def speedup_vs_baseline(runs: DataFrame, baseline: DataFrame, keys: list[str], elapsed: str) -> DataFrame:
    """Left equi-join with the baseline's time on keys; a run without one has speedup 1."""
    base = baseline.select(*keys, F.col(elapsed).alias("__base"))
    return runs.join(base, keys, "left").withColumn("speedup", F.coalesce(F.when(F.col(elapsed) > 0, F.col("__base") / F.col(elapsed)), F.lit(1.0))).drop("__base")


def precision_pivot(runs: DataFrame, keys: list[str], precision: str, value: str, names: list[str]) -> DataFrame:
    """One row for each key with the mean value of each precision; one aggregate, no self-join."""
    return runs.groupBy(*keys).pivot(precision, names).agg(F.avg(value))


def regression_check(current: DataFrame, stored: DataFrame, keys: list[str], value: str, most: float = 1.2) -> DataFrame:
    """Ratio of each current metric to the stored one, and whether it stays within ``most``."""
    old = stored.select(*keys, F.col(value).alias("stored"))
    out = current.select(*keys, F.col(value).alias("now")).join(old, keys)
    return out.withColumn("ratio", F.when(F.col("stored") > 0, F.col("now") / F.col("stored"))).withColumn("ok", F.col("ratio") <= most)


#: Values of a short list at most: they become part of the plan.
SHORT = 1000


def short_list(values: DataFrame) -> list:
    """The distinct values of a one-column frame, checked to be few."""
    found = [r[0] for r in values.distinct().limit(SHORT + 1).collect()]
    if len(found) > SHORT:
        raise ValueError(f"more than {SHORT} values; join instead")
    return found


def name_matches(names: DataFrame, terms: DataFrame, name: str = "name", term: str = "term") -> DataFrame:
    """Names that contain any of an analyst's short list of terms, each once; for long lists, ``joins.contains_join``."""
    found = F.lit(False)
    for t in short_list(terms.where(F.col(term).isNotNull()).select(F.lower(term))):
        found = found | F.contains(F.lower(name), F.lit(t))
    return names.where(found)


def enumerate_configs(first: DataFrame, *parts: DataFrame) -> DataFrame:
    """Every combination of the rows of a frame with short lists of settings, each a one-column frame; no join."""
    out = first
    for p in parts:
        values = short_list(p)
        kind = p.schema[0].dataType.simpleString()
        listed = F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.expr(f"cast(array() as array<{kind}>)")
        out = out.withColumn(p.columns[0], F.explode(listed))
    return out


def lru_evicted(entries: DataFrame, owner: str, order: list[str], size: str, need: float) -> DataFrame:
    """The oldest entries of each owner, as long as what went before is less than ``need``."""
    before = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("freed_before", F.coalesce(F.sum(size).over(before), F.lit(0.0))).where(F.col("freed_before") < need)


def morton(i, j, bits: int = 16):
    """The two indices' bits interleaved, i in the higher place of each pair."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        bit = lambda c, s: F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1)), s)
        out = out.bitwiseOR(bit(j, 2 * k)).bitwiseOR(bit(i, 2 * k + 1))
    return out


def blocks(grid_points: DataFrame, size: int) -> DataFrame:
    """(bi, bj, i0, i1, j0, j1) half-open rectangles that cover the points."""
    named = grid_points.select(F.expr(f"cast(i div {size} as int)").alias("bi"), F.expr(f"cast(j div {size} as int)").alias("bj"), "i", "j")
    return named.groupBy("bi", "bj").agg(F.min("i").alias("i0"), (F.max("i") + 1).alias("i1"), F.min("j").alias("j0"), (F.max("j") + 1).alias("j1"))


def block_adjacency(rectangles: DataFrame) -> DataFrame:
    """Pairs of blocks that share an edge: sides are matched by equality, then their overlap is tested."""
    a = rectangles.select(*[F.col(c).alias(f"a_{c}") for c in rectangles.columns])
    b = rectangles.select(*[F.col(c).alias(f"b_{c}") for c in rectangles.columns])
    overlap = lambda p, q, r, s: (F.col(p) < F.col(s)) & (F.col(r) < F.col(q))
    along_i = a.join(b, (F.col("a_i1") == F.col("b_i0")) & overlap("a_j0", "a_j1", "b_j0", "b_j1"))
    along_j = a.join(b, (F.col("a_j1") == F.col("b_j0")) & overlap("a_i0", "a_i1", "b_i0", "b_i1"))
    return along_i.unionByName(along_j).select("a_bi", "a_bj", "b_bi", "b_bj")


def latest_summary(bench: DataFrame, keys: list[str], at: str, value: str, now, days: int = 30) -> DataFrame:
    """Mean, least, most, count and last time of each key in the last days before ``now``, a column or literal."""
    recent = bench.where(F.col(at) > now - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"), F.max(at).alias("last_at"))


def daily_trend(bench: DataFrame, keys: list[str], at: str, value: str, now, days: int = 90) -> DataFrame:
    recent = bench.where(F.col(at) > now - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(F.date_trunc("day", at).alias("day"), *keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def retained(df: DataFrame, at: str, now, days: int) -> DataFrame:
    """What a clean-up of rows older than ``days`` keeps."""
    return df.where(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"))
