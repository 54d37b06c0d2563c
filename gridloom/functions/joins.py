"""Joins that are no equality, as equi-joins with an exact test after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each point with each interval [low, high) that holds it; whole numbers, with equal ``keys`` if any.

    An interval of n numbers belongs to the level of the next power of two and lies in at most two bins of that
    width; a point lies in one bin of each level there is, of which there are 64 at most. Bins are matched
    by equality, so a pair is found once. Nulls and empty intervals match nothing; other columns of the
    two sides need different names.
    """
    if clash := (set(points.columns) & set(intervals.columns)) - set(keys):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    span = F.col(high).cast("long") - F.col(low).cast("long")
    level = F.when(span == 1, 0).otherwise(F.length(F.bin(span - 1)))
    held = intervals.where(span > 0).withColumn("__level", level)
    bins = F.expr(f"transform(sequence(0, int(shiftright({high} - 1L, __level) - shiftright(bigint({low}), __level))), k -> shiftright(bigint({low}), __level) + k)")
    dealt = held.withColumn("__bin", F.explode(bins))
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())
    place = F.array(*[F.struct(F.lit(n).alias("__level"), F.expr(f"shiftright(bigint({at}), {n})").alias("__bin")) for n in levels]) if levels else F.expr("cast(array() as array<struct<__level:int,__bin:bigint>>)")
    spread = points.where(F.col(at).isNotNull()).select("*", F.inline(place))
    both = spread.hint("merge").join(dealt, [*keys, "__level", "__bin"])
    return both.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__level", "__bin")


def range_aggregate(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, **wanted: tuple[str, str]) -> DataFrame:
    """The points that lie in an interval [low, high), with a column ``name=(kind, column)`` over the intervals that hold each; whole numbers.

    Kinds: ``count`` (of values), ``sum``, ``min``, ``max``. The pairs are never made: an interval is cut into
    aligned blocks, at most two of each power of two, that hold each of its numbers once; blocks are aggregated, and a
    place adds up its one block of each size. The work follows points and intervals, however many hold a
    point. Nulls and empty intervals match nothing.
    """
    if bad := [k for k, _ in wanted.values() if k not in ("count", "sum", "min", "max")]:
        raise ValueError(f"no such aggregate: {bad}")
    held = intervals.select(F.col(low).cast("long").alias("__low"), F.col(high).cast("long").alias("__high"), *[F.col(c).alias(f"__{n}") for n, (_, c) in wanted.items()]).where("__low < __high")
    most = held.agg(F.max(F.length(F.bin(F.col("__high") - F.col("__low"))))).first()[0] or 0
    first, end = "-shiftright(-__low, k)", "shiftright(__high, k)"
    # of the whole blocks of a size inside the interval, an odd first and an odd end do not pair up into larger ones
    blocks = (
        f"flatten(transform(sequence(0, length(bin(__high - __low)) - 1), k -> if({first} < {end}, filter(array("
        f"if(({first} & 1L) = 1, named_struct('__level', k, '__block', {first}), null), if(({end} & 1L) = 1, named_struct('__level', k, '__block', {end} - 1), null)), b -> b is not null), "
        "cast(array() as array<struct<__level:int,__block:bigint>>))))"
    )
    names = [f"__{n}" for n in wanted]
    some = lambda kind, c, again: (F.sum(c) if again else F.count(c)) if kind == "count" else getattr(F, kind)(c)
    dealt = held.select(*names, F.inline(F.expr(blocks))).groupBy("__level", "__block").agg(F.count(F.lit(1)).alias("__rows"), *[some(kind, f"__{n}", False).alias(f"__{n}") for n, (kind, _) in wanted.items()])
    places = points.select(F.col(at).cast("long").alias("__place")).where("__place IS NOT NULL").distinct()
    asked = places.select("__place", F.explode(F.expr(f"slice(sequence(0, 63), 1, {most})")).alias("__level")).withColumn("__block", F.expr("shiftright(__place, __level)"))
    # neither side is broadcast: a file says nothing of how many blocks come from it
    found = asked.hint("merge").join(dealt, ["__level", "__block"]).groupBy("__place").agg(*[some(kind, f"__{n}", True).alias(n) for n, (kind, _) in wanted.items()])
    return points.hint("merge").join(found, F.col(at).cast("long") == F.col("__place")).drop("__place")


def contains_join(names: DataFrame, key: str, name: str, terms: DataFrame, term: str) -> DataFrame:
    """(names' columns, term): each name with each distinct term that it contains, letters in either case.

    Names are indexed by their n-grams, of three letters, or of fewer where a term is shorter. A term looks up
    the rarest of its n-grams only; what is found is tested in full. ``key`` names a row of names. Null and
    empty terms match nothing. Names and n-grams are never broadcast: a file says nothing of how many n-grams it holds,
    so the joins are named here.
    """
    wanted = terms.select(F.lower(term).alias(term)).where(F.length(term) > 0).distinct()
    sizes = sorted(r[0] for r in wanted.select(F.least(F.length(term), F.lit(3))).distinct().collect())

    def grams(c: str, n: str | int):
        return F.expr(f"transform(sequence(1, greatest(length({c}) - {n} + 1, 1)), k -> substring({c}, k, {n}))")

    low = names.where(F.length(name) > 0).select(F.col(key).alias("__key"), F.lower(name).alias("__name"))
    whole = lambda n: F.filter(grams("__name", n), lambda g: F.length(g) == n)
    every = F.array_distinct(F.concat(*[whole(n) for n in sizes])) if sizes else F.expr("cast(array() as array<string>)")
    index = low.select("__key", F.explode(every).alias("__gram"))
    asked = wanted.select(term, F.explode(F.array_distinct(grams(term, f"least(length({term}), 3)"))).alias("__gram"))
    counts = index.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = asked.join(counts.hint("merge"), "__gram", "left").groupBy(term).agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__gram"))
    found = index.hint("merge").join(rarest, "__gram").select("__key", term)
    both = names.hint("merge").join(found, names[key] == found["__key"]).drop("__key")
    return both.where(F.contains(F.lower(name), F.col(term)))
