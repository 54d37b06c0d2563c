import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import joins


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_range_join_finds_each_pair_once(spark, keys):
    rng = random.Random(1)
    points = [(n, rng.choice([None, *range(-60, 400)]), rng.randint(0, 1)) for n in range(150)]
    spans = [(n, low := rng.randint(-70, 390), low + rng.choice([-3, 0, 1, 1, 2, 3, 8, 9, 50, 300]), rng.randint(0, 1)) for n in range(120)] + [(900, None, 5, 0), (901, 1, None, 1), (902, -(2**61), 2**61, 0)]
    p = spark.createDataFrame(points, "p int, at long, k int")
    s = spark.createDataFrame(spans, "s int, low long, high long, k int")
    got = joins.range_join(p if keys else p.drop("k"), "at", s if keys else s.drop("k"), "low", "high", keys)
    want = sorted((a, b) for a, at, k in points for b, low, high, q in spans if None not in (at, low, high) and low <= at < high and (not keys or k == q))
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want and len(want) > 500
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert joins.range_join(p.drop("k"), "at", s.drop("k").where("false"), "low", "high").count() == 0
    with pytest.raises(ValueError):
        joins.range_join(p, "at", s, "low", "high")


def test_contains_join(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAé_%") for _ in range(n))
    names = [(n, word(rng.randint(0, 14))) for n in range(300)] + [(998, None), (999, "")]
    terms = [word(rng.randint(1, 5)) for _ in range(40)] + [None, "", "zzz", "a"]
    a, b = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = joins.contains_join(a, "id", "name", b, "term")
    want = sorted({(n, t.lower()) for n, s in names for t in terms if s and t and t.lower() in s.lower()})
    assert sorted((r["id"], r["term"]) for r in got.collect()) == want and len(want) > 100
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert joins.contains_join(a, "id", "name", b.where("false"), "term").count() == 0


def test_contains_join_broadcasts_neither_names_nor_grams(spark):
    names = spark.range(50).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    got = joins.contains_join(names, "id", "name", names.select(F.right("name", F.lit(2)).alias("term")), "term")
    assert "Broadcast" not in plan_of(got) and got.count() == 90


def test_range_aggregate_is_that_of_all_pairs_without_making_them(spark):
    rng = random.Random(3)
    points = [(n, rng.choice([None, *range(-60, 400)])) for n in range(150)]
    spans = [(rng.randint(0, 99), low := rng.randint(-70, 390), low + rng.choice([-3, 0, 1, 1, 2, 3, 8, 9, 50, 300])) for _ in range(120)] + [(900, None, 5), (901, 1, None), (-5, -(2**61), 2**61), (None, 0, 9)]
    p, s = spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "s int, low long, high long")
    got = joins.range_aggregate(p, "at", s, "low", "high", n=("count", "s"), total=("sum", "s"), least=("min", "s"), most=("max", "s"))
    held = {(a, at): [b for b, low, high in spans if None not in (b, low, high) and low <= at < high] for a, at in points if at is not None}
    assert sorted(map(tuple, got.collect())) == sorted((a, at, len(v), sum(v), min(v), max(v)) for (a, at), v in held.items())
    near = joins.range_aggregate(p, "at", s.where("s = 7"), "low", "high", n=("count", "s"))
    assert sorted(r["p"] for r in near.collect()) == sorted({a for a, at in points for b, low, high in spans if at is not None and b == 7 and low <= at < high})
    assert joins.range_aggregate(p, "at", s.where("false"), "low", "high", n=("count", "s")).count() == 0
    many = spark.range(20_000)
    full = joins.range_aggregate(many.select((F.col("id") % 10).alias("at")), "at", many.select("id", F.lit(0).alias("low"), F.lit(10).alias("high")), "low", "high", n=("count", "id"))
    assert full.where("n = 20000").count() == 20_000  # 400 million pairs
    with pytest.raises(ValueError):
        joins.range_aggregate(p, "at", s, "low", "high", n=("median", "s"))
