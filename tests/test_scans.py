import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import scans

KINDS = {"a": ("min", "v"), "b": ("max", "v"), "c": ("sum", "v"), "d": ("sum_before", "v"), "e": ("count", "v"), "f": ("last", "v"), "g": ("lag", "v"), "h": ("total", "v")}


def rows(n=600, seed=0):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([rng.randint(0, 400), rng.randint(0, 400), None]), i, rng.choice([None, *range(-20, 20)])) for i in range(n)]


def by_window(df, keys):
    w = Window.partitionBy(*keys).orderBy("t", "id")
    to_here, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", F.min("v").over(to_here).alias("a"), F.max("v").over(to_here).alias("b"), F.sum("v").over(to_here).alias("c"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("d"),
        F.count("v").over(to_here).alias("e"), F.last("v", ignorenulls=True).over(to_here).alias("f"), F.lag("v").over(w).alias("g"), F.sum("v").over(Window.partitionBy(*keys)).alias("h"))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_running_equals_the_window(spark, keys, parts):
    df = spark.createDataFrame(rows(), "k int, t int, id int, v long")
    got = scans.running(df, keys, ["t", "id"], parts, **KINDS)
    assert got.columns == ["k", "t", "id", "v", *KINDS]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(map(tuple, by_window(df, keys).collect()), key=lambda r: r[2])


def test_times_days_and_odd_numbers_order_too(spark):
    start = datetime.datetime(2024, 3, 30, 22)
    data = [(start + datetime.timedelta(minutes=17 * i), float("nan") if i % 50 == 3 else float(i * 7 % 31), i) for i in range(300)]
    df = spark.createDataFrame(data, "t timestamp, x double, v long")
    for order in ("t", "x"):
        got = scans.running(df, [], [order, "v"], 9, s=("sum", "v")).orderBy("v").collect()
        want = df.withColumn("s", F.sum("v").over(Window.orderBy(order, "v").rowsBetween(Window.unboundedPreceding, 0))).orderBy("v").collect()
        assert [r["s"] for r in got] == [r["s"] for r in want]
    days = df.select(F.to_date("t").alias("t"), "v")
    assert scans.running(days, [], ["t", "v"], 3, n=("count", "v")).agg(F.max("n")).first()[0] == 300


def test_empty_constant_and_unknown(spark):
    df = spark.createDataFrame([], "k int, t int, v long")
    assert scans.running(df, ["k"], ["t"], 8, s=("sum", "v")).count() == 0
    same = spark.range(50).selectExpr("1 k", "7 t", "id v")
    assert scans.running(same, ["k"], ["t", "v"], 8, s=("sum", "v")).agg(F.max("s")).first()[0] == 1225
    with pytest.raises(ValueError):
        scans.running(df, ["k"], ["t"], s=("median", "v"))


def test_one_run_is_spread_over_tasks_in_one_exchange(spark):
    df = spark.range(20_000).selectExpr("id t", "id % 97 v")
    got = scans.running(df, [], ["t"], 32, s=("sum", "v"), m=("max", "v"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(__segment") >= 1 and "Join" not in plan
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000


@pytest.mark.parametrize("keys", [["k"], []])
def test_order_statistics_are_exact(spark, keys):
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *([rng.random()] * 3), float(rng.randint(0, 5))])) for _ in range(900)] + [(5, None), (6, 1.5)]
    df = spark.createDataFrame(data, "k int, v double")
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = scans.order_statistics(df, keys, "v", shares, 16)
    want = df.where("v IS NOT NULL").groupBy(*keys).agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()])
    a, b = ({tuple(r[k] for k in keys): tuple(r[n] for n in shares) for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in b)
    none = scans.order_statistics(df.where("false"), keys, "v", shares).collect()
    assert none == [] if keys else [tuple(r) for r in none] == [(None,) * 5]


def test_order_statistics_exchange_only_rows_of_wanted_segments(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 20_000).cast("double").alias("v"))
    out = scans.order_statistics(rows, ["k"], "v", {"median": 0.5})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.count("Union") == 0  # rows meet the few wanted segments; nothing is scanned as a whole
    want = {k: sorted((i * 7919) % 20_000 for i in range(k, 20_000, 2)) for k in (0, 1)}
    assert {r["k"]: r["median"] for r in out.collect()} == {k: (v[4999] + v[5000]) / 2 for k, v in want.items()}
