import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import comparison as C
from gridloom.functions import convergence as V
from gridloom.functions import statistics as S


@pytest.fixture(scope="module")
def history(spark):
    rows = [("good", n, 0.5**n) for n in range(20)] + [("flat", n, 1.0) for n in range(20)] + [("bad", n, 10.0**n) for n in range(8)] + [("odd", 0, 0.0), ("odd", 1, 1.0)]
    return spark.createDataFrame(rows, "run string, k int, r double").cache()


ARGS = (["run"], "k", "r")


def by_run(df, column):
    return {r["run"]: r[column] for r in df.collect()}


def test_ratios_and_rates(history):
    got = {(r["run"], r["k"]): r for r in V.rate_window(history, *ARGS).collect()}
    assert got["good", 3]["ratio"] == 0.5 and got["odd", 1]["ratio"] is None and got["good", 0]["ratio"] is None
    assert got["good", 10]["rate"] == 0.5 and got["good", 4]["rate"] == 0.0 and got["bad", 7]["rate"] == 1.0


def test_tails(history):
    rate = {r["run"]: (r["rate"], r["label"]) for r in V.asymptotic_rate(history, *ARGS).collect()}
    assert rate["good"] == (0.5, "linear") and rate["flat"] == (1.0, "stagnating") and "bad" not in rate
    assert by_run(V.asymptotic_fit(history, *ARGS), "factor")["good"] == pytest.approx(0.5)
    stuck = by_run(V.stagnation(history, *ARGS), "stagnating")
    assert stuck["flat"] and not stuck["good"]


def test_monitors(history):
    assert {r["run"] for r in V.divergence(history, *ARGS).where("diverging").collect()} == {"bad"}
    assert {r["run"] for r in V.promotion(history, *ARGS).where("promote").collect()} == {"flat", "bad"}
    assert by_run(V.switch_precision(history, *ARGS), "switch_at") == {"flat": 9}
    assert {r["run"] for r in V.monitor_stagnation(history, *ARGS).where("stagnant").collect()} == {"flat"}
    assert {r["run"] for r in V.stall(history, ["run"], "k", "r", 10).where("stalled").collect()} == {"flat"}
    assert {r["run"] for r in V.preconditioner_switch(history, *ARGS).where("switch").collect()} == {"flat", "bad"}
    best = {r["run"]: (r["best"], r["best_at"]) for r in V.best_so_far(history, *ARGS).collect()}
    assert best["flat"] == (1.0, 0) and best["good"] == (0.5**19, 19)
    assert V.last_rows(history, ["run"], "k", 3).count() == 3 + 3 + 3 + 2


def test_fit_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    x = np.array([0.1, 0.05, 0.025, 0.0125, 0.00625])
    y = 3 * x**2 * np.exp(0.05 * rng.standard_normal(5))
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(x, y)] + [("p", 1.0, 0.0), ("p", 0.5, float("nan"))][:1], "k string, x double, y double")
    r = V.loglog_fit(df, ["k"], "x", "y").first()
    slope, intercept = np.polyfit(np.log(x), np.log(y), 1)
    off = np.log(y) - slope * np.log(x) - intercept
    err = math.sqrt((off**2).sum() / 3 / ((np.log(x) - np.log(x).mean()) ** 2).sum())
    assert (r["slope"], r["intercept"], r["stderr"]) == pytest.approx((slope, intercept, err))
    assert r["t_margin"] == pytest.approx(3.1824463 * err) and r["n"] == 5
    order = [o["order"] for o in V.orders(df.where("y > 0"), ["k"], "x", "y").orderBy(F.desc("x")).collect()]
    assert order[0] is None and order[1] == pytest.approx(math.log(y[0] / y[1]) / math.log(2))


def test_statistics(spark):
    v = [1.0, 2.0, 4.0, 8.0, 100.0]
    df = spark.createDataFrame([("a", x, i) for i, x in enumerate(v)], "k string, v double, i int")
    r = S.timing_stats(df, ["k"], "v").first()
    assert (r["median"], r["p95"], r["deviation"]) == pytest.approx((4.0, np.percentile(v, 95), np.std(v)))
    assert S.share_of_total(df, ["k"], "v").first()["share"] == 1.0
    assert S.trend(df, ["k"], "i", "v").first()["growth"] == 99.0
    assert S.geometric_mean(df, ["k"], "v").first()["geometric_mean"] == pytest.approx(np.exp(np.mean(np.log(v))))
    assert S.mean_interval(df, ["k"], "v").first()["half_width"] == pytest.approx(2.77644511 * np.std(v, ddof=1) / math.sqrt(5))
    names = spark.createDataFrame([("level_0_smooth", 1.0), ("level_2_coarse_solve", 2.0), ("other", 3.0)], "n string, v double")
    assert {(r["level"], r["op"], r["total"]) for r in S.level_rollup(names, "n", "v").collect()} == {(0, "smooth", 1.0), (2, "coarse_solve", 2.0)}
    budget = S.error_budget(spark.createDataFrame([(3.0, 4.0)], "a double, b double"), ["a", "b"]).first()
    assert budget["total_error"] == 5.0 and budget["a_share"] == pytest.approx(0.36)
    dev = spark.createDataFrame([("x", 0.5, 0.5), ("y", 0.1, 0.2), ("a", 0.5, 0.5)], "name string, l double, f double")
    assert S.best_device(dev, [], "name", "l", "f").first()["name"] == "y"
    assert S.complexity(F.lit(1.5)) is not None


def test_comparisons(spark):
    runs = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 0.0)], "size int, t double")
    base = spark.createDataFrame([(1, 4.0)], "size int, t double")
    assert [r["speedup"] for r in C.speedup_vs_baseline(runs, base, ["size"], "t").orderBy("size").collect()] == [2.0, 1.0, 1.0]
    assert C.regression_check(runs, base, ["size"], "t").first()["ok"]
    assert C.morton(F.lit(3), F.lit(5), 4) is not None
    assert spark.range(1).select(C.morton(F.lit(3), F.lit(5), 4)).first()[0] == 0b011011
    lru = spark.createDataFrame([("o", n, 10.0) for n in range(6)], "own string, n int, size double")
    assert [r["n"] for r in C.lru_evicted(lru, "own", ["n"], "size", 25.0).orderBy("n").collect()] == [0, 1, 2]
    now = dt.datetime(2024, 3, 1)
    rows = spark.createDataFrame([("a", now - dt.timedelta(days=d), 1.0 * d) for d in (1, 29, 31, 95)], "k string, at timestamp, v double")
    assert C.latest_summary(rows, ["k"], "at", "v", F.lit(now)).first()["n"] == 2
    assert C.daily_trend(rows, ["k"], "at", "v", F.lit(now)).count() == 3
    assert C.retained(rows, "at", F.lit(now), 31).count() == 3
