"""Rules with odd input: NaN, infinity, short runs, stretched grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import convergence as V
from gridloom.functions import kernels
from gridloom.functions import statistics as S
from gridloom.functions import student
from gridloom.grid import Grid
from gridloom.operators import solvers
from gridloom.operators.preconditioners import Diagonal

HISTORY = "run string, k int, r double"
NAN, INF = float("nan"), float("inf")


def by_run(spark, **runs):
    return spark.createDataFrame([(n, k, float(r)) for n, rs in runs.items() for k, r in enumerate(rs)], HISTORY)


def test_rate_window(spark):
    df = by_run(spark, short=[8, 4, 2, 1, 0.5], long=[32, 16, 8, 4, 2, 1, 2], flat=[1] * 7, zero=[1, 0, 0, 0, 0, 0, 0])
    got = {(r["run"], r["k"]): r["rate"] for r in V.rate_window(df, ["run"], "k", "r").collect()}
    assert [got["short", k] for k in range(5)] == [0.0] * 5
    assert got["long", 5] == 0.5 and got["long", 6] == 0.5  # the growing step does not count
    assert got["flat", 6] == 1.0 and got["zero", 6] == 1.0


def test_monitor_rules(spark):
    df = by_run(spark, still=[1.0] * 12, moving=[0.5**k for k in range(12)], up=[1, 2, 3000, 1, 1, 1], short=[1.0] * 5)
    still = {(r["run"], r["k"]): r["stagnant"] for r in V.monitor_stagnation(df, ["run"], "k", "r").collect()}
    assert still["still", 9] and not still["still", 8] and not still["moving", 11] and not still["short", 4]
    up = {(r["run"], r["k"]): r["diverging"] for r in V.divergence(df, ["run"], "k", "r").collect()}
    assert up["up", 2] and not up["up", 1] and not up["up", 3]


def test_fits_leave_out_what_is_not_finite(spark):
    rows = [("a", float(x), float(x) ** 2) for x in (1, 2, 4, 8, 16)]
    odd = [("a", 3.0, NAN), ("a", 3.0, INF), ("a", NAN, 1.0), ("a", INF, 1.0), ("a", 0.0, 1.0), ("a", 2.0, -1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows + odd, "run string, x double, y double")
    (r,) = V.loglog_fit(df, ["run"], "x", "y").collect()
    assert r["n"] == 5 and math.isclose(r["slope"], 2) and math.isclose(r["r2"], 1) and r["margin"] < 1e-6
    (m,) = S.geometric_mean(df.where("x = 3 or x = 2"), ["run"], "y").collect()
    assert math.isclose(m["geometric_mean"], 4)
    fit = V.asymptotic_fit(by_run(spark, a=[*(0.5**k for k in range(12)), INF, NAN]), ["run"], "k", "r").collect()
    assert math.isclose(fit[0]["factor"], 0.5) and fit[0]["n"] == 12


def test_scaled_diagonal(spark):
    for grid, factor in ((Grid(9, 9), 1.0), (Grid(9, 9, 0, 1, 0, 1.05), 1.0), (Grid(9, 9, 0, 1, 0, 4), 1.5 * 2), (Grid(9, 9, 0, 4, 0, 1), 1.5 * 2)):
        r = grid.points(spark).select("i", "j", F.lit(3.0).alias("r"))
        z = {(x["i"], x["j"]): x["z"] for x in Diagonal(grid, 1.5).apply(r).collect()}
        assert math.isclose(z[4, 4], factor * 3.0 / grid.diagonal) and z[0, 4] == 3.0


def test_adaptive_switches_on_five_slow_ratios():
    g = Grid(17, 17)
    f = np.zeros((17, 17))
    f[1:-1, 1:-1] = np.random.default_rng(0).standard_normal((15, 15))
    _, rows = solvers.solve_array(np.zeros((17, 17)), f, g, "adaptive", 1e-12, 60)
    first = next(n for n, _, p in rows if p == "double")
    norms = [v for n, v, _ in rows]
    assert first > 10
    for n in range(10, first):  # the switch comes at the first iteration whose last five ratios are slow, never before the tenth
        slow = np.mean([norms[k] / norms[k - 1] for k in range(n - 5, n)]) >= 0.95
        assert slow == (n == first - 1)
    assert norms[-1] < 1e-12


def test_cycle_kinds():
    assert [kernels.calls("F", n) for n in (2, 3, 4)] == [["F"], ["F"] * 2, ["F"] * 4]
    assert kernels.calls("FV", 5) == ["FV", "V"]
    g = Grid(33, 33)
    f = np.zeros((33, 33))
    f[1:-1, 1:-1] = 1.0
    norms = {}
    for kind in ("V", "W", "F", "FV"):
        _, rows = solvers.solve_array(np.zeros((33, 33)), f, g, kind, 1e-9, 30)
        norms[kind] = len(rows)
        assert rows[-1][1] < 1e-9
    assert norms["F"] <= norms["W"] <= norms["V"] and norms["FV"] <= norms["V"]


def test_unknown_kind():
    with pytest.raises(KeyError):
        kernels.calls("X", 3)


def test_tiled_red_black_and_residual(spark):
    from gridloom.operators import smoothers

    g = Grid(17, 13, 0, 1, 0, 2)
    rng = np.random.default_rng(3)
    u, f = rng.standard_normal((17, 13)), rng.standard_normal((17, 13))
    df = spark.createDataFrame([(i, j, float(u[i, j]), float(f[i, j])) for i in range(17) for j in range(13)], "i int, j int, u double, f double")
    want = u
    for _ in range(2):
        want = kernels.red_black(want, f, g, shift=0.5)
    r = kernels.residual(want, f, g, 0.5)
    for tile in (5, 7, 64):
        got = smoothers.tiled(df, g, 2, tile, 1.0, shift=0.5, kind="red_black", residual="r").collect()
        assert len(got) == 17 * 13 and all(math.isclose(x["u"], want[x["i"], x["j"]], abs_tol=1e-12) and math.isclose(x["r"], r[x["i"], x["j"]], abs_tol=1e-9) for x in got)


def test_dropped_couplings_still_precondition():
    g = Grid(17, 17, 0, 1, 0, 3)
    f = np.zeros((17, 17))
    f[1:-1, 1:-1] = np.random.default_rng(1).standard_normal((15, 15))
    assert np.array_equal(kernels.ilu0(g), kernels.ilu0(g, drop=0.0))
    steps = {}
    for drop in (0.0, 0.2, 10.0):  # none, the weak direction, all
        pivot = kernels.ilu0(g, drop=drop)
        _, norms = kernels.conjugate_gradients(np.zeros_like(f), f, g, lambda r, d=drop, p=pivot: kernels.ilu_apply(r, g, p, d), 1e-10, 200)
        steps[drop] = len(norms)
        assert norms[-1] < 1e-10
    assert steps[0.0] <= steps[0.2] <= steps[10.0]
    assert np.allclose(kernels.ilu0(g, drop=10.0), g.diagonal)


def test_baseline_and_system_info(spark, tmp_path):
    from gridloom.functions.comparison import regression_check
    from gridloom.sources import tables

    path = str(tmp_path / "baseline")
    assert tables.read_baseline(spark, path).count() == 0
    tables.save_baseline(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, value double"), path)
    now = spark.createDataFrame([("a", 1.1), ("b", 3.0), ("c", 1.0)], "metric string, value double")
    got = {r["metric"]: r["ok"] for r in regression_check(now, tables.read_baseline(spark, path), ["metric"], "value").collect()}
    assert got == {"a": True, "b": False}
    (row,) = tables.system_info(spark).collect()
    assert row["spark_version"] == spark.version and row["logical_cores"] > 0


def test_3d_memory_stops_below_a_thousand_points(spark):
    from gridloom.functions.profiles import memory_3d

    rows = {r["nx"]: r for r in memory_3d(spark.createDataFrame([(9, 9, 9), (65, 65, 65)], "nx int, ny int, nz int")).collect()}
    points, total, levels = 65**3, 0, 0
    while True:
        total, levels = total + points * 32, levels + 1
        points //= 8
        if points < 1000:
            break
    assert (rows[65]["levels"], rows[65]["mb"]) == (levels, total / 2**20) and rows[9]["levels"] == 1


def test_tails_are_cut_before_changes_are_taken(spark):
    runs = dict(drop=[100.0, 50.0, 1.0, 1.0, 1.0], four=[1.0, 1.0, 1.0, 1.0], zeros=[1.0, 1.0, 0.0, 0.0, 0.0], slow=[5.0, 5.0, 1.0, 0.9995, 0.999], fast=[8.0, 4.0, 2.0, 1.0, 0.5])
    got = {r["run"]: r for r in V.stagnation(by_run(spark, **runs), ["run"], "k", "r").collect()}
    assert "four" not in got and got["drop"]["change"] == 0 and got["drop"]["stagnating"] and got["drop"]["slow"]
    assert got["zeros"]["change"] is None and got["zeros"]["stagnating"] is None and got["zeros"]["slow"] is None
    assert got["slow"]["slow"] and not got["slow"]["stagnating"] and got["fast"]["change"] == 0.5 and not got["fast"]["slow"]


def test_zeros_count_in_the_asymptotic_fit(spark):
    halves = [0.5**k for k in range(8)]
    got = {r["run"]: r for r in V.asymptotic_fit(by_run(spark, zeros=halves + [0.0] * 4, flat=[2.0] * 10, nine=halves + [0.1], least=halves + [-1.0, 0.25, 0.125]), ["run"], "k", "r").collect()}
    y = [math.log(r + 1e-16) for r in [0.5**6, 0.5**7, 0, 0, 0, 0]]
    x = range(6)
    slope = sum((a - 2.5) * b for a, b in zip(x, y)) / sum((a - 2.5) ** 2 for a in x)
    assert got["zeros"]["n"] == 12 and math.isclose(got["zeros"]["factor"], math.exp(slope)) and got["zeros"]["factor"] < 0.001
    assert got["flat"]["r2"] == 0 and math.isclose(got["flat"]["factor"], 1) and "nine" not in got and got["least"]["n"] == 10


def test_student(spark):
    """Against closed forms and the integral of the density."""
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 7, 30, 31, 250, 10**7, 0)], "v double")
    for confidence in (0.5, 0.95, 0.999):
        rows = df.select("v", student.quantile(F.col("v"), confidence).alias("t")).withColumn("p", student.two_sided(F.col("t"), F.col("v"))).collect()
        assert all(abs(r["p"] - (1 - confidence)) < 1e-10 for r in rows if r["v"] >= 1)
        assert rows[-1]["t"] is None and rows[-1]["p"] is None
    t = {r["v"]: r["t"] for r in df.select("v", student.quantile(F.col("v")).alias("t")).collect()}
    assert math.isclose(t[1.0], 12.706204736, rel_tol=1e-9) and math.isclose(t[31.0], 2.0395134464, rel_tol=1e-9) and math.isclose(t[1e7], 1.959963985, rel_tol=2e-5)
    for v in (3, 8, 25):
        steps = 20_000
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        inner = sum(c * (1 + (1.7 * (k + 0.5) / steps) ** 2 / v) ** (-(v + 1) / 2) for k in range(steps)) * 1.7 / steps * 2
        (got,) = spark.range(1).select(student.two_sided(F.lit(-1.7), F.lit(v))).first()
        assert math.isclose(got, 1 - inner, rel_tol=1e-7)
    odd = spark.range(1).select(student.two_sided(F.lit(NAN), F.lit(3)), student.two_sided(F.lit(INF), F.lit(3)), student.two_sided(F.lit(0.0), F.lit(3)), student.two_sided(F.lit(None).cast("double"), F.lit(3))).first()
    assert tuple(odd) == (None, 0.0, 1.0, None)


def test_quantiles_are_worked_out_once_for_each_freedom(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([3, 0, 1, 2, 7, 7, 7, 30, 10**7, 10**6])], "k int, v long")
    got = {r["k"]: r for r in S.with_t_quantile(df, "v", "t").withColumn("own", student.quantile(F.col("v"))).collect()}
    assert len(got) == 10 and all(r["t"] == r["own"] for r in got.values()) and got[1]["t"] is None and got[4]["t"] == got[6]["t"] > 2
    rows = spark.range(300).select((F.col("id") % 100).alias("k"), (F.rand(1) + 1).alias("x"), (F.rand(2) + 1).alias("y"))
    for out in (S.mean_interval(rows, ["k"], "x"), V.loglog_fit(rows, ["k"], "x", "y").drop("p_value")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and "Aggregate [__v" in plan  # over distinct freedoms
