import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels
from gridloom.grid import Grid
from gridloom.operators import boundary, smoothers, stencil

G = Grid(9, 9)


def array(df, value="u", g=G):
    out = np.full((g.nx, g.ny), np.nan)
    for r in df.collect():
        out[r["i"], r["j"]] = r[value]
    return out


def noise(spark, g=G, seed=1):
    rng = np.random.default_rng(seed)
    u, f = rng.standard_normal((g.nx, g.ny)), rng.standard_normal((g.nx, g.ny))
    rows = [(i, j, float(u[i, j]), float(f[i, j])) for i in range(g.nx) for j in range(g.ny)]
    return spark.createDataFrame(rows, "i int, j int, u double, f double"), u, f


@pytest.mark.parametrize("make, want", [(lambda x, y: F.lit(1.0) + 0 * x, 0.0), (lambda x, y: x + 2 * y, 0.0), (lambda x, y: x * x + y * y, 4.0)])
def test_laplacian_identities(spark, make, want):
    lap = array(stencil.laplacian(G.evaluate(spark, u=make), G), "lap")
    assert np.allclose(lap[1:-1, 1:-1], want, atol=1e-9) and (lap[0] == 0).all()


def test_three_laplacians_agree(spark):
    df, u, f = noise(spark)
    want = -kernels.apply(u, G)
    assert np.allclose(array(stencil.laplacian(df, G), "lap"), want)
    scattered = array(stencil.laplacian_scatter(df, G), "lap")
    assert np.allclose(scattered[1:-1, 1:-1], want[1:-1, 1:-1])
    assert np.isclose(stencil.stencil_at(df, G, 3, 4).first()["lap"], want[3, 4])
    with pytest.raises(ValueError):
        stencil.stencil_at(df, G, 0, 4)
    assert np.allclose(array(stencil.residual(df, G, shift=2.0), "r"), kernels.residual(u, f, G, 2.0))


def test_gather_keeps_keys_apart(spark):
    df, u, _ = noise(spark)
    two = df.withColumn("run", F.lit(1)).unionByName(df.withColumn("u", F.col("u") * 2).withColumn("run", F.lit(2)))
    near = stencil.gather(two.select("run", "i", "j", "u"), "u", {"e": (1, 0)}, ("run",))
    got = {(r["run"], r["i"], r["j"]): r["u_e"] for r in near.collect()}
    assert got[1, 2, 3] == u[3, 3] and got[2, 2, 3] == 2 * u[3, 3] and got[1, 8, 0] is None


def test_one_exchange_a_stencil(spark):
    df, _, _ = noise(spark)
    plan = stencil.laplacian(df, G)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in plan


def test_transfers(spark):
    df, u, _ = noise(spark)
    coarse = G.coarsen()
    assert np.allclose(array(stencil.restrict_full(df, G, zero_edge=True), g=coarse), kernels.restrict(u))
    assert np.allclose(array(stencil.restrict_injection(df, G), g=coarse), u[::2, ::2])
    one = df.withColumn("u", F.lit(1.0))
    for make in (stencil.restrict_full, stencil.restrict_half, stencil.restrict_renormalized):
        assert np.allclose(array(make(one, G), g=coarse), 1.0)
    back = stencil.prolong_bilinear(stencil.restrict_injection(df, G), G)
    assert np.allclose(array(back), kernels.prolong(u[::2, ::2]))
    linear = coarse.evaluate(spark, u=lambda x, y: 3 * x - y)
    exact = array(G.evaluate(spark, u=lambda x, y: 3 * x - y))
    assert np.allclose(array(stencil.prolong_bilinear(linear, G)), exact)
    assert array(stencil.prolong_injection(linear, G, spark))[1, 1] == 0
    with pytest.raises(ValueError):
        stencil.restrict_full(df, Grid(6, 6))


def test_norms(spark):
    g = Grid(5, 5)
    ones = g.points(spark).select("i", "j", F.when(g.inside(), 1.0).otherwise(0.0).alias("u"))
    n = stencil.norms(ones, g).first()
    assert np.isclose(n["l2"], 0.25 * 3) and n["l2_inner"] == 3 and n["max_norm"] == 1
    e = stencil.error_set(g.evaluate(spark, u=lambda x, y: x, exact=lambda x, y: 0 * x), g).first()
    assert np.isclose(e["h1_semi"], 1.0) and e["relative_max"] == e["max_error"] == 1.0


def test_smoothers_match_the_kernels(spark):
    df, u, f = noise(spark)
    u1 = kernels.jacobi(kernels.jacobi(u, f, G), f, G)
    assert np.allclose(array(smoothers.jacobi(df, G, 2, 0.8)), u1)
    assert np.allclose(array(smoothers.red_black(df, G, 1)), kernels.red_black(u, f, G))
    assert np.allclose(array(smoothers.sor(df, G, 1, 1.4)), kernels.red_black(u, f, G, 1.4))


@pytest.mark.parametrize("tile", [3, 4, 9, 20])
def test_tiles_equal_plain_sweeps(spark, tile):
    df, u, f = noise(spark)
    for _ in range(3):
        u = kernels.jacobi(u, f, G)
    out = smoothers.tiled(df, G, 3, tile)
    assert out.count() == 81 and np.allclose(array(out), u)
    with pytest.raises(ValueError):
        smoothers.tiled(df, G, 30, tile)


def test_gauss_seidel_is_lexicographic():
    rng = np.random.default_rng(0)
    u, f = rng.standard_normal((9, 9)), rng.standard_normal((9, 9))
    want = u.copy()
    for i in range(1, 8):
        for j in range(1, 8):
            want[i, j] = (f[i, j] + (want[i + 1, j] + want[i - 1, j]) * G.cx + (want[i, j + 1] + want[i, j - 1]) * G.cy) / G.diagonal
    assert np.allclose(kernels.gauss_seidel(u, f, G), want)


def test_boundary_conditions(spark):
    df, u, _ = noise(spark)
    h = G.hx
    flux = array(boundary.neumann(df, G, 0.5, "left"))
    assert np.allclose(flux[0], u[1] + 0.5 * h) and np.allclose(flux[1:], u[1:])
    assert np.allclose(array(boundary.neumann_axis(df, G, 0.5, "left"))[0], u[1] - 0.5 * h)
    robin = array(boundary.robin(df, G, 2.0, 3.0, 1.0, "top"))
    assert np.allclose(2.0 * robin[:, -1] + 3.0 * (robin[:, -1] - u[:, -2]) / h, 1.0)
    around = array(boundary.periodic(df, G))
    assert np.allclose(around[0, 1:-1], u[-2, 1:-1]) and np.allclose(around[1:-1, -1], u[1:-1, 1])
    assert np.allclose(array(boundary.dirichlet(df, G, 7.0))[[0, -1]], 7.0)
    one = boundary.BoundaryConditions(G).set("left", lambda d: boundary.dirichlet(d, G, 1.0, "left")).set("left", lambda d: boundary.dirichlet(d, G, 2.0, "left"))
    assert np.allclose(array(one.apply(df))[0], 2.0)
    assert np.allclose(array(boundary.homogeneous(G).apply(df))[0], 0.0)
    warm = array(boundary.radiation(G, 2.0, 5.0).apply(df.withColumn("u", F.lit(5.0))))
    assert np.allclose(warm, 5.0)


def test_mixed_segments(spark):
    df, u, _ = noise(spark)
    rows = [("left", 1, 0.0, 0.5, "dirichlet", 9.0, 0.0, 0.0), ("left", 2, 0.4, 1.0, "neumann", 0.0, 0.0, 0.0)]
    out = array(boundary.mixed(df, G, spark.createDataFrame(rows, boundary.SEGMENTS)))
    assert np.allclose(out[0, 1:5], 9.0) and np.allclose(out[0, 5:8], u[1, 5:8]) and np.allclose(out[1:], u[1:])
    assert {r["problem"] for r in boundary.segment_gaps(spark.createDataFrame(rows, boundary.SEGMENTS)).collect()} == {"overlap"}
