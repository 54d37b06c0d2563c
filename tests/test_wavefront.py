import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels
from gridloom.grid import Grid
from gridloom.operators import solvers, wavefront

G = Grid(18, 15, 0, 1, 0, 2)  # tiles of 4 leave narrower ones at the ends


def fields(spark, grid):
    rng = np.random.default_rng(5)
    u, f = rng.random((grid.nx, grid.ny)), rng.random((grid.nx, grid.ny))
    rows = [(i, j, float(u[i, j]), float(f[i, j])) for i in range(grid.nx) for j in range(grid.ny)]
    return u, f, spark.createDataFrame(rows, "i int, j int, u double, f double")


def array(df, column, grid):
    out = np.full((grid.nx, grid.ny), np.nan)
    for r in df.collect():
        out[r["i"], r["j"]] = r[column]
    return out


@pytest.mark.parametrize("sweeps,omega,backward", [(1, 1.0, False), (3, 1.3, False), (2, 1.0, True)])
def test_gauss_seidel_equals_the_kernel_bit_by_bit(spark, sweeps, omega, backward):
    u, f, df = fields(spark, G)
    got = wavefront.gauss_seidel(df, G, sweeps, 4, omega, 0.5, backward)
    for _ in range(sweeps):
        u = kernels.gauss_seidel(u, f, G, omega, 0.5, backward)
    assert np.array_equal(array(got, "u", G), u) and np.array_equal(array(got, "f", G), f)


def test_ilu_equals_the_kernel_bit_by_bit(spark):
    _, f, df = fields(spark, G)
    for modified in (0.0, 2.0):
        made = wavefront.TiledILU(G, 4, 0.25, modified)
        z = made.apply(df.select("i", "j", F.col("f").alias("r")))
        pivots = kernels.ilu0(G, 0.25, modified)
        assert np.array_equal(array(z, "z", G), kernels.ilu_apply(f, G, pivots))
        again = made.pivots
        made.apply(z.select("i", "j", "r"))
        assert made.pivots is again  # found once


def test_blocks_round_trip_and_one_tile_a_task(spark):
    _, _, df = fields(spark, G)
    blocks = wavefront.to_blocks(df, 4, "u", "f")
    assert blocks.count() == 20 and blocks.agg(F.max(F.size("u"))).first()[0] == 16
    back = wavefront.from_blocks(blocks, 4, "u", "f")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_coarse_level_keeps_exchanges_down(spark):
    """From 4 to 16 tiles; see README for 64."""
    counts = {}
    for k in (2, 4):
        g = Grid(8 * k + 1, 8 * k + 1)
        _, _, df = fields(spark, g)
        start = df.withColumn("u", F.lit(0.0))
        size = (g.hx * g.hy) ** 0.5
        for coarse in (False, True) if k == 4 else (True,):
            out = solvers.solve_subdomains(start, g, 8, 4, 1e-4 * size * g.nx, 20, coarse)
            counts[k, coarse] = len(out.history) if out.converged else 99
    assert counts[4, True] <= counts[2, True] + 4 and counts[4, True] < counts[4, False]
    with pytest.raises(ValueError):
        solvers.coarse_correction(df, Grid(18, 18), 8)
