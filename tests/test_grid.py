import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid, hierarchy_frame


def test_coarsen_and_refine():
    assert (Grid(9, 9).coarsen().nx, Grid(5, 5).refine().nx) == (5, 9)
    with pytest.raises(ValueError):
        Grid(6, 6).coarsen()
    with pytest.raises(ValueError):
        Grid(2, 5)
    with pytest.raises(ValueError):
        Grid(5, 5, x0=1.0, x1=0.0)
    assert Grid(6, 40).clamped_coarsen().nx == 5
    assert [g.nx for g in Grid(17, 17).hierarchy()] == [17, 9, 5, 3]
    assert Grid(5, 5).memory_bytes(1) == 25 * 8 * 4


def test_points(spark):
    rows = {(r["i"], r["j"]): (r["x"], r["y"]) for r in Grid(5, 3, -1.0, 1.0, 0.0, 4.0).points(spark).collect()}
    assert len(rows) == 15 and rows[4, 2] == (1.0, 4.0) and rows[1, 1] == (-0.5, 2.0)


def test_selects_cover_the_grid(spark):
    g = Grid(6, 5)
    p = g.points(spark)
    inner, outer = p.where(g.inside()), p.where(~g.inside())
    assert inner.count() == 12 and p.exceptAll(inner).exceptAll(outer).count() == 0
    with pytest.raises(ValueError):
        g.side("middle")


def test_float_fields(spark):
    out = Grid(5, 5, dtype="float").evaluate(spark, u=lambda x, y: x + y)
    assert out.schema["u"].dataType.simpleString() == "float"
    assert hierarchy_frame(spark, Grid(9, 9)).agg(F.sum("nx")).first()[0] == 9 + 5 + 3


def test_refined_grids_have_all_their_points(spark):
    from gridloom.plans import grids

    d = "/root/testdata/sf0.001"
    per = {(r["nx"], r["ny"]): r for r in grids.grid_refine(spark, d).groupBy("nx", "ny", "refined_nx", "refined_ny").agg({"*": "count", "x": "max", "i": "max", "j": "max"}).collect()}
    assert set(per) == {tuple(r) for r in grids.sizes(spark, d).collect()}
    for (nx, ny), r in per.items():
        assert (r["refined_nx"], r["refined_ny"], r["count(1)"]) == (2 * nx - 1, 2 * ny - 1, (2 * nx - 1) * (2 * ny - 1)) and (r["max(x)"], r["max(i)"], r["max(j)"]) == (1, 2 * nx - 2, 2 * ny - 2)
