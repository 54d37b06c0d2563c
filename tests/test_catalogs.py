import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions import profiles
from gridloom.functions.profiling import Profiler
from gridloom.grid import Grid
from gridloom.operators import boundary, solvers, timestep
from gridloom.plans import catalog, catalogs
from gridloom.sources.problems import HEAT, POISSON, POISSON_3D

DIR = "/root/testdata/sf0.001"


def test_every_problem_has_its_sql():
    assert set(catalogs.POISSON_SQL) == set(POISSON)
    assert set(catalogs.HEAT_SQL) == set(HEAT)
    assert set(catalogs.POISSON_3D_SQL) == set(POISSON_3D)


TWINS = """poisson_catalog heat_catalog mms_3d mms_errors heat_errors grid_rules grid_generate grid_coarsen grid_refine grid_evaluate initial_gaussian benchmark_selections spectrum_1d condition_number
fourier_symbols morton_order tile_traversal block_adjacency enumerate_configs predicted_factors memory_3d feedback_steps bc_segment_gaps bc_insulated bc_radiation bc_config heat_theta solve_cg solve_subdomains
stability_scan run_aggregates evolution_frames stagnation asymptotic_fit one_run_scans lru_evict_one_owner order_statistics_one_key range_join_first_match substring_join mean_interval student_fit gauss_seidel_wavefront heat_adaptive_steps variant_props stream_windows stream_last_values""".split()


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier", "nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    expected = con.execute(catalog.ORACLES[name])
    order = [c[0] for c in expected.description]
    got = catalog.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(order)
    assert sorted(map(str, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(str, expected.fetchall()))


def test_sources_follow_from_solutions_in_3d(spark):
    at = {c: F.lit(v) for c, v in zip("xyz", (0.3, 0.2, 0.4), strict=True)}
    h = 1e-3
    for u, f in POISSON_3D.values():
        near = [u(**{**at, c: at[c] + F.lit(s)}) for c in "xyz" for s in (h, -h)]
        lap = (sum(near[1:], near[0]) - 6 * u(**at)) / (h * h)
        a, b = spark.range(1).select((-lap).alias("a"), f(**at).alias("b")).first()
        assert a == pytest.approx(b, rel=1e-3)


def test_conditions_from_settings(spark):
    grid = Grid(5, 5)
    field = grid.evaluate(spark, u=lambda x, y: x + 2 * y)
    for bad in ({"front": {"type": "dirichlet"}}, {"left": {"type": "magic"}}):
        with pytest.raises(ValueError):
            boundary.from_config(grid, bad)
    moved = boundary.from_config(grid, {"all": {"type": "dirichlet", "value": lambda t: 3 * t}}, 2.0).apply(field)
    assert {r.u for r in boundary.boundary(moved, grid).collect()} == {6.0}
    assert sorted(map(tuple, boundary.from_config(grid, {"all": {"type": "periodic"}}).apply(field).collect())) == sorted(map(tuple, boundary.periodic(field, grid).collect()))


def test_subdomains_need_overlap_and_handle_uneven_tiles(spark):
    grid = Grid(13, 11)
    field = grid.evaluate(spark, u=lambda x, y: F.lit(0.0) * x, f=lambda x, y: F.sin(3 * x) + y)
    with pytest.raises(ValueError):
        solvers.solve_subdomains(field, grid, 6, 1)
    done = solvers.solve_subdomains(field, grid, 6, 3, 1e-8)
    assert done.converged
    runs = solvers.solve_runs(field.withColumn("run_id", F.lit("a")), grid, "cg", 1e-11, 500, want="field")
    off = runs.join(done.field.select("i", "j", F.col("u").alias("v")), ["i", "j"]).agg(F.max(F.abs(F.col("u") - F.col("v")))).first()[0]
    assert off < 1e-7


def test_profiler_feeds_the_summaries(spark):
    profiler = Profiler(most=4)

    @profiler.timed(level=1)
    def step(fail):
        if fail:
            raise KeyError("x")
        return 7

    assert step(False) == 7
    with pytest.raises(KeyError):
        step(True)
    for _ in range(3):
        with profiler.measure("smooth", 2):
            pass
    rows = profiler.frame(spark)
    assert [(r.name, r.failed) for r in rows.collect()] == [("step", True), ("smooth", False), ("smooth", False), ("smooth", False)]
    assert {r.n for r in profiles.cycle_stats(rows, "name", "elapsed").collect()} == {1, 3}


def test_states_keep_times(spark):
    grid = Grid(5, 5)
    start = grid.evaluate(spark, u=lambda x, y: F.lit(0.0) * x)
    out = timestep.states(timestep.run(start, grid, 1.0, 0.1, 0.25))
    assert [tuple(r) for r in out.groupBy("step").agg(F.round(F.max("t"), 9), F.count(F.lit(1))).orderBy("step").collect()] == [(0, 0.0, 25), (1, 0.1, 25), (2, 0.2, 25), (3, 0.25, 25)]
