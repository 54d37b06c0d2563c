"""Queries of grids, spectra, orders of traversal and catalogs, over sizes and places that the tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grid
from ..functions import comparison as C
from ..functions import profiles as P
from ..operators import boundary, stencil, timestep
from ..sources.problems import HEAT, POISSON, POISSON_3D, SELECTIONS, gaussian
from .analytics import _table, rounded
from .catalogs import HEAT_SQL, POISSON_3D_SQL, POISSON_SQL, listed
from .fields import G

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


#: Sizes of grids from parts: a side by the part's size, the other by its brand.
SIZES = "s AS (SELECT DISTINCT CAST(2 * p_size + 1 AS INTEGER) AS nx, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) + 2 AS ny FROM part)"
#: Places in the unit square and cube, and times, from line items.
PLACES = "p AS (SELECT DISTINCT l_quantity / 50.0::DOUBLE AS x, l_discount * 10 AS y, l_tax * 12.5::DOUBLE AS z, l_tax AS t FROM lineitem)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select((2 * F.col("p_size") + 1).cast("int").alias("nx"), (F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") + 2).alias("ny")).distinct()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_quantity") / F.lit(50.0)).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 12.5).alias("z"), F.col("l_tax").alias("t")).distinct()


def given(c):
    return F.round(c, 8) + F.lit(0.0)


@query("grid_generate", f"WITH {SIZES} SELECT nx, ny, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(-1 + i * (2::DOUBLE / (nx - 1)), 9) AS x, round(j * (2::DOUBLE / (ny - 1)), 9) AS y FROM s, range(101) a(i), range(101) b(j) WHERE i < nx AND j < ny AND nx < 12")
def grid_generate(spark, sf_dir):
    """Points of the narrow grids."""
    return rounded(grid.many_points(sizes(spark, sf_dir).where("nx < 12"), -1.0, 1.0, 0.0, 2.0), 9, "x", "y")


@query(
    "grid_coarsen",
    f"WITH RECURSIVE {SIZES}, l AS (SELECT nx, ny, 0 AS level, nx AS level_nx, ny AS level_ny FROM s UNION ALL SELECT nx, ny, level + 1, (level_nx - 1) // 2 + 1, (level_ny - 1) // 2 + 1 FROM l WHERE level_nx % 2 = 1 AND level_ny % 2 = 1 AND level_nx >= 5 AND level_ny >= 5) "
    "SELECT nx, ny, CAST(level AS INTEGER) AS level, CAST(level_nx AS INTEGER) AS level_nx, CAST(level_ny AS INTEGER) AS level_ny FROM l",
)
def grid_coarsen(spark, sf_dir):
    return grid.many_levels(sizes(spark, sf_dir))


RULES = (
    "nx % 2 = 1 AND ny % 2 = 1 AND nx >= 5 AND ny >= 5 AS can_coarsen, greatest(5, (nx - 1) // 2 + 1) AS clamped_nx, greatest(5, (ny - 1) // 2 + 1) AS clamped_ny, "
    "round(cos(pi() / (nx - 1)) * cos(pi() / (ny - 1)), 9) AS radius, round(2 / (1 + sin(pi() * least(1 / (nx - 1)::DOUBLE, 1 / (ny - 1)::DOUBLE))), 9) AS omega"
)


@query("grid_rules", f"WITH {SIZES} SELECT nx, ny, {RULES} FROM s")
def grid_rules(spark, sf_dir):
    return rounded(grid.many_rules(sizes(spark, sf_dir)).drop("refined_nx", "refined_ny"), 9, "radius", "omega")


@query(
    "grid_refine",
    f"WITH {SIZES}, r AS (SELECT nx, ny, 2 * (nx - 1) + 1 AS refined_nx, 2 * (ny - 1) + 1 AS refined_ny FROM s), l AS (SELECT *, unnest(range(refined_nx)) AS i FROM r), p AS (SELECT *, unnest(range(refined_ny)) AS j FROM l) "
    "SELECT nx, ny, refined_nx, refined_ny, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(i * (1::DOUBLE / (refined_nx - 1)), 9) AS x, round(j * (1::DOUBLE / (refined_ny - 1)), 9) AS y FROM p",
)
def grid_refine(spark, sf_dir):
    """The points of every grid refined once, over the unit square."""
    refined = grid.many_rules(sizes(spark, sf_dir)).select(F.col("refined_nx").alias("nx"), F.col("refined_ny").alias("ny"))
    coarse = lambda n: F.expr(f"({n} + 1) div 2").cast("int").alias(n)
    points = grid.many_points(refined).select(coarse("nx"), coarse("ny"), F.col("nx").alias("refined_nx"), F.col("ny").alias("refined_ny"), "i", "j", "x", "y")
    return rounded(points, 9, "x", "y")


def lines(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()


@query("spectrum_1d", "SELECT n, CAST(k AS INTEGER) AS k, round(-4.0 * (n + 1) * (n + 1) * pow(sin(k * pi() / (2 * (n + 1))), 2), 6) AS eigenvalue FROM (SELECT DISTINCT p_size AS n FROM part), range(1, 51) t(k) WHERE k <= n")
def spectrum_1d(spark, sf_dir):
    return rounded(stencil.spectra(lines(spark, sf_dir)), 6, "eigenvalue")


@query("condition_number", "SELECT n, round(pow(sin(n * pi() / (2 * (n + 1))) / sin(pi() / (2 * (n + 1))), 2), 6) AS condition FROM (SELECT DISTINCT p_size AS n FROM part)")
def condition_number(spark, sf_dir):
    return rounded(stencil.conditions(lines(spark, sf_dir)), 6, "condition")


@query("fourier_symbols", "SELECT n, CAST(a.k AS INTEGER) AS kx, CAST(b.k AS INTEGER) AS ky, round((4.0 - 2.0 * cos(a.k * pi() / n) - 2.0 * cos(b.k * pi() / n)) * n * n, 6) AS symbol, CASE WHEN 2 * a.k >= n OR 2 * b.k >= n THEN 'high' ELSE 'low' END AS band FROM (SELECT DISTINCT p_size AS n FROM part), range(50) a(k), range(50) b(k) WHERE a.k < n AND b.k < n")
def fourier_symbols(spark, sf_dir):
    return rounded(stencil.symbols(lines(spark, sf_dir)), 6, "symbol")


#: Cells of a 64 x 64 grid that line items fall into.
CELLS = "c AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) % 64 AS i, CAST(l_partkey % 64 AS INTEGER) AS j FROM lineitem)"
BITS = " | ".join(f"((((j >> {k}) & 1) << {2 * k}) | (((i >> {k}) & 1) << {2 * k + 1}))" for k in range(6))


def cells(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") % 64).alias("i"), (F.col("l_partkey") % 64).cast("int").alias("j")).distinct()


@query("morton_order", f"WITH {CELLS} SELECT i, j, CAST({BITS} AS BIGINT) AS z FROM c")
def morton_order(spark, sf_dir):
    return cells(spark, sf_dir).select("i", "j", C.morton(F.col("i"), F.col("j"), 6).alias("z")).orderBy("z")


@query("tile_traversal", f"WITH {CELLS} SELECT CAST(i // 8 AS INTEGER) AS bi, CAST(j // 8 AS INTEGER) AS bj, count(*) AS points, min(i) AS i0, max(i) + 1 AS i1 FROM c GROUP BY ALL")
def tile_traversal(spark, sf_dir):
    named = cells(spark, sf_dir).select(F.expr("cast(i div 8 as int)").alias("bi"), F.expr("cast(j div 8 as int)").alias("bj"), "i")
    return named.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("points"), F.min("i").alias("i0"), (F.max("i") + 1).alias("i1")).orderBy("bi", "bj")


@query(
    "block_adjacency",
    f"WITH {CELLS}, k AS (SELECT CAST(i // 8 AS INTEGER) AS bi, CAST(j // 8 AS INTEGER) AS bj, min(i) AS i0, max(i) + 1 AS i1, min(j) AS j0, max(j) + 1 AS j1 FROM c GROUP BY ALL) "
    "SELECT p.bi AS a_bi, p.bj AS a_bj, q.bi AS b_bi, q.bj AS b_bj FROM k p JOIN k q ON (p.i1 = q.i0 AND p.j0 < q.j1 AND q.j0 < p.j1) OR (p.j1 = q.j0 AND p.i0 < q.i1 AND q.i0 < p.i1)",
)
def block_adjacency(spark, sf_dir):
    return C.block_adjacency(C.blocks(cells(spark, sf_dir), 8))


@query("enumerate_configs", "SELECT * FROM (SELECT DISTINCT p_brand AS problem FROM part), (SELECT DISTINCT p_size AS n FROM part), (SELECT DISTINCT p_type AS prec FROM part)")
def enumerate_configs(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return C.enumerate_configs(part.select(F.col("p_brand").alias("problem")).distinct(), part.select(F.col("p_size").alias("n")), part.select(F.col("p_type").alias("prec")))


@query("predicted_factors", "WITH m(smoother, smoothing) AS (VALUES ('gauss_seidel', 0.25::DOUBLE), ('jacobi', 0.5), ('red_black_gs', 0.5), ('weighted_jacobi', 0.33)), w AS (SELECT DISTINCT l_linenumber AS before, CAST(l_quantity AS INTEGER) % 4 AS after FROM lineitem) SELECT before, after, smoother, smoothing, round(least(pow(smoothing, before + after) * 0.8, 0.5), 9) AS two_grid FROM m, w")
def predicted_factors(spark, sf_dir):
    steps = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("before"), (F.col("l_quantity").cast("int") % 4).alias("after")).distinct()
    return rounded(P.predicted_factors(steps), 9, "two_grid")


@query("memory_3d", f"WITH RECURSIVE {SIZES}, b AS (SELECT nx, ny, nx + ny AS nz FROM s), l AS (SELECT nx, ny, nz, nx * ny * nz AS points, nx * ny * nz AS here, 0 AS level FROM b UNION ALL SELECT nx, ny, nz, points, here // 8, level + 1 FROM l WHERE level < 4 AND here // 8 >= 1000) SELECT nx, ny, nz, CAST(points AS BIGINT) AS points, count(*) AS levels, round(sum(here) * 32 / 1048576.0, 6) AS mb FROM l GROUP BY ALL")
def memory_3d(spark, sf_dir):
    return rounded(P.memory_3d(sizes(spark, sf_dir).withColumn("nz", F.col("nx") + F.col("ny"))), 6, "mb")


@query("feedback_steps", "WITH w AS (SELECT DISTINCT l_discount * 0.02::DOUBLE + 0.0001::DOUBLE AS dt, CAST(l_quantity AS INTEGER) AS iterations FROM lineitem) SELECT round(dt, 9) AS dt, iterations, round(least(CASE WHEN iterations < 5 THEN dt * 1.1 WHEN iterations > 20 THEN dt * 0.8 ELSE dt END, 0.0625 * 0.0625 / 4), 9) AS next_dt FROM w")
def feedback_steps(spark, sf_dir):
    work = _table(spark, sf_dir, "lineitem").select((F.col("l_discount") * F.lit(0.02) + F.lit(0.0001)).alias("dt"), F.col("l_quantity").cast("int").alias("iterations")).distinct()
    return rounded(timestep.feedback_steps(work, G, 1.0), 9, "dt", "next_dt")


#: Segments along sides from orders: a priority a side, from a place by the order on, as long as the customer says.
SEGMENTS = "s AS (SELECT o_orderpriority AS side, CAST(o_orderkey AS INTEGER) AS seg_no, (o_orderkey * 37 % 1000) / 1000.0::DOUBLE AS s0, least((o_orderkey * 37 % 1000 + o_custkey % 40) / 1000.0::DOUBLE, 1) AS s1 FROM orders WHERE o_orderstatus = 'P')"


@query(
    "bc_segment_gaps",
    f"WITH {SEGMENTS}, c AS (SELECT *, coalesce(max(s1) OVER (PARTITION BY side ORDER BY s0, seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS reached FROM s) "
    "SELECT side, seg_no, CASE WHEN s0 > reached + 1e-10 THEN 'gap' ELSE 'overlap' END AS problem FROM c WHERE abs(s0 - reached) > 1e-10 "
    "UNION ALL SELECT side, max(seg_no), 'gap at end' FROM s GROUP BY side HAVING max(s1) < 1 - 1e-10",
)
def bc_segment_gaps(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    start = F.col("o_orderkey") * 37 % 1000
    return boundary.segment_gaps(orders.select(F.col("o_orderpriority").alias("side"), F.col("o_orderkey").cast("int").alias("seg_no"), (start / F.lit(1000.0)).alias("s0"), F.least((start + F.col("o_custkey") % 40) / F.lit(1000.0), F.lit(1.0)).alias("s1")))


@query("grid_evaluate", f"WITH {PLACES} SELECT DISTINCT x, y, round(sin(pi() * x) * sin(pi() * y), 9) + 0.0 AS u, round(2 * pi() * pi() * sin(pi() * x) * sin(pi() * y), 9) + 0.0 AS f FROM p")
def grid_evaluate(spark, sf_dir):
    p = POISSON["trigonometric"]
    x, y = F.col("x"), F.col("y")
    return places(spark, sf_dir).select("x", "y").distinct().select("x", "y", (F.round(p.exact(x, y), 9) + F.lit(0.0)).alias("u"), (F.round(p.source(x, y), 9) + F.lit(0.0)).alias("f"))


def catalog(at: DataFrame, forms: dict) -> DataFrame:
    """(the frame's columns, problem, u, f) of every form, pairs of Columns, in one pass."""
    each = F.array(*[F.struct(F.lit(n).alias("problem"), given(u.cast("double")).alias("u"), given(f.cast("double")).alias("f")) for n, (u, f) in forms.items()])
    return at.select("*", F.inline(each))


@query("poisson_catalog", f"WITH {PLACES}, q AS (SELECT DISTINCT x, y FROM p), v AS ({listed(POISSON_SQL, 'q', 'x, y')}) SELECT problem, x, y, round(u, 8) + 0.0 AS u, round(f, 8) + 0.0 AS f FROM v")
def poisson_catalog(spark, sf_dir):
    at = F.col("x"), F.col("y")
    return catalog(places(spark, sf_dir).select("x", "y").distinct(), {n: (p.exact(*at), p.source(*at)) for n, p in POISSON.items()})


@query("heat_catalog", f"WITH {PLACES}, q AS (SELECT DISTINCT x, y, t FROM p), v AS ({listed(HEAT_SQL, 'q', 'x, y, t')}) SELECT problem, x, y, t, round(u, 8) + 0.0 AS u, round(f, 8) + 0.0 AS f FROM v")
def heat_catalog(spark, sf_dir):
    at = [F.col(c) for c in "xyt"]
    return catalog(places(spark, sf_dir).select("x", "y", "t").distinct(), {n: (p.exact(*at), p.source(*at)) for n, p in HEAT.items()})


@query("mms_3d", f"WITH {PLACES}, q AS (SELECT DISTINCT x, y, z FROM p), v AS ({listed(POISSON_3D_SQL, 'q', 'x, y, z')}) SELECT problem, x, y, z, round(u, 8) + 0.0 AS u, round(f, 8) + 0.0 AS f FROM v")
def mms_3d(spark, sf_dir):
    at = [F.col(c) for c in "xyz"]
    return catalog(places(spark, sf_dir).select("x", "y", "z").distinct(), {n: (u(*at), f(*at)) for n, (u, f) in POISSON_3D.items()})


@query("initial_gaussian", f"WITH {PLACES} SELECT DISTINCT x, y, round(2 * exp(-((x - 0.5) * (x - 0.5) + (y - 0.25) * (y - 0.25)) / (2 * 0.04::DOUBLE)), 9) AS u FROM p")
def initial_gaussian(spark, sf_dir):
    return places(spark, sf_dir).select("x", "y").distinct().withColumn("u", F.round(gaussian((0.5, 0.25), 0.2, 2.0)(F.col("x"), F.col("y")), 9))


@query("benchmark_selections", f"WITH {PLACES}, q AS (SELECT DISTINCT x, y FROM p), s AS (SELECT 'accuracy' AS purpose, unnest(['trigonometric', 'polynomial', 'anisotropic', 'boundary_layer']) AS problem UNION ALL SELECT 'convergence', unnest(['trigonometric', 'high_frequency', 'polynomial']) UNION ALL SELECT 'scalability', unnest(['trigonometric', 'polynomial'])), v AS ({listed(POISSON_SQL, 'q', 'x, y')}) SELECT purpose, problem, round(max(abs(u)), 8) AS largest, count(*) AS places FROM s JOIN v USING (problem) GROUP BY ALL")
def benchmark_selections(spark, sf_dir):
    """The problems of each purpose, with the largest value of their solutions over all places."""
    at = F.col("x"), F.col("y")
    each = F.array(*[F.struct(F.lit(purpose).alias("purpose"), F.lit(n).alias("problem"), F.abs(POISSON[n].exact(*at).cast("double")).alias("u")) for purpose, names in SELECTIONS.items() for n in names])
    rows = places(spark, sf_dir).select("x", "y").distinct().select(F.inline(each))
    return rows.groupBy("purpose", "problem").agg(F.round(F.max("u"), 8).alias("largest"), F.count(F.lit(1)).alias("places"))
