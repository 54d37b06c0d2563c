"""Queries of the grid operators over a 17 x 17 field made from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators import boundary, smoothers, solvers, stencil, timestep
from ..operators.preconditioners import Diagonal

G = Grid(17, 17)
OMEGA = 0.8


def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, u, f) from lineitem: mean price and discount of each cell, from exact sums, in steps of 1/8192.

    Steps of a power of two leave no decimal ties for two engines to round apart.
    """
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity").cast("int") % 17).alias("i"), (F.col("l_partkey") % 17).cast("int").alias("j"), "l_extendedprice", "l_discount")
    mean = lambda c, by: F.floor(F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) * F.lit(by) + 0.5) / F.lit(8192.0)
    return rows.groupBy("i", "j").agg(mean("l_extendedprice", 0.8192).alias("u"), mean("l_discount", 81920.0).alias("f"))


def runs17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, i, j, u, f): such a field of each line number, as problems with zero boundary values."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").cast("string").alias("run_id"), (F.col("l_quantity").cast("int") % 17).alias("i"), (F.col("l_partkey") % 17).cast("int").alias("j"), "l_extendedprice", "l_discount")
    mean = lambda c, by: F.floor(F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) * F.lit(by) + 0.5) / F.lit(8192.0)
    return boundary.zero(rows.groupBy("run_id", "i", "j").agg(mean("l_extendedprice", 0.8192).alias("u"), mean("l_discount", 81920.0).alias("f")), G)


FIELD = """g AS (
  SELECT CAST(l_quantity AS INTEGER) % 17 AS i, CAST(l_partkey % 17 AS INTEGER) AS j,
    floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 0.8192 + 0.5) / 8192.0 AS u,
    floor(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 81920.0 + 0.5) / 8192.0 AS f
  FROM lineitem GROUP BY 1, 2)"""
RUN_FIELD = FIELD.replace("SELECT CAST(l_quantity", "SELECT CAST(l_linenumber AS VARCHAR) AS run_id, CAST(l_quantity").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")
INSIDE = "i BETWEEN 1 AND {n} - 2 AND j BETWEEN 1 AND {n} - 2"


def near(name: str, source: str, value: str, keep: str = "", nine: bool = False) -> str:
    """A CTE of each point with its neighbours' values, by window functions."""
    keep = f", {keep}" if keep else ""
    rows = f"lag({value}) OVER x AS w, lead({value}) OVER x AS e"
    cols = "lag({v}) OVER y AS {a}, lead({v}) OVER y AS {b}"
    if not nine:
        return f"{name} AS (SELECT i, j, {value}{keep}, {rows}, {cols.format(v=value, a='s', b='n')} FROM {source} WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j))"
    return (
        f"{name}_0 AS (SELECT i, j, {value}{keep}, {rows} FROM {source} WINDOW x AS (PARTITION BY j ORDER BY i)), "
        f"{name} AS (SELECT *, {cols.format(v=value, a='s', b='n')}, {cols.format(v='w', a='sw', b='nw')}, {cols.format(v='e', a='se', b='ne')} FROM {name}_0 WINDOW y AS (PARTITION BY i ORDER BY j))"
    )


def within(n: int = 17) -> str:
    return INSIDE.format(n=n)


def cross(h2: float) -> str:
    return f"(e + w) * {h2} + (n + s) * {h2}"


C = 256.0  # 1 / hx^2
D = 1024.0
RESIDUAL = f"CASE WHEN {within()} THEN f + (({cross(C)}) - u * {D}) ELSE 0.0 END"
RINGS = "((e + w) + (n + s)) * 0.125 + ((ne + nw) + (se + sw)) * 0.0625"


def sweep(name: str, source: str, omega: float, colour: int | None = None, n: int = 17, c: float = C, d: float = D) -> str:
    at = within(n) + ("" if colour is None else f" AND (i + j) % 2 = {colour}")
    new = f"{1.0 - omega!r} * u + {omega!r} * (f + ({cross(c)})) / {d}"
    return near(f"{name}_n", source, "u", "f") + f", {name} AS (SELECT i, j, CASE WHEN {at} THEN {new} ELSE u END AS u, f FROM {name}_n)"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def on_field(name: str, sql: str):
    """Register f(field) as a query over g17."""

    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(g17(spark, sf_dir)))
        return f

    return add


POINTS = "SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, {x0}::DOUBLE + a.i * {hx!r}::DOUBLE AS x, {y0}::DOUBLE + b.j * {hy!r}::DOUBLE AS y FROM range({nx}) a(i), range({ny}) b(j)"


@on_field("interior_select", f"WITH {FIELD} SELECT * FROM g WHERE {within()}")
def interior_select(field):
    return boundary.interior(field, G)


@on_field("boundary_select", f"WITH {FIELD} SELECT * FROM g WHERE NOT ({within()})")
def boundary_select(field):
    return boundary.boundary(field, G)


@on_field("boundary_side_select", f"WITH {FIELD} SELECT * FROM g WHERE j = 16")
def boundary_side_select(field):
    return boundary.boundary(field, G, "top")


@on_field("bc_dirichlet", f"WITH {FIELD} SELECT i, j, CASE WHEN {within()} THEN u ELSE i * 0.0625 + 2.0 * (j * 0.0625) END AS u, f FROM g")
def bc_dirichlet(field):
    return boundary.dirichlet(field, G, lambda x, y: x + F.lit(2.0) * y)


@on_field("bc_dirichlet_sides", f"WITH {FIELD} SELECT i, j, CASE WHEN j = 16 THEN 2.0 WHEN i = 0 THEN 1.0 ELSE u END AS u, f FROM g")
def bc_dirichlet_sides(field):
    return boundary.dirichlet(boundary.dirichlet(field, G, 1.0, "left"), G, 2.0, "top")


def edge_sql(rule: str) -> str:
    """Sides in the order left, right, bottom, top; of meeting sides the later wins. {v}: inner value, {s}: side's sign."""
    r = lambda v, s: rule.format(v=v, s=s)
    return f"WITH {FIELD}, {near('m', 'g', 'u', 'f')} SELECT i, j, CASE WHEN j = 16 THEN {r('s', '')} WHEN j = 0 THEN {r('n', '-')} WHEN i = 16 THEN {r('w', '')} WHEN i = 0 THEN {r('e', '-')} ELSE u END AS u, f FROM m"


@on_field("bc_neumann", edge_sql("{v} + 0.0625 * 0.5"))
def bc_neumann(field):
    return boundary.neumann(field, G, 0.5)


@on_field("bc_neumann_axis", edge_sql("{v} + {s}(0.0625 * 0.5)"))
def bc_neumann_axis(field):
    return boundary.neumann_axis(field, G, 0.5)


@on_field("bc_robin", edge_sql("(1.5 + 2.0 * {v} / 0.0625) / (0.5 + 2.0 / 0.0625)"))
def bc_robin(field):
    return boundary.robin(field, G, 0.5, 2.0, 1.5)


@on_field("bc_periodic", f"WITH {FIELD}, m AS (SELECT *, CASE WHEN i = 0 THEN 15 WHEN i = 16 THEN 1 ELSE i END AS si, CASE WHEN j = 0 THEN 15 WHEN j = 16 THEN 1 ELSE j END AS sj FROM g) SELECT m.i, m.j, g.u, m.f FROM m JOIN g ON g.i = m.si AND g.j = m.sj")
def bc_periodic(field):
    return boundary.periodic(field, G)


SEGMENTS = [("left", 1, 0.0, 0.5, "dirichlet", 1.0, 0.0, 0.0), ("left", 2, 0.5, 1.0, "neumann", 0.25, 0.0, 0.0), ("right", 1, 0.0, 1.0, "robin", 1.5, 0.5, 2.0), ("top", 1, 0.25, 0.75, "dirichlet", 3.0, 0.0, 0.0)]


@query(
    "bc_mixed_range_join",
    f"WITH {FIELD}, {near('m', 'g', 'u', 'f')}, seg(side, seg_no, s0, s1, kind, gv, alpha, beta) AS (VALUES "
    + ", ".join(f"('{a}', {b}, {c}::DOUBLE, {d}::DOUBLE, '{e}', {f}::DOUBLE, {g}::DOUBLE, {h}::DOUBLE)" for a, b, c, d, e, f, g, h in SEGMENTS)
    + "), placed AS (SELECT *, CASE WHEN j = 16 THEN 'top' WHEN j = 0 THEN 'bottom' WHEN i = 16 THEN 'right' WHEN i = 0 THEN 'left' END AS place, "
    "CASE WHEN j = 16 THEN s WHEN j = 0 THEN n WHEN i = 16 THEN w WHEN i = 0 THEN e END AS v, CASE WHEN j IN (0, 16) THEN i / 16.0::DOUBLE ELSE j / 16.0::DOUBLE END AS along FROM m), "
    "met AS (SELECT p.*, kind, gv, alpha, beta, row_number() OVER (PARTITION BY i, j ORDER BY seg_no) AS k FROM placed p LEFT JOIN seg ON place = side AND s0 <= along AND along <= s1) "
    "SELECT i, j, CASE kind WHEN 'dirichlet' THEN gv WHEN 'neumann' THEN v + 0.0625 * gv WHEN 'robin' THEN (gv + beta * v / 0.0625) / (alpha + beta / 0.0625) ELSE u END AS u, f FROM met WHERE k = 1",
)
def bc_mixed_range_join(spark, sf_dir):
    return boundary.mixed(g17(spark, sf_dir), G, spark.createDataFrame(SEGMENTS, boundary.SEGMENTS))


LAPLACIAN = f"CASE WHEN {within()} THEN ({cross(C)}) - u * {D} ELSE 0.0 END"


@on_field("laplacian", f"WITH {FIELD}, {near('m', 'g', 'u', 'f')} SELECT i, j, u, f, {LAPLACIAN} AS lap FROM m")
def laplacian(field):
    return stencil.laplacian(field, G)


@on_field("laplacian_scatter", f"WITH {FIELD}, {near('m', 'g', 'u')} SELECT i, j, round(({cross(C)}) - u * {D}, 8) AS lap FROM m WHERE {within()}")
def laplacian_scatter(field):
    return stencil.laplacian_scatter(field, G).select("i", "j", F.round("lap", 8).alias("lap"))


@on_field("stencil_at_point", f"WITH {FIELD}, {near('m', 'g', 'u')} SELECT i, j, ({cross(C)}) - u * {D} AS lap FROM m WHERE i = 5 AND j = 9")
def stencil_at_point(field):
    return stencil.stencil_at(field, G, 5, 9)


@on_field("residual", f"WITH {FIELD}, {near('m', 'g', 'u', 'f')} SELECT i, j, u, f, {RESIDUAL} AS r FROM m")
def residual(field):
    return stencil.residual(field, G)


@on_field("mixed_residual", f"WITH {FIELD}, k AS (SELECT i, j, u::FLOAT::DOUBLE AS u, f::FLOAT::DOUBLE AS f FROM g), {near('m', 'k', 'u', 'f')} SELECT i, j, u, f, {RESIDUAL} AS r FROM m")
def mixed_residual(field):
    return stencil.mixed_residual(field, G)


@on_field("mixed_correction", f"WITH {FIELD} SELECT i, j, CAST(u AS FLOAT) + CAST(0.7 AS FLOAT) * CAST(f AS FLOAT) AS u FROM g")
def mixed_correction(field):
    return stencil.mixed_correction(field, "u", "f", 0.7).select("i", "j", "u")


@on_field("restrict_injection", f"WITH {FIELD} SELECT i // 2 AS i, j // 2 AS j, u FROM g WHERE i % 2 = 0 AND j % 2 = 0")
def restrict_injection(field):
    return stencil.restrict_injection(field, G)


def coarse(value: str, source: str = "m") -> str:
    return f"SELECT i // 2 AS i, j // 2 AS j, {value} AS u FROM {source} WHERE i % 2 = 0 AND j % 2 = 0"


@on_field("restrict_full", f"WITH {FIELD}, {near('m', 'g', 'u', nine=True)} " + coarse(f"CASE WHEN {within()} THEN u * 0.25 + {RINGS} ELSE u END"))
def restrict_full(field):
    return stencil.restrict_full(field, G)


@on_field("restrict_full_zero_edge", f"WITH {FIELD}, {near('m', 'g', 'u', nine=True)} " + coarse(f"CASE WHEN {within()} THEN u * 0.25 + {RINGS} ELSE 0.0 END"))
def restrict_full_zero_edge(field):
    return stencil.restrict_full(field, G, zero_edge=True)


@on_field("restrict_half", f"WITH {FIELD}, {near('m', 'g', 'u')} " + coarse(f"CASE WHEN {within()} THEN u * 0.5 + ((e + w) + (n + s)) * 0.125 ELSE u END"))
def restrict_half(field):
    return stencil.restrict_half(field, G)


_WEIGHTS = {"u": 4.0, "e": 2.0, "w": 2.0, "n": 2.0, "s": 2.0, "ne": 1.0, "nw": 1.0, "se": 1.0, "sw": 1.0}
_TOTAL = " + ".join(f"coalesce({v} * {w}, 0.0)" for v, w in _WEIGHTS.items())
_WEIGHT = " + ".join(f"CASE WHEN {v} IS NULL THEN 0.0 ELSE {w}::DOUBLE END" for v, w in _WEIGHTS.items())


@on_field("restrict_renormalized", f"WITH {FIELD}, {near('m', 'g', 'u', nine=True)} " + coarse(f"round(({_TOTAL}) / ({_WEIGHT}), 9)"))
def restrict_renormalized(field):
    return stencil.restrict_renormalized(field, G).withColumn("u", F.round("u", 9))


FINE = "p AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM range({n}) a(i), range({n}) b(j))"


@query("prolong_injection", f"WITH {FIELD}, {FINE.format(n=33)} SELECT p.i, p.j, coalesce(g.u, 0.0) AS u FROM p LEFT JOIN g ON p.i = 2 * g.i AND p.j = 2 * g.j")
def prolong_injection(spark, sf_dir):
    return stencil.prolong_injection(g17(spark, sf_dir), G.refine(), spark)


def prolonged(name: str, source: str, n: int) -> str:
    """Bilinear interpolation of source (i, j, u) to n x n points, by joins with the four parents."""
    parent = lambda a, i, j: f"JOIN {source} {a} ON {a}.i = {i} AND {a}.j = {j}"
    joins = " ".join([parent("a", "p.i // 2", "p.j // 2"), parent("b", "(p.i + 1) // 2", "p.j // 2"), parent("c", "p.i // 2", "(p.j + 1) // 2"), parent("d", "(p.i + 1) // 2", "(p.j + 1) // 2")])
    value = "CASE WHEN p.i % 2 = 1 AND p.j % 2 = 1 THEN ((a.u + b.u) + (c.u + d.u)) * 0.25 WHEN p.i % 2 = 1 THEN (a.u + b.u) * 0.5 WHEN p.j % 2 = 1 THEN (a.u + c.u) * 0.5 ELSE a.u END"
    return f"{name} AS (SELECT p.i, p.j, {value} AS u FROM ({FINE.format(n=n)[6:-1]}) p {joins})"


@on_field("prolong_bilinear", f"WITH {FIELD}, {prolonged('q', 'g', 33)} SELECT i, j, u FROM q")
def prolong_bilinear(field):
    return stencil.prolong_bilinear(field, G.refine())


@on_field("axpy", f"WITH {FIELD} SELECT i, j, u + 0.5 * f AS u FROM g")
def axpy(field):
    return stencil.combine(field.select("i", "j", "u"), field, lambda a, b: a + F.lit(0.5) * b, other="f")


@on_field("norms", f"WITH {FIELD} SELECT round(sqrt(0.00390625 * sum(u * u)), 6) AS l2, round(sqrt(sum(CASE WHEN {within()} THEN u * u ELSE 0.0 END)), 6) AS l2_inner, max(abs(u)) AS max_norm FROM g")
def norms(field):
    return stencil.norms(field, G).select(F.round("l2", 6).alias("l2"), F.round("l2_inner", 6).alias("l2_inner"), "max_norm")


@on_field(
    "error_set",
    f"WITH {FIELD}, d AS (SELECT i, j, f AS x, u - f AS er FROM g), m AS (SELECT i, j, x, er, lead(er) OVER (PARTITION BY j ORDER BY i) AS e, lead(er) OVER (PARTITION BY i ORDER BY j) AS n FROM d), "
    "t AS (SELECT sqrt(0.00390625 * sum(er * er)) AS l2, sqrt(0.00390625 * sum(x * x)) AS xl2, max(abs(er)) AS me, max(abs(x)) AS xm, "
    "sqrt(0.00390625 * sum(CASE WHEN i < 16 AND j < 16 THEN ((e - er) / 0.0625) * ((e - er) / 0.0625) + ((n - er) / 0.0625) * ((n - er) / 0.0625) ELSE 0.0 END)) AS h1 FROM m) "
    "SELECT round(l2, 6) AS l2, round(l2 / xl2, 6) AS relative_l2, round(me, 6) AS max_error, round(me / xm, 6) AS relative_max, round(h1, 5) AS h1_semi FROM t",
)
def error_set(field):
    out = stencil.error_set(field.withColumnRenamed("f", "exact"), G)
    return out.select(*[F.round(c, 5 if c == "h1_semi" else 6).alias(c) for c in out.columns])


@on_field("cross_sections", f"WITH {FIELD} SELECT * FROM g WHERE j IN (4, 8, 12) OR i = 8")
def cross_sections(field):
    return stencil.cross_sections(field, G)


@on_field("jacobi_1", f"WITH {FIELD}, {sweep('a', 'g', 2.0 / 3.0)} SELECT i, j, u, f FROM a")
def jacobi_1(field):
    return smoothers.jacobi(field, G, 1)


@on_field("weighted_jacobi", f"WITH {FIELD}, {sweep('a', 'g', 0.8)} SELECT i, j, u, f FROM a")
def weighted_jacobi(field):
    return smoothers.jacobi(field, G, 1, 0.8)


@on_field("jacobi_3", f"WITH {FIELD}, {sweep('a', 'g', OMEGA)}, {sweep('b', 'a', OMEGA)}, {sweep('c', 'b', OMEGA)} SELECT i, j, u, f FROM c")
def jacobi_3(field):
    return smoothers.jacobi(field, G, 3, OMEGA)


@on_field("jacobi_3_tiled", f"WITH {FIELD}, {sweep('a', 'g', OMEGA)}, {sweep('b', 'a', OMEGA)}, {sweep('c', 'b', OMEGA)} SELECT i, j, round(u, 9) AS u, f FROM c")
def jacobi_3_tiled(field):
    return smoothers.tiled(field, G, 3, 6, OMEGA).withColumn("u", F.round("u", 9))


@on_field("red_black_1", f"WITH {FIELD}, {sweep('a', 'g', 1.0, 0)}, {sweep('b', 'a', 1.0, 1)} SELECT i, j, u, f FROM b")
def red_black_1(field):
    return smoothers.red_black(field, G, 1)


@on_field("red_black_1_tiled", f"WITH {FIELD}, {sweep('a', 'g', 1.0, 0)}, {sweep('b', 'a', 1.0, 1)}, {near('m', 'b', 'u', 'f')} SELECT i, j, round(u, 9) AS u, f, round({RESIDUAL}, 6) + 0.0 AS r FROM m")
def red_black_1_tiled(field):
    """A smoothing step and the residual after it, in one exchange of tiles of 6 points a side."""
    out = smoothers.tiled(field, G, 1, 6, 1.0, kind="red_black", residual="r")
    return out.withColumn("u", F.round("u", 9)).withColumn("r", F.round("r", 6) + F.lit(0.0))


@on_field("column_major", f"WITH {FIELD} SELECT i, j, row_number() OVER (ORDER BY j, i) - 1 AS place FROM g")
def column_major(field):
    return stencil.column_major(field.select("i", "j"), G)


@on_field("sor_1", f"WITH {FIELD}, {sweep('a', 'g', 1.5, 0)}, {sweep('b', 'a', 1.5, 1)} SELECT i, j, u, f FROM b")
def sor_1(field):
    return smoothers.sor(field, G, 1, 1.5)


@on_field(
    "two_grid_correction",
    f"WITH {FIELD}, {near('m', 'g', 'u', 'f')}, r AS (SELECT i, j, {RESIDUAL} AS u FROM m), {near('rn', 'r', 'u', nine=True)}, "
    + f"k AS ({coarse(f'CASE WHEN {within()} THEN u * 0.25 + {RINGS} ELSE 0.0 END', 'rn').replace(' AS u FROM', ' AS f, 0.0::DOUBLE AS u FROM')}), "
    + f"{sweep('a', 'k', OMEGA, n=9, c=64.0, d=256.0)}, {sweep('b', 'a', OMEGA, n=9, c=64.0, d=256.0)}, {prolonged('q', 'b', 17)} "
    "SELECT g.i, g.j, g.u + q.u AS u, g.f FROM g JOIN q ON g.i = q.i AND g.j = q.j",
)
def two_grid_correction(field):
    return solvers.two_grid(field, G, 2, OMEGA)


@on_field("diag_precond", f"WITH {FIELD} SELECT i, j, u AS r, CASE WHEN {within()} THEN 1.0 * u / {D} ELSE u END AS z FROM g")
def diag_precond(field):
    return Diagonal(G).apply(field.select("i", "j", F.col("u").alias("r")))


#: Spacings 1/16 and 1/8: the diagonal is 2 * 256 + 2 * 64.
STRETCHED = Grid(17, 17, 0.0, 1.0, 0.0, 2.0)


@on_field("scaled_diag_precond", f"WITH {FIELD} SELECT i, j, u AS r, CASE WHEN {within()} THEN u / {D} ELSE u END AS z, round(CASE WHEN {within()} THEN 1.5 * sqrt(2.0) * u / 640.0 ELSE u END, 9) AS z_stretched FROM g")
def scaled_diag_precond(field):
    r = field.select("i", "j", F.col("u").alias("r"))
    stretched = Diagonal(STRETCHED, 1.5).apply(r).select("i", "j", F.round("z", 9).alias("z_stretched"))
    return Diagonal(G, 1.5).apply(r).join(stretched, ["i", "j"])


def euler(name: str, source: str) -> str:
    lap = f"CASE WHEN {within()} THEN 1.0 * (({cross(C)}) - u * {D}) ELSE 0.0 END"
    return near(f"{name}_n", source, "u", "f") + f", {name} AS (SELECT i, j, CASE WHEN {within()} THEN u + 0.0005 * (({lap}) + f) ELSE u END AS u, f FROM {name}_n)"


@on_field("heat_forward_euler_2", f"WITH {FIELD}, {euler('a', 'g')}, {euler('b', 'a')} SELECT i, j, u, f FROM b")
def heat_forward_euler_2(field):
    for _ in range(2):
        field = timestep.forward_euler(field, G, 1.0, 0.0005)
    return field


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> field -> residual -> restriction -> norms."""
    down = stencil.restrict_full(stencil.residual(g17(spark, sf_dir), G), G, "r")
    return stencil.norms(down, G.coarsen(), "r").select(*[F.round(c, 6).alias(c) for c in ("l2", "l2_inner", "max_norm")])


query(
    "residual_restrict_norms",
    f"WITH {FIELD}, {near('m', 'g', 'u', 'f')}, r AS (SELECT i, j, {RESIDUAL} AS u FROM m), {near('rn', 'r', 'u', nine=True)}, k AS ({coarse(f'CASE WHEN {within()} THEN u * 0.25 + {RINGS} ELSE u END', 'rn')}) "
    "SELECT round(sqrt(0.015625 * sum(u * u)), 6) AS l2, round(sqrt(sum(CASE WHEN i BETWEEN 1 AND 7 AND j BETWEEN 1 AND 7 THEN u * u ELSE 0.0 END)), 6) AS l2_inner, round(max(abs(u)), 6) AS max_norm FROM k",
)(flagship)


def _run(field: DataFrame) -> DataFrame:
    """The field as a problem with zero boundary values, keyed by a run."""
    return boundary.zero(field, G).withColumn("run_id", F.lit("g17"))


def spectral(source: str, factor: str, digits: int, runs: bool = False) -> str:
    """A direct solve in SQL: sine transform of a column of inner points, a factor of each eigenvalue lam, and back; of every run if asked."""
    r = "run_id, " if runs else ""
    return (
        f"WITH {RUN_FIELD if runs else FIELD}, n AS (SELECT CAST(x AS INTEGER) AS a, CAST(y AS INTEGER) AS b, sin(x * y * pi() / 16) / sqrt(8.0) AS s FROM range(1, 16) p(x), range(1, 16) q(y)), "
        f"p AS (SELECT {r}i, j, {source} AS v FROM g WHERE {within()}), "
        f"a AS (SELECT {r}n.b AS k, j, sum(n.s * v) AS v FROM p JOIN n ON n.a = p.i GROUP BY ALL), b AS (SELECT {r}k, n.b AS l, sum(n.s * v) AS v FROM a JOIN n ON n.a = a.j GROUP BY ALL), "
        f"c AS (SELECT {r}k, l, v * ({factor}) AS v FROM (SELECT *, 1024 * (pow(sin(k * pi() / 32), 2) + pow(sin(l * pi() / 32), 2)) AS lam FROM b)), "
        f"d AS (SELECT {r}n.a AS i, l, sum(n.s * v) AS v FROM c JOIN n ON n.b = c.k GROUP BY ALL), e AS (SELECT {r}i, n.a AS j, sum(n.s * v) AS u FROM d JOIN n ON n.b = d.l GROUP BY ALL) "
        f"SELECT {'g.run_id, ' if runs else ''}g.i, g.j, round(coalesce(e.u, 0.0), {digits}) + 0.0 AS u FROM g LEFT JOIN e ON g.i = e.i AND g.j = e.j{' AND g.run_id = e.run_id' if runs else ''}"
    )


def solved(name: str, digits: int, factor: str, source: str = "f"):
    """Register f(field) as a query whose field must equal the direct solve."""

    def add(f):
        query(name, spectral(source, factor, digits))(lambda spark, sf_dir: f(g17(spark, sf_dir)).select("i", "j", (F.round("u", digits) + F.lit(0.0)).alias("u")))
        return f

    return add


def solved_runs(name: str, digits: int, factor: str, source: str = "f"):
    """Register f(runs) as a query; every run's field must equal its direct solve."""

    def add(f):
        query(name, spectral(source, factor, digits, runs=True))(lambda spark, sf_dir: f(runs17(spark, sf_dir)).select("run_id", "i", "j", (F.round("u", digits) + F.lit(0.0)).alias("u")))
        return f

    return add


def _by(method: str):
    return lambda runs: solvers.solve_runs(runs, G, method, 1e-11, 5000, want="field")


for _method in solvers.METHODS:
    solved_runs(f"solve_{_method}", 6, "1 / lam")(_by(_method))


@solved("solve_multigrid_distributed", 4, "1 / lam")
def solve_multigrid_distributed(field):
    """Levels of more than 9 x 9 points stay frames."""
    return solvers.solve(_run(field).drop("run_id"), G, "V", 1e-9, 20, group_points=81).field


def march(runs: DataFrame, method: str | float, **kw) -> DataFrame:
    """Two steps of 0.01 of every run, without a source."""
    return timestep.march_runs(runs.select("run_id", "i", "j", "u", F.lit(1.0).alias("alpha"), F.expr("array(0D, 0D)").alias("f"), F.expr("array(0D, 0D)").alias("edge")), G, 0.01, 2, method, 1e-10, **kw)


@solved_runs("heat_crank_nicolson", 5, "pow((1 - 0.005 * lam) / (1 + 0.005 * lam), 2)", "u")
def heat_crank_nicolson(runs):
    return march(runs, "crank_nicolson")


@solved_runs("heat_backward_euler", 5, "1 / pow(1 + 0.01 * lam, 2)", "u")
def heat_backward_euler(runs):
    return march(runs, "backward_euler")


#: The second step of BDF2 after one of backward Euler, of zero source, for each eigenvalue.
@solved_runs("heat_bdf2", 5, "(2 / (1 + 0.01 * lam) - 0.5) / (1.5 + 0.01 * lam)", "u")
def heat_bdf2(runs):
    return march(runs, "bdf2")


@solved_runs("heat_theta", 5, "pow((1 - 0.003 * lam) / (1 + 0.007 * lam), 2)", "u")
def heat_theta(runs):
    return march(runs, 0.7)
