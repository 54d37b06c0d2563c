"""Queries of the problem catalogs, set-up rules and boundary records, and errors of catalog problems against direct solves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profiles
from ..grid import Grid
from ..operators import boundary, solvers, timestep
from ..sources.problems import HEAT, POISSON
from . import validation
from .analytics import BENCH, bench, rounded
from .fields import FIELD, RUN_FIELD, G, _run, g17, march, runs17, spectral

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


SS = "sin(pi() * x) * sin(pi() * y)"
CORNER = "pow(greatest(sqrt(x * x + y * y), 1e-10), 2.0::DOUBLE / 3) * sin(2.0::DOUBLE / 3 * atan2(y, x))"
# The catalogs' solutions and sources, written out once more in SQL.
POISSON_SQL = {
    "trigonometric": (SS, f"2 * pi() * pi() * {SS}"),
    "polynomial": ("x * x * (1 - x) * (1 - x) * y * y * (1 - y) * (1 - y)", "-((2 - 12 * x + 12 * x * x) * y * y * (1 - y) * (1 - y) + x * x * (1 - x) * (1 - x) * (2 - 12 * y + 12 * y * y))"),
    "exponential": ("exp(x + y)", "-2 * exp(x + y)"),
    "mixed": ("x * x * y + sin(pi() * x) * cos(pi() * y)", "-2 * y + 2 * pi() * pi() * sin(pi() * x) * cos(pi() * y)"),
    "high_frequency": ("sin(4 * pi() * x) * sin(4 * pi() * y)", "32 * pi() * pi() * sin(4 * pi() * x) * sin(4 * pi() * y)"),
    "boundary_layer": ("(exp(20 * x) - 1) / (exp(20) - 1) * sin(pi() * y)", "(-400 * exp(20 * x) + pi() * pi() * (exp(20 * x) - 1)) / (exp(20) - 1) * sin(pi() * y)"),
    "anisotropic": ("sin(pi() * x) * sin(2 * pi() * y)", "5 * pi() * pi() * sin(pi() * x) * sin(2 * pi() * y)"),
    "corner_singularity": (CORNER, "0.0"),
    "l_shaped": (CORNER, "0.0"),
    "neumann_test": ("x * x + y * y", "-4.0"),
    "linear": ("x + 2 * y", "0.0"),
    "quadratic": ("x * x + y * y + x * y", "-4.0"),
    "cubic": ("x * x * x + y * y * y", "-6 * x - 6 * y"),
    "quartic": ("pow(x, 4) + pow(y, 4)", "-12 * x * x - 12 * y * y"),
    "mixed_polynomial": ("x * x * x * y * y + x * y * y * y", "-(6 * x * y * y + 2 * x * x * x + 6 * x * y)"),
    "trig_multi": ("sin(2 * pi() * x) * sin(pi() * y) + sin(pi() * x) * sin(3 * pi() * y)", "5 * pi() * pi() * sin(2 * pi() * x) * sin(pi() * y) + 10 * pi() * pi() * sin(pi() * x) * sin(3 * pi() * y)"),
}
WAVE = "sin(pi() * (x - t)) * sin(pi() * y) * exp(-t)"
HEAT_SQL = {
    "pure_diffusion": (f"exp(-2 * pi() * pi() * t) * {SS}", "0.0"),
    "heat_source": (f"(1 - exp(-t)) * {SS}", f"(exp(-t) + 2 * pi() * pi() * (1 - exp(-t))) * {SS}"),
    "gaussian_diffusion": ("0.01::DOUBLE / (0.01::DOUBLE + 2 * t) * exp(-((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)) / (2 * (0.01::DOUBLE + 2 * t)))", "0.0"),
    "separable": (f"exp(-t) * {SS}", f"(2 * pi() * pi() - 1) * exp(-t) * {SS}"),
    "time_dependent_bc": ("t * (x + y)", "x + y"),
    "multiple_frequencies": (f"exp(-2 * pi() * pi() * t) * {SS} + 0.5 * exp(-13 * pi() * pi() * t) * sin(2 * pi() * x) * sin(3 * pi() * y)", "0.0"),
    "traveling_wave": (WAVE, f"(2 * pi() * pi() - 1) * {WAVE} - pi() * cos(pi() * (x - t)) * sin(pi() * y) * exp(-t)"),
    "polynomial_time": (f"t * t * {SS}", f"(2 * t + 2 * pi() * pi() * t * t) * {SS}"),
    "oscillating": (f"cos(2 * pi() * t) * {SS}", f"(-2 * pi() * sin(2 * pi() * t) + 2 * pi() * pi() * cos(2 * pi() * t)) * {SS}"),
}
M1, M2 = "sin(pi() * x) * cos(2 * pi() * y) * sin(3 * pi() * z)", "cos(2 * pi() * x) * sin(pi() * y) * cos(pi() * z)"
POISSON_3D_SQL = {"trigonometric_3d": (f"{SS} * sin(pi() * z)", f"3 * pi() * pi() * {SS} * sin(pi() * z)"), "trigonometric_3d_mixed": (f"{M1} + {M2}", f"14 * pi() * pi() * {M1} + 6 * pi() * pi() * {M2}")}


def listed(forms: dict, source: str, keep: str) -> str:
    """(problem, keep, u, f) of every form at every row of a source."""
    return " UNION ALL ".join(f"SELECT '{n}' AS problem, {keep}, CAST({u} AS DOUBLE) AS u, CAST({f} AS DOUBLE) AS f FROM {source}" for n, (u, f) in forms.items())




def direct(sizes, forms: dict) -> str:
    """CTEs v (problem, n, i, j, u, f at points, f with the edge folded in as r) and s, the sine basis of each size."""
    points = f"p AS (SELECT n, CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, a.i / (n - 1)::DOUBLE AS x, b.j / (n - 1)::DOUBLE AS y FROM (VALUES {', '.join(f'({n})' for n in sizes)}) z(n), range({max(sizes)}) a(i), range({max(sizes)}) b(j) WHERE a.i < n AND b.j < n)"
    basis = f"s AS (SELECT n, x.k AS a, y.k AS b, sin(x.k * y.k * pi() / (n - 1)) * sqrt(2.0 / (n - 1)) AS s FROM (VALUES {', '.join(f'({n})' for n in sizes)}) z(n), range(1, {max(sizes) - 1}) x(k), range(1, {max(sizes) - 1}) y(k) WHERE x.k < n - 1 AND y.k < n - 1)"
    return f"{points}, {basis}, v0 AS ({forms})"


FOLD = "(n - 1) * (n - 1) * (CASE WHEN i = 1 THEN lag(u) OVER x ELSE 0 END + CASE WHEN i = n - 2 THEN lead(u) OVER x ELSE 0 END + CASE WHEN j = 1 THEN lag(u) OVER y ELSE 0 END + CASE WHEN j = n - 2 THEN lead(u) OVER y ELSE 0 END)"
LAM = "4.0 * (n - 1) * (n - 1) * (pow(sin(k * pi() / (2 * (n - 1))), 2) + pow(sin(l * pi() / (2 * (n - 1))), 2))"
INNER = "i BETWEEN 1 AND n - 2 AND j BETWEEN 1 AND n - 2"


def there(by: str, value: str, source: str) -> str:
    """CTEs a, b: the sine transform of a column of a source, with more columns kept."""
    return f"a AS (SELECT {by}, s.b AS k, j, sum(s * {value}) AS v FROM {source} q JOIN s ON s.n = q.n AND s.a = q.i GROUP BY ALL), b AS (SELECT {by}, k, s.b AS l, sum(s * v) AS v FROM a q JOIN s ON s.n = q.n AND s.a = q.j GROUP BY ALL)"


BACK = "d AS (SELECT problem, q.n, s.a AS i, l, sum(s * v) AS v FROM c q JOIN s ON s.n = q.n AND s.b = q.k GROUP BY ALL), e AS (SELECT problem, q.n, i, s.a AS j, sum(s * v) AS w FROM d q JOIN s ON s.n = q.n AND s.b = q.l GROUP BY ALL)"
#: Factors of the solutions by region, as in validation.region_scales; errors follow them.
SCALES = "k AS (SELECT n_regionkey, round(CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000, 6) AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey)"
ERRORS = (
    f", {SCALES}, q AS (SELECT problem, n, sqrt(sum(off * off)) / (n - 1) AS l2, max(abs(off)) AS most FROM o GROUP BY problem, n) "
    "SELECT problem || ':' || n_regionkey AS problem, n, 1 / (n - 1)::DOUBLE AS h, round(abs(a) * l2, 7) + 0.0 AS l2_error, round(abs(a) * most, 7) + 0.0 AS max_error FROM q, k"
)
_rounded_errors = lambda errors: errors.select("problem", "n", "h", *[(F.round(c, 7) + F.lit(0.0)).alias(c) for c in ("l2_error", "max_error")])


@query(
    "mms_errors",
    f"WITH {direct((9, 17, 33), listed(POISSON_SQL, 'p', 'n, i, j'))}, v AS (SELECT *, f + {FOLD} AS r FROM v0 WINDOW x AS (PARTITION BY problem, n, j ORDER BY i), y AS (PARTITION BY problem, n, i ORDER BY j)), "
    f"t AS (SELECT * FROM v WHERE {INNER}), {there('problem, q.n', 'r', 't')}, c AS (SELECT problem, n, k, l, v / ({LAM}) AS v FROM b), {BACK}, o AS (SELECT problem, n, w - u AS off FROM e JOIN t USING (problem, n, i, j)){ERRORS}",
)
def mms_errors(spark, sf_dir):
    """Errors of every Poisson problem, scaled by region; the twin solves directly by sine transforms."""
    return _rounded_errors(validation.error_table(spark, list(POISSON), [9, 17, 33], scales=validation.region_scales(spark, sf_dir)))


#: Steps of backward Euler to t = 0.1 by size; the solution after N steps is a sum over the steps of each one's source.
STEPS = {9: 10, 17: 40}


@query(
    "heat_errors",
    f"WITH {direct(tuple(STEPS), listed(HEAT_SQL, '(SELECT p.*, m.m, 0.1::DOUBLE * m.m / z.steps AS t, z.steps FROM p JOIN (VALUES ' + ', '.join(f'({n}, {s})' for n, s in STEPS.items()) + f') z(n, steps) USING (n), range({max(STEPS.values()) + 1}) m(m) WHERE m.m <= z.steps)', 'n, steps, m, i, j'))}, "
    f"v AS (SELECT *, CASE WHEN m = 0 THEN u ELSE (f + {FOLD}) * 0.1::DOUBLE / steps END AS r FROM v0 WINDOW x AS (PARTITION BY problem, n, m, j ORDER BY i), y AS (PARTITION BY problem, n, m, i ORDER BY j)), "
    f"t AS (SELECT * FROM v WHERE {INNER}), {there('problem, q.n, steps, m', 'r', 't')}, c AS (SELECT problem, n, k, l, sum(v * pow(1 + 0.1::DOUBLE / steps * ({LAM}), CASE WHEN m = 0 THEN -steps ELSE m - 1 - steps END)) AS v FROM b GROUP BY ALL), {BACK}, "
    f"o AS (SELECT problem, n, w - u AS off FROM e JOIN t USING (problem, n, i, j) WHERE m = steps){ERRORS}",
)
def heat_errors(spark, sf_dir):
    """Errors of every heat problem, scaled by region, at t = 0.1 after backward Euler; the twin sums each mode's steps."""
    return _rounded_errors(validation.heat_error_table(spark, list(HEAT), list(STEPS), scales=validation.region_scales(spark, sf_dir)))




@query("bc_zero", f"WITH {FIELD} SELECT i, j, CASE WHEN i IN (0, 16) OR j IN (0, 16) THEN 0.0::DOUBLE ELSE u END AS u, f FROM g")
def bc_zero(spark, sf_dir):
    return boundary.homogeneous(G).apply(g17(spark, sf_dir))


ACROSS, UP = "OVER (PARTITION BY j ORDER BY i)", "OVER (PARTITION BY i ORDER BY j)"


@query("bc_insulated", f"WITH {FIELD}, a AS (SELECT i, j, f, CASE i WHEN 0 THEN lead(u) {ACROSS} WHEN 16 THEN lag(u) {ACROSS} ELSE u END AS u FROM g) SELECT i, j, CASE j WHEN 0 THEN lead(u) {UP} WHEN 16 THEN lag(u) {UP} ELSE u END AS u, f FROM a")
def bc_insulated(spark, sf_dir):
    """Zero fluxes by the manager: sides in turn, so that a corner takes the value that a side was just given."""
    return boundary.homogeneous(G, "neumann").apply(g17(spark, sf_dir))


ROBIN = "(1.0 + {v} / 0.0625) / (2.0 + 1.0 / 0.0625)"


@query("bc_radiation", f"WITH {FIELD}, a AS (SELECT *, lead(u) {ACROSS} AS e, lag(u) {ACROSS} AS w, lead(u) {UP} AS n, lag(u) {UP} AS s FROM g) SELECT i, j, round(CASE WHEN j = 16 THEN {ROBIN.format(v='s')} WHEN j = 0 THEN {ROBIN.format(v='n')} WHEN i = 16 THEN {ROBIN.format(v='w')} WHEN i = 0 THEN {ROBIN.format(v='e')} ELSE u END, 9) AS u, f FROM a")
def bc_radiation(spark, sf_dir):
    return rounded(boundary.radiation(G, 2.0, 0.5).apply(g17(spark, sf_dir)), 9, "u")


CONFIG = {"left": {"type": "dirichlet", "value": 1.5}, "right": {"type": "neumann", "value": -0.5}, "bottom": {"type": "robin", "alpha": 2.0, "beta": 1.0, "value": 1.0}, "top": {"type": "dirichlet", "amplitude": 0.5, "frequency": 2.0}}


@query(
    "bc_config",
    f"WITH {FIELD}, a AS (SELECT i, j, f, CASE i WHEN 0 THEN 1.5::DOUBLE WHEN 16 THEN lag(u) {ACROSS} - 0.5 * 0.0625 ELSE u END AS u FROM g) SELECT i, j, round(CASE j WHEN 16 THEN 0.5 * sin(2 * pi() * 2 * 0.1::DOUBLE) WHEN 0 THEN (1.0 + lead(u) {UP} / 0.0625) / (2.0 + 1.0 / 0.0625) ELSE u END, 9) AS u, f FROM a",
)
def bc_config(spark, sf_dir):
    """Conditions written as settings, at time 0.1."""
    return rounded(boundary.from_config(G, CONFIG, 0.1).apply(g17(spark, sf_dir)), 9, "u")


def _solved(name: str, digits: int, factor: str, source: str = "f"):
    def add(f):
        query(name, spectral(source, factor, digits))(lambda spark, sf_dir: f(g17(spark, sf_dir)).select("i", "j", (F.round("u", digits) + F.lit(0.0)).alias("u")))
        return f

    return add


@_solved("solve_subdomains", 4, "1 / lam")
def solve_subdomains(field):
    """Overlapping subdomains solved side by side until they agree."""
    return solvers.solve_subdomains(_run(field).drop("run_id"), G, tile=9, overlap=4, tolerance=1e-7).field


LATER = " UNION ALL ".join(f"SELECT {k} AS step, run_id, i, j, u FROM ({spectral('u', f'1 / pow(1 + 0.01 * lam, {k})', 5, runs=True)})" for k in (1, 2))
#: The first state is the field itself, whose steps of 1/8192 would not survive a transform and its inverse.
FRAMES = f"SELECT 0 AS step, run_id, i, j, round(CASE WHEN i IN (0, 16) OR j IN (0, 16) THEN 0.0 ELSE u END, 5) + 0.0 AS u FROM (WITH {RUN_FIELD} SELECT * FROM g) UNION ALL {LATER}"


@query("evolution_frames", f"SELECT step, round(step * 0.01::DOUBLE, 9) AS t, run_id, i, j, u FROM ({FRAMES})")
def evolution_frames(spark, sf_dir) -> DataFrame:
    """The states of every run as one frame, as an animation takes them."""
    states = march(runs17(spark, sf_dir), "backward_euler", want="states")
    return states.select("step", F.round(F.col("step") * 0.01, 9).alias("t"), "run_id", "i", "j", (F.round("u", 5) + F.lit(0.0)).alias("u"))


DTS = (0.0002, 0.01)


@query("stability_scan", " UNION ALL ".join(f"SELECT {dt!r}::DOUBLE AS dt, max(abs(u)) < 1e6 AS stable FROM ({spectral('u', f'pow(1 - {dt!r} * lam, 8)', 6)})" for dt in DTS))
def stability_scan(spark, sf_dir):
    return timestep.stability_scan(boundary.zero(g17(spark, sf_dir), G).withColumn("f", F.lit(0.0)), G, 1.0, list(DTS), 8).select("dt", "stable")




@query("run_aggregates", f"WITH {BENCH} SELECT prec, round(avg(discount), 6) AS avg_discount, round(stddev_pop(discount), 6) AS std_discount, round(avg(tax), 6) AS avg_tax, round(stddev_pop(tax), 6) AS std_tax, round(avg(size), 6) AS avg_iterations, round(stddev_pop(size), 6) AS std_iterations, max(size) AS max_iterations, min(size) AS min_iterations FROM b GROUP BY prec")
def run_aggregates(spark, sf_dir):
    out = profiles.run_aggregates(bench(spark, sf_dir), ["prec"], ["discount", "tax"], "size")
    return rounded(out, 6, *[c for c in out.columns if c.startswith(("avg_", "std_"))])
