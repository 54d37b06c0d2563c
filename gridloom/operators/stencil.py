"""Stencils, transfers between levels, norms and field algebra on frames (i, j, values).

Neighbours meet in one exchange: each point is sent to the points that need it, tagged with
where it lies from them, and each point picks its neighbours by tag. The arithmetic then has a
fixed operand order, so results do not depend on how rows were dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid

FIVE = {"e": (1, 0), "w": (-1, 0), "n": (0, 1), "s": (0, -1)}
NINE = FIVE | {"ne": (1, 1), "nw": (-1, 1), "se": (1, -1), "sw": (-1, -1)}


def gather(field: DataFrame, value: str, offsets: dict[str, tuple[int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Every row of field with columns ``value_name``, the value at (i + di, j + dj), null beyond the edge.

    ``keys`` separate several fields in one frame, such as runs or levels.
    """
    carried = [c for c in field.columns if c not in ("i", "j", *keys)]
    own = F.struct(F.col("i"), F.col("j"), F.lit(0).alias("tag"), F.col(value).alias("v"))
    sent = [F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(n).alias("tag"), F.col(value).alias("v")) for n, (di, dj) in enumerate(offsets.values(), 1)]
    spread = field.select(*keys, *[F.col(c).alias(f"__{c}") for c in carried], F.explode(F.array(own, *sent)).alias("p"))
    is_own = F.col("p.tag") == 0
    picked = [F.max(F.when(F.col("p.tag") == n, F.col("p.v"))).alias(f"{value}_{name}") for n, name in enumerate(offsets, 1)]
    kept = [F.max(F.when(is_own, F.col(f"__{c}"))).alias(c) for c in carried]
    out = spread.groupBy(*keys, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.max(is_own).alias("__own"), *kept, *picked)
    return out.where("__own").drop("__own")


def _cross(grid: Grid, v: str) -> Column:
    """Weighted sum of the four neighbours."""
    return (F.col(f"{v}_e") + F.col(f"{v}_w")) * F.lit(grid.cx) + (F.col(f"{v}_n") + F.col(f"{v}_s")) * F.lit(grid.cy)


def _drop(df: DataFrame, value: str, offsets) -> DataFrame:
    return df.drop(*[f"{value}_{n}" for n in offsets])


def laplacian(field: DataFrame, grid: Grid, value: str = "u", out: str = "lap", scale: float = 1.0) -> DataFrame:
    """Add plus the Laplacian (times scale) inside, 0 on the boundary."""
    near = gather(field, value, FIVE)
    inner = F.lit(scale) * (_cross(grid, value) - F.col(value) * F.lit(grid.diagonal))
    return _drop(near.withColumn(out, F.when(grid.inside(), inner).otherwise(F.lit(0.0))), value, FIVE)


def laplacian_scatter(field: DataFrame, grid: Grid, value: str = "u", out: str = "lap") -> DataFrame:
    """(i, j, out): every point adds its share to its neighbours; one partial aggregate, order not fixed."""
    i, j, v = F.col("i"), F.col("j"), F.col(value)
    share = lambda di, dj, c: F.struct((i + di).alias("i"), (j + dj).alias("j"), (v * F.lit(c)).alias("s"))
    parts = F.array(share(0, 0, -grid.diagonal), share(1, 0, grid.cx), share(-1, 0, grid.cx), share(0, 1, grid.cy), share(0, -1, grid.cy))
    return field.select(F.explode(parts).alias("p")).select("p.*").where(grid.inside()).groupBy("i", "j").agg(F.sum("s").alias(out))


def residual(field: DataFrame, grid: Grid, value: str = "u", rhs: str = "f", out: str = "r", shift: float = 0.0) -> DataFrame:
    """Add f - A u for A = -Laplacian + shift; 0 on the boundary."""
    near = gather(field, value, FIVE)
    inner = F.col(rhs) + (_cross(grid, value) - F.col(value) * F.lit(grid.diagonal + shift))
    return _drop(near.withColumn(out, F.when(grid.inside(), inner).otherwise(F.lit(0.0))), value, FIVE)


def mixed_residual(field: DataFrame, grid: Grid, value: str = "u", rhs: str = "f", out: str = "r") -> DataFrame:
    """Residual of single-precision fields in double arithmetic."""
    wide = field.withColumn(value, F.col(value).cast("float").cast("double")).withColumn(rhs, F.col(rhs).cast("float").cast("double"))
    return residual(wide, grid, value, rhs, out)


def mixed_correction(field: DataFrame, value: str = "u", correction: str = "e", damping: float = 1.0) -> DataFrame:
    """A single-precision field moved by a damped double-precision correction, in single precision."""
    return field.withColumn(value, F.col(value).cast("float") + F.lit(damping).cast("float") * F.col(correction).cast("float"))


def stencil_at(field: DataFrame, grid: Grid, i: int, j: int, value: str = "u", out: str = "lap") -> DataFrame:
    """The Laplacian at one inner point; only five points are read."""
    if not (1 <= i <= grid.nx - 2 and 1 <= j <= grid.ny - 2):
        raise ValueError(f"({i}, {j}) is not inside")
    near = field.where((F.abs(F.col("i") - i) + F.abs(F.col("j") - j)) <= 1)
    at = lambda a, b: F.max(F.when((F.col("i") == i + a) & (F.col("j") == j + b), F.col(value)))
    value_at = (at(1, 0) + at(-1, 0)) * F.lit(grid.cx) + (at(0, 1) + at(0, -1)) * F.lit(grid.cy) - at(0, 0) * F.lit(grid.diagonal)
    return near.agg(value_at.alias(out)).select(F.lit(i).alias("i"), F.lit(j).alias("j"), out)


def _halved(df: DataFrame) -> DataFrame:
    return df.where("i % 2 = 0 AND j % 2 = 0")


def _coarse(df: DataFrame, value: Column, out: str) -> DataFrame:
    return df.select(F.expr("cast(i div 2 as int)").alias("i"), F.expr("cast(j div 2 as int)").alias("j"), value.alias(out))


def restrict_injection(field: DataFrame, grid: Grid, value: str = "u") -> DataFrame:
    """Every second point, no exchange."""
    grid.coarsen()
    return _coarse(_halved(field), F.col(value), value)


def _restricted(field: DataFrame, grid: Grid, value: str, inner: Column, edge: Column | None) -> DataFrame:
    grid.coarsen()
    near = gather(field.select("i", "j", value), value, NINE)
    return _coarse(_halved(near), F.when(grid.inside(), inner).otherwise(F.col(value) if edge is None else edge), value)


def _ring(value: str) -> tuple[Column, Column]:
    at = lambda n: F.col(f"{value}_{n}")
    return (at("e") + at("w")) + (at("n") + at("s")), (at("ne") + at("nw")) + (at("se") + at("sw"))


def restrict_full(field: DataFrame, grid: Grid, value: str = "u", zero_edge: bool = False) -> DataFrame:
    """Full weighting inside; the boundary is injected, or zero."""
    edges, corners = _ring(value)
    return _restricted(field, grid, value, F.col(value) * 0.25 + edges * 0.125 + corners * 0.0625, F.lit(0.0) if zero_edge else None)


def restrict_half(field: DataFrame, grid: Grid, value: str = "u") -> DataFrame:
    """Half weighting inside, injection on the boundary."""
    return _restricted(field, grid, value, F.col(value) * 0.5 + _ring(value)[0] * 0.125, None)


def restrict_renormalized(field: DataFrame, grid: Grid, value: str = "u") -> DataFrame:
    """Full weighting with weights divided by the sum of those inside the grid; one exchange."""
    grid.coarsen()
    near = gather(field.select("i", "j", value), value, NINE)
    terms = [(F.col(value), 4.0)] + [(F.col(f"{value}_{n}"), 2.0 if n in FIVE else 1.0) for n in NINE]
    total, weight = F.lit(0.0), F.lit(0.0)
    for v, w in terms:
        total, weight = total + F.coalesce(v * w, F.lit(0.0)), weight + F.when(v.isNotNull(), w).otherwise(0.0)
    return _coarse(_halved(near), total / weight, value)


def prolong_injection(field: DataFrame, fine: Grid, spark: SparkSession, value: str = "u") -> DataFrame:
    """Coarse values at even points, 0 between."""
    found = field.select((F.col("i") * 2).alias("i"), (F.col("j") * 2).alias("j"), F.col(value).alias("v"))
    return fine.points(spark).select("i", "j").join(found, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias(value))


def prolong_bilinear(field: DataFrame, fine: Grid, value: str = "u") -> DataFrame:
    """Copies at even points, means of two or four parents between; parents send to their children."""
    i, j, v = F.col("i") * 2, F.col("j") * 2, F.col(value)
    steps = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    sent = F.array(*[F.struct((i + di).alias("i"), (j + dj).alias("j"), F.lit(n).alias("tag"), v.alias("v")) for n, (di, dj) in enumerate(steps)])
    children = field.select(F.explode(sent).alias("p")).select("p.*").where((F.col("i") >= 0) & (F.col("i") < fine.nx) & (F.col("j") >= 0) & (F.col("j") < fine.ny))
    at = lambda di, dj: F.col(f"p{steps.index((di, dj))}")
    picked = children.groupBy("i", "j").agg(*[F.max(F.when(F.col("tag") == n, F.col("v"))).alias(f"p{n}") for n in range(len(steps))])
    odd_i, odd_j = F.col("i") % 2 == 1, F.col("j") % 2 == 1
    # the parent at the lower index sent with step +1, the one at the upper index with step -1
    both = ((at(1, 1) + at(-1, 1)) + (at(1, -1) + at(-1, -1))) * 0.25
    out = F.when(odd_i & odd_j, both).when(odd_i, (at(1, 0) + at(-1, 0)) * 0.5).when(odd_j, (at(0, 1) + at(0, -1)) * 0.5).otherwise(at(0, 0))
    return picked.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), out.alias(value))


def combine(a: DataFrame, b: DataFrame, expression, value: str = "u", other: str = "u") -> DataFrame:
    """(i, j, value) from expression(a's value, b's value) at equal points."""
    right = b.select("i", "j", F.col(other).alias("__o"))
    return a.join(right, ["i", "j"]).select("i", "j", *[c for c in a.columns if c not in ("i", "j", value)], expression(F.col(value), F.col("__o")).alias(value))


def norms(field: DataFrame, grid: Grid, value: str = "u") -> DataFrame:
    """One aggregate: spacing-scaled L2, plain L2 of the inner points, and the largest value."""
    v = F.col(value)
    return field.agg(
        F.sqrt(F.lit(grid.hx * grid.hy) * F.sum(v * v)).alias("l2"),
        F.sqrt(F.sum(F.when(grid.inside(), v * v).otherwise(0.0))).alias("l2_inner"),
        F.max(F.abs(v)).alias("max_norm"),
    )


def error_set(field: DataFrame, grid: Grid, value: str = "u", exact: str = "exact") -> DataFrame:
    """L2, relative L2, largest and relative largest error, and the H1 seminorm of the error."""
    e = field.select("i", "j", F.col(exact).alias("x"), (F.col(value) - F.col(exact)).alias("e"))
    near = gather(e, "e", {"e": (1, 0), "n": (0, 1)})
    gx, gy = (F.col("e_e") - F.col("e")) / F.lit(grid.hx), (F.col("e_n") - F.col("e")) / F.lit(grid.hy)
    in_h1 = (F.col("i") < grid.nx - 1) & (F.col("j") < grid.ny - 1)
    area = F.lit(grid.hx * grid.hy)
    sums = near.agg(
        F.sqrt(area * F.sum(F.col("e") * F.col("e"))).alias("l2"),
        F.sqrt(area * F.sum(F.col("x") * F.col("x"))).alias("exact_l2"),
        F.max(F.abs("e")).alias("max_error"),
        F.max(F.abs("x")).alias("exact_max"),
        F.sqrt(area * F.sum(F.when(in_h1, gx * gx + gy * gy).otherwise(0.0))).alias("h1_semi"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.col(a))
    return sums.select("l2", ratio("l2", "exact_l2").alias("relative_l2"), "max_error", ratio("max_error", "exact_max").alias("relative_max"), "h1_semi")


def cross_sections(field: DataFrame, grid: Grid) -> DataFrame:
    """Rows j = ny/4, ny/2, 3ny/4 and the column i = nx/2; the filter reaches the scan."""
    rows = sorted({grid.ny // 4, grid.ny // 2, 3 * grid.ny // 4})
    return field.where(F.col("j").isin(rows) | (F.col("i") == grid.nx // 2))


def spectrum_1d(spark: SparkSession, n: int, h: float, scale: float = 1.0) -> DataFrame:
    """(k, eigenvalue) of the 1-D Laplacian, k = 1..n."""
    k = F.col("k")
    value = F.lit(-4.0 * scale / (h * h)) * F.pow(F.sin(k * F.pi() / F.lit(2.0 * (n + 1))), 2)
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("k")).select("k", value.alias("eigenvalue"))


def condition_number(spark: SparkSession, grid: Grid) -> DataFrame:
    """Of the 1-D operator with the largest spacing and fewest inner points."""
    lines = spectrum_1d(spark, min(grid.nx, grid.ny) - 2, max(grid.hx, grid.hy))
    return lines.agg(F.abs(F.max_by("eigenvalue", "k") / F.min_by("eigenvalue", "k")).alias("condition"))


def fourier_symbols(spark: SparkSession, n: int, h: float) -> DataFrame:
    """Symbols of minus the Laplacian over n by n frequencies in [0, pi), split at pi / 2.

    n is a number the caller chooses, not data.
    """
    both = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("kx"), (F.col("id") % n).cast("int").alias("ky"))
    wx, wy = F.col("kx") * F.pi() / F.lit(float(n)), F.col("ky") * F.pi() / F.lit(float(n))
    symbol = (F.lit(4.0) - F.lit(2.0) * F.cos(wx) - F.lit(2.0) * F.cos(wy)) / F.lit(h * h)
    high = (F.col("kx") * 2 >= n) | (F.col("ky") * 2 >= n)
    return both.select("kx", "ky", symbol.alias("symbol"), F.when(high, "high").otherwise("low").alias("band"))


def column_major(points: DataFrame, grid: Grid) -> DataFrame:
    """Add ``place``, the number of a point when i runs fastest; computed, not sorted."""
    return points.withColumn("place", F.col("j").cast("long") * F.lit(grid.nx) + F.col("i"))


def spectra(lines: DataFrame) -> DataFrame:
    """(n, k, eigenvalue) of the 1-D Laplacian on n inner points of the unit interval, for every n of a frame."""
    k = lines.select("n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    h = 1.0 / (F.col("n") + 1)
    return k.withColumn("eigenvalue", -4.0 / (h * h) * F.pow(F.sin(F.col("k") * F.pi() / (2.0 * (F.col("n") + 1))), 2))


def conditions(lines: DataFrame) -> DataFrame:
    """(n, condition) of the same operators: largest over least eigenvalue."""
    return spectra(lines).groupBy("n").agg(F.abs(F.max_by("eigenvalue", "k") / F.min_by("eigenvalue", "k")).alias("condition"))


def symbols(lines: DataFrame) -> DataFrame:
    """(n, kx, ky, symbol, band) of minus the Laplacian with spacing 1 / n over n by n frequencies, for every n of a frame."""
    kx = lines.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("kx"))
    both = kx.select("n", "kx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ky"))
    w = lambda k: F.col(k) * F.pi() / F.col("n")
    high = (F.col("kx") * 2 >= F.col("n")) | (F.col("ky") * 2 >= F.col("n"))
    return both.select("n", "kx", "ky", ((4.0 - 2.0 * F.cos(w("kx")) - 2.0 * F.cos(w("ky"))) * F.col("n") * F.col("n")).alias("symbol"), F.when(high, "high").otherwise("low").alias("band"))
