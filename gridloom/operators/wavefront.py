"""Lexicographic Gauss-Seidel and ILU(0) on grids of any size, as wavefronts over tiles.

A point of these methods needs its western and southern neighbours first (or, backward, the eastern
and northern ones). So does a tile: those on one anti-diagonal are independent, one tile to a task, and
get just the edges of their neighbours. Sweeps follow each other two diagonals apart, so that several
are under way at once. Values and their operand order are those of the kernels on a whole grid,
bit for bit. A step is a job; lineage is cut after each, and only tiles that moved are worked on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from ..shared import checkpoint

#: Where a tile's neighbours lie, and which edge of theirs it needs.
SIDES = {"w": (-1, 0), "s": (0, -1), "e": (1, 0), "n": (0, 1)}


def to_blocks(field: DataFrame, tile: int, *columns: str) -> DataFrame:
    """(ti, tj, ni, nj, column…): one row for each tile, its values as arrays with j fastest."""
    placed = field.select((F.col("i") / tile).cast("int").alias("ti"), (F.col("j") / tile).cast("int").alias("tj"), F.struct("i", "j", *columns).alias("p"))
    rows = placed.groupBy("ti", "tj").agg(F.sort_array(F.collect_list("p")).alias("p"), F.count_distinct("p.i").cast("int").alias("ni"), F.count_distinct("p.j").cast("int").alias("nj"))
    return rows.select("ti", "tj", "ni", "nj", *[F.col(f"p.{c}").alias(c) for c in columns])


def from_blocks(blocks: DataFrame, tile: int, *columns: str) -> DataFrame:
    """(i, j, column…) of the tiles' points."""
    points = blocks.select("ti", "tj", "nj", F.posexplode(F.arrays_zip(*columns)).alias("k", "v"))
    i, j = F.col("ti") * tile + (F.col("k") / F.col("nj")).cast("int"), F.col("tj") * tile + F.col("k") % F.col("nj")
    return points.select(i.cast("int").alias("i"), j.cast("int").alias("j"), *[F.col(f"v.{c}").alias(c) for c in columns])


def _edge(column: str, side: str):
    """Of a tile that lies on this side of another, the line of values that touches it."""
    n = F.col("nj")
    if side == "w":
        return F.slice(column, (F.col("ni") - 1) * n + 1, n)
    if side == "e":
        return F.slice(column, F.lit(1), n)
    return F.expr(f"transform(sequence(0, ni - 1), k -> {column}[k * nj{' + nj - 1' if side == 's' else ''}])")


def _step(blocks: DataFrame, moving, column: str, inputs: tuple[str, ...], kernel: Callable) -> DataFrame:
    """The tiles for which ``moving`` holds, with a new ``column`` from their inputs and the neighbours' edges."""
    sent = F.array(*[F.struct((F.col("ti") - di).alias("ti"), (F.col("tj") - dj).alias("tj"), F.lit(side).alias("side"), _edge(column, side).alias("edge")) for side, (di, dj) in SIDES.items()])
    edges = blocks.select(F.explode(sent).alias("p")).select("p.*").where(moving)
    near = edges.groupBy("ti", "tj").agg(*[F.max(F.when(F.col("side") == s, F.col("edge"))).alias(f"edge_{s}") for s in SIDES])
    rows = blocks.where(moving).join(near, ["ti", "tj"], "left")
    schema = blocks.schema
    names = [f.name for f in schema]

    def run(batches):
        import numpy as np

        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                shape = int(r.ni), int(r.nj)
                block = {c: np.asarray(getattr(r, c)).reshape(shape) for c in inputs}
                lines = {s: None if getattr(r, f"edge_{s}") is None else np.asarray(getattr(r, f"edge_{s}")) for s in SIDES}
                made.append(kernel(int(r.ti), int(r.tj), block, lines).ravel())
            pdf[column] = made
            yield pdf[names]

    # a task for each tile, or as many tasks as the session has partitions
    dealt = rows.repartition("ti", "tj")
    return dealt.mapInPandas(run, schema)


def _padded(block, lines):
    """The block within the edges of its neighbours; zeros where there is none."""
    import numpy as np

    out = np.zeros((block.shape[0] + 2, block.shape[1] + 2))
    out[1:-1, 1:-1] = block
    for side, at in (("w", np.s_[0, 1:-1]), ("e", np.s_[-1, 1:-1]), ("s", np.s_[1:-1, 0]), ("n", np.s_[1:-1, -1])):
        if lines[side] is not None:
            out[at] = lines[side]
    return out


def _diagonals(shape: tuple[int, int], backward: bool = False):
    """Places (in the padded block) of each anti-diagonal of a block, in order."""
    import numpy as np

    sums = range(shape[0] + shape[1] - 1)
    for s in reversed(sums) if backward else sums:
        i = np.arange(max(0, s - shape[1] + 1), min(shape[0] - 1, s) + 1)
        yield i + 1, s - i + 1


def _inside(grid: Grid, ti: int, tj: int, tile: int, i, j):
    """Which of these places are inner points of the grid."""
    gi, gj = ti * tile + i - 1, tj * tile + j - 1
    return (gi > 0) & (gi < grid.nx - 1) & (gj > 0) & (gj < grid.ny - 1)


def _sweep(blocks: DataFrame, grid: Grid, tile: int, column: str, inputs: tuple[str, ...], kernel: Callable, sweeps: int = 1, backward: bool = False) -> DataFrame:
    across, up = -(-grid.nx // tile), -(-grid.ny // tile)
    last = across + up - 2
    for t in range(last + 1 + 2 * (sweeps - 1)):
        under_way = [t - 2 * k for k in range(sweeps) if 0 <= t - 2 * k <= last]
        moving = (F.col("ti") + F.col("tj")).isin([last - d if backward else d for d in under_way]) & F.col("ti").between(0, across - 1) & F.col("tj").between(0, up - 1)
        blocks = checkpoint(blocks.where(~moving).unionByName(_step(blocks, moving, column, inputs, kernel)))
    return blocks


def gauss_seidel(field: DataFrame, grid: Grid, sweeps: int = 1, tile: int = 512, omega: float = 1.0, shift: float = 0.0, backward: bool = False) -> DataFrame:
    """(i, j, u, f) after lexicographic sweeps, i outer; equal to ``kernels.gauss_seidel`` on the whole grid."""
    cx, cy, diagonal = grid.cx, grid.cy, grid.diagonal

    def kernel(ti, tj, block, lines):
        u, f = _padded(block["u"], lines), block["f"]
        for i, j in _diagonals(f.shape, backward):
            inner = _inside(grid, ti, tj, tile, i, j)
            i, j = i[inner], j[inner]
            near = (u[i + 1, j] + u[i - 1, j]) * cx + (u[i, j + 1] + u[i, j - 1]) * cy
            u[i, j] = (1 - omega) * u[i, j] + omega * (f[i - 1, j - 1] + near) / (diagonal + shift)
        return u[1:-1, 1:-1]

    blocks = checkpoint(to_blocks(field, tile, "u", "f"))
    return from_blocks(_sweep(blocks, grid, tile, "u", ("u", "f"), kernel, sweeps, backward), tile, "u", "f")


def symmetric(field: DataFrame, grid: Grid, sweeps: int = 1, **kw) -> DataFrame:
    """A forward and a backward sweep, ``sweeps`` times."""
    for _ in range(sweeps):
        field = gauss_seidel(gauss_seidel(field, grid, **kw), grid, backward=True, **kw)
    return field


class TiledILU:
    """ILU(0) of -Laplacian + shift as a preconditioner on grids of any size; equal to ``kernels.ilu_apply``.

    The pivots are found once, by a wavefront of their own; each application is one forward and one backward.
    """

    def __init__(self, grid: Grid, tile: int = 512, shift: float = 0.0, modified: float = 0.0):
        self.grid, self.tile, self.shift, self.modified, self.pivots = grid, tile, shift, modified, None

    def factor(self, field: DataFrame) -> DataFrame:
        """(ti, tj, ni, nj, pivot) of the grid's tiles; ``field`` gives its points."""
        grid, tile, start = self.grid, self.tile, self.grid.diagonal + self.shift + self.modified

        def kernel(ti, tj, block, lines):
            import numpy as np

            p = _padded(block["pivot"], lines)
            for i, j in _diagonals(block["pivot"].shape):
                inner = _inside(grid, ti, tj, tile, i, j)
                i, j = i[inner], j[inner]
                d = np.full(len(i), start)
                west, south = _inside(grid, ti, tj, tile, i - 1, j), _inside(grid, ti, tj, tile, i, j - 1)
                d[west] -= grid.cx * grid.cx / p[i - 1, j][west]
                d[south] -= grid.cy * grid.cy / p[i, j - 1][south]
                p[i, j] = d
            return p[1:-1, 1:-1]

        blocks = checkpoint(to_blocks(field.select("i", "j", F.lit(0.0).alias("pivot")), tile, "pivot"))
        return _sweep(blocks, grid, tile, "pivot", ("pivot",), kernel)

    def apply(self, frame: DataFrame) -> DataFrame:
        grid, tile = self.grid, self.tile
        if self.pivots is None:
            self.pivots = self.factor(frame)

        def forward(ti, tj, block, lines):
            y, r, pivot = _padded(block["y"], lines), block["r"], block["pivot"]
            for i, j in _diagonals(r.shape):
                inner = _inside(grid, ti, tj, tile, i, j)
                i, j = i[inner], j[inner]
                y[i, j] = (r[i - 1, j - 1] + grid.cx * y[i - 1, j] + grid.cy * y[i, j - 1]) / pivot[i - 1, j - 1]
            return y[1:-1, 1:-1]

        def backward(ti, tj, block, lines):
            x, y, pivot = _padded(block["z"], lines), block["y"], block["pivot"]
            for i, j in _diagonals(y.shape, True):
                inner = _inside(grid, ti, tj, tile, i, j)
                i, j = i[inner], j[inner]
                x[i, j] = y[i - 1, j - 1] + (grid.cx * x[i + 1, j] + grid.cy * x[i, j + 1]) / pivot[i - 1, j - 1]
            return x[1:-1, 1:-1]

        zero = F.lit(0.0)
        rows = to_blocks(frame.select("i", "j", "r", zero.alias("y"), zero.alias("z")), tile, "r", "y", "z").join(self.pivots.select("ti", "tj", "pivot"), ["ti", "tj"])
        solved = _sweep(checkpoint(rows), grid, tile, "y", ("y", "r", "pivot"), forward)
        solved = _sweep(solved, grid, tile, "z", ("z", "y", "pivot"), backward, backward=True)
        out = from_blocks(solved, tile, "r", "z")
        return out.withColumn("z", F.when(grid.inside(), F.col("z")).otherwise(F.col("r")))  # the boundary is passed through
