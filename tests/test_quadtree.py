import random

from pyspark.sql import functions as F

from gridloom.operators import quadtree


def plain(values, levels, limit):
    """Split cells by their points, then split leaves next to much finer ones until none is left."""
    n = 1 << levels

    def spread(level, ci, cj):
        s = n >> level
        inside = [values[i][j] for i in range(ci * s, ci * s + s + 1) for j in range(cj * s, cj * s + s + 1)]
        return max(inside) - min(inside)

    split = {(level, a, b) for level in range(levels) for a in range(1 << level) for b in range(1 << level) if spread(level, a, b) > limit}
    leaf_of = lambda i, j: next(level for level in range(levels + 1) if (level, i >> (levels - level), j >> (levels - level)) not in split)
    while True:
        more = set()
        for i in range(n):
            for j in range(n):
                for a, b in ((1, 0), (0, 1)):
                    if i + a < n and j + b < n:
                        p, q = leaf_of(i, j), leaf_of(i + a, j + b)
                        if abs(p - q) > 1:
                            x, y = (i, j) if p < q else (i + a, j + b)
                            level = min(p, q)
                            more.add((level, x >> (levels - level), y >> (levels - level)))
        if not more:
            return split
        split |= more


def test_split_balance_and_leaves(spark):
    rng = random.Random(7)
    for levels, noise in ((4, 0.1), (5, 0.02)):
        n = 1 << levels
        spike = (rng.randrange(n), rng.randrange(n))
        values = [[(5.0 if (i, j) == spike else 0.0) + noise * rng.random() for j in range(n + 1)] for i in range(n + 1)]
        df = spark.createDataFrame([(i, j, values[i][j]) for i in range(n + 1) for j in range(n + 1)], "i int, j int, u double")
        want = plain(values, levels, 0.5)
        split = quadtree.split_cells(df, levels, 0.5).cache()
        assert {tuple(r) for r in split.collect()} == want and split.count() == len(want)
        assert {tuple(r) for r in quadtree.split_cells(df, levels, 0.5, balanced=False).collect()} < want
        found = sorted((r["z0"], r["z1"]) for r in quadtree.leaves(split, levels).collect())
        assert found[0][0] == 0 and found[-1][1] == 4**levels and all(a[1] == b[0] for a, b in zip(found[:-1], found[1:], strict=True))
        assert abs(quadtree.quality(quadtree.leaves(split, levels), levels).agg(F.sum("share")).first()[0] - 1) < 1e-12


def test_a_level_field_is_one_leaf(spark):
    flat = spark.range(81).selectExpr("int(id div 9) i", "int(id % 9) j", "1D u")
    (leaf,) = quadtree.leaves(quadtree.split_cells(flat, 3, 0.1), 3).collect()
    assert tuple(leaf) == (0, 0, 0, 8, 0, 64)
