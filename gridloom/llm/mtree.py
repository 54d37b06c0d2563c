"""Exact top-k by inner product with paged M-trees and best-first search.

Vectors become integers, floor(256 x). With one more coordinate, sqrt(largest norm^2 - norm^2),
the inner product falls as the Euclidean distance grows, so that metric trees apply. Rows are
dealt to trees by the nearest of a bounded sample of pivots, numbered and cut so that no tree has
more than TREE rows; the number of trees grows with the data. A tree's pages hold routing objects with covering radii, distances to the parent's
routing object, and, in leaves, the vectors. A search opens pages in order of their lower bound;
entries whose stored parent distance already excludes them are skipped unseen. A query searches
its own tree first, and then only trees whose ball can hold something better.

Scores are integer inner products of the stored vectors; bounds carry a slack for rounding, so
they only ever spare work. Defined results: vectors that are null, empty or hold null or
non-finite components, and rows without a vec_id, take no part; shorter vectors count as padded
with zeros; rows with the same vec_id are rows of their own, as queries and as candidates, and only
the query's own row is left out; ties go to the smaller vec_id; fewer candidates than k are all
returned; an empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table
from .sharding import number_slots

PAGE = 128  # entries of a page
TREE = 16_384  # rows of a tree
PIVOTS = 4096  # at most; a pivot with more rows than a tree holds has several trees
BLOCK = 8_192  # queries that search a tree together
FAN = 12
SLACK = 1e-6


class Page:
    """Entries of one node; ``child`` is -1 in leaves, where ``ids`` are rows and ``names`` their vec_ids."""

    __slots__ = ("leaf", "vectors", "extra", "ids", "names", "child", "radius", "parent")

    def __init__(self, leaf, vectors, extra, ids, names, child, radius, parent):
        self.leaf, self.vectors, self.extra, self.ids, self.names, self.child, self.radius, self.parent = leaf, vectors, extra, ids, names, child, radius, parent


def _distances(vectors: np.ndarray, extra: np.ndarray, to: np.ndarray, to_extra: float) -> np.ndarray:
    gap = vectors - to
    return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (extra - to_extra) ** 2)


def build(ids: np.ndarray, vectors: np.ndarray, largest: float, names: np.ndarray | None = None) -> tuple[list[Page], np.ndarray, float, float]:
    """(pages, root routing object, its extra coordinate, covering radius); page 0 is the root."""
    names = ids if names is None else names
    vectors = vectors.astype(np.float64)
    extra = np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", vectors, vectors), 0))
    pages: list[Page] = []
    root = len(ids) // 2

    def grow(rows: np.ndarray, router: int) -> tuple[int, float]:
        """Make the node of these rows below a routing object: (page, covering radius)."""
        number = len(pages)
        pages.append(None)
        away = _distances(vectors[rows], extra[rows], vectors[router], extra[router])
        if len(rows) <= PAGE:
            pages[number] = Page(True, vectors[rows], extra[rows], ids[rows], names[rows], np.full(len(rows), -1), np.zeros(len(rows)), away)
            return number, float(away.max(initial=0))
        fan = min(FAN, -(-len(rows) // PAGE))
        routers, least = [rows[int(away.argmax())]], None
        while len(routers) < fan:  # farthest first
            gap = _distances(vectors[rows], extra[rows], vectors[routers[-1]], extra[routers[-1]])
            least = gap if least is None else np.minimum(least, gap)
            if least.max() <= 0:
                break
            routers.append(rows[int(least.argmax())])
        if len(routers) < 2:  # all alike
            parts = [(routers[0], p) for p in np.array_split(rows, fan)]
        else:
            gaps = np.stack([_distances(vectors[rows], extra[rows], vectors[r], extra[r]) for r in routers])
            nearest = gaps.argmin(0)
            parts = [(r, rows[nearest == n]) for n, r in enumerate(routers) if (nearest == n).any()]
            if max(len(p) for _, p in parts) > len(rows) - PAGE // 4:  # hardly parted: cut the largest by rank
                order = rows[np.argsort(gaps[0], kind="stable")]
                parts = [(p[len(p) // 2], p) for p in np.array_split(order, fan)]
        made = [(r, *grow(p, r)) for r, p in parts]
        own = np.array([r for r, _, _ in made])
        apart = _distances(vectors[own], extra[own], vectors[router], extra[router])
        pages[number] = Page(False, vectors[own], extra[own], ids[own], names[own], np.array([c for _, c, _ in made]), np.array([x for _, _, x in made]), apart)
        return number, float(away.max())

    _, radius = grow(np.arange(len(ids)), root)
    return pages, vectors[root], float(extra[root]), radius


class Search:
    """Best-first top-k of one tree."""

    def __init__(self, pages: dict[int, Page] | list[Page], router: np.ndarray, router_extra: float, largest: float):
        self.pages, self.router, self.router_extra, self.largest = pages, router, router_extra, largest
        self.opened = self.measured = self.spared = 0

    def top(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(score, vec_id) of the best k besides row ``own``, as far as they reach the score ``floor``."""
        q = query.astype(np.float64)
        norm = float(q @ q) + self.largest
        best: list[tuple[int, int, int]] = []  # heap of (score, -vec_id, -row)

        def limit() -> float:
            """Farther objects cannot enter; those at this distance may, by their id."""
            score = best[0][0] if len(best) == k else floor
            if floor is not None and score is not None:
                score = max(score, floor)
            if score is None:
                return np.inf
            return np.sqrt(max(norm - 2 * score, 0)) * (1 + 1e-9) + SLACK

        to_root = float(np.sqrt(((self.router - q) ** 2).sum() + self.router_extra**2))
        todo, tie = [(0.0, 0, 0, to_root)], 0
        while todo:
            low, _, number, to_parent = heapq.heappop(todo)
            most = limit()
            if low > most:
                break
            page = self.pages[number]
            self.opened += 1
            near = np.flatnonzero(np.abs(to_parent - page.parent) - page.radius <= most)
            self.spared += len(page.parent) - len(near)
            self.measured += len(near)
            if not len(near):
                continue
            if page.leaf:
                scores = page.vectors[near] @ q
                if len(best) == k:
                    more = scores >= best[0][0]
                    near, scores = near[more], scores[more]
                elif floor is not None:
                    more = scores >= floor
                    near, scores = near[more], scores[more]
                if len(scores) > k + 1:
                    cut = np.partition(scores, -(k + 1))[-(k + 1)]
                    near, scores = near[scores >= cut], scores[scores >= cut]
                for i, s in zip(near.tolist(), scores.tolist(), strict=True):
                    if page.ids[i] == own:
                        continue
                    item = (int(s), -int(page.names[i]), -int(page.ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            away = _distances(page.vectors[near], page.extra[near], q, 0.0)
            lows = np.maximum(away - page.radius[near], 0)
            for i, l, a in zip(near.tolist(), lows.tolist(), away.tolist(), strict=True):
                if l <= most:
                    tie += 1
                    heapq.heappush(todo, (max(l, low), tie, int(page.child[i]), a))
        return sorted(((s, -n) for s, n, _ in best), key=lambda x: (-x[0], x[1]))


PAGES = "tree long, page int, leaf boolean, dim int, vectors binary, extra binary, ids binary, names binary, child binary, radius binary, parent binary, router binary, router_extra double, tree_radius double"
FOUND = "query long, query_id long, vec_id long, score long"


def _load(pdf) -> tuple[dict[int, Page], np.ndarray, float]:
    pages = {}
    for r in pdf.itertuples(index=False):
        f = lambda b, kind="<f8": np.frombuffer(b, kind)
        pages[int(r.page)] = Page(bool(r.leaf), f(r.vectors).reshape(-1, r.dim), f(r.extra), f(r.ids, "<i8"), f(r.names, "<i8"), f(r.child, "<i8"), f(r.radius), f(r.parent))
    first = pdf.iloc[0]
    return pages, np.frombuffer(first.router, "<f8"), float(first.router_extra)


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for n, v in enumerate(column):
        out[n, : len(v)] = v
    return out


def integer_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, v): usable vectors as integers, rows numbered and checkpointed."""
    usable = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable)
    return checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.floor(x * 256).cast("long")).alias("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (row, …), some rows of vectors (row, vec_id, v)."""
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    rows, largest, dim = vectors.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not rows:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    pivots = min(PIVOTS, -(-rows // TREE))
    dealt = checkpoint(_deal(vectors, pivots, dim))
    largest = float(largest)

    def build_trees(pdf):
        import pandas as pd

        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("row")
        pages, router, extra, radius = build(pdf["row"].to_numpy(np.int64), _matrix(pdf["v"], dim), largest, pdf["vec_id"].to_numpy(np.int64))
        b = lambda a, kind="<f8": np.ascontiguousarray(a, kind).tobytes()
        out = [(tree, n, p.leaf, dim, b(p.vectors), b(p.extra), b(p.ids, "<i8"), b(p.names, "<i8"), b(p.child, "<i8"), b(p.radius), b(p.parent), b(router), extra, radius) for n, p in enumerate(pages)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in PAGES.split(", ")])

    pages = checkpoint(dealt.groupBy("tree").applyInPandas(build_trees, PAGES))
    asked = checkpoint(dealt.join(queries.select("row").distinct(), "row", "left_semi"))
    home = checkpoint(_search(pages, asked.select("tree", "row", "vec_id", "v", F.lit(None).cast("long").alias("floor")), k, dim, largest))
    found = home
    if rows > TREE:
        reached = home.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        known = asked.join(reached, asked.row == reached.query, "left").select("row", "vec_id", "tree", "v", "floor")
        more = checkpoint(_elsewhere(known, pages, pivots, dim, largest))
        found = home.unionByName(_search(pages, more.join(asked.select("row", "vec_id", "v"), "row"), k, dim, largest))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _deal(vectors: DataFrame, pivots: int, dim: int) -> DataFrame:
    """Add ``tree``: the number of the nearest pivot, and of each TREE rows of that pivot, in one number."""
    if pivots == 1:
        return vectors.select("row", "vec_id", "v", F.lit(0).cast("long").alias("tree"))
    picked = vectors.orderBy(F.xxhash64("vec_id", "row"), "row").limit(pivots).select("v").toPandas()  # at most PIVOTS
    at = _matrix(picked["v"], dim).astype(np.float64)
    half = np.einsum("ij,ij->i", at, at) / 2

    def nearest(batches: Iterator):
        for pdf in batches:
            pdf["pivot"] = (_matrix(pdf["v"], dim) @ at.T - half).argmax(1).astype(np.int64) if len(pdf) else np.empty(0, np.int64)
            yield pdf[["row", "vec_id", "v", "pivot"]]

    named = checkpoint(vectors.mapInPandas(nearest, "row long, vec_id long, v array<long>, pivot long"))
    numbered = number_slots(named.select("row", "pivot"), "pivot", ["row"]).select("row", (F.col("pivot") + F.expr(f"slot div {TREE}") * pivots).alias("tree"))
    return named.select("row", "vec_id", "v").join(numbered, "row")


def _elsewhere(known: DataFrame, pages: DataFrame, pivots: int, dim: int, largest: float) -> DataFrame:
    """(row, tree, floor): the other trees that a query must search, by the ball around each root.

    One ball for each pivot, around its first tree's root and over all its trees, is sent to every task (at most PIVOTS);
    the trees of the pivots that remain are met in a join and tested by their own balls.
    """
    roots = checkpoint(pages.where("page = 0").select("tree", F.pmod("tree", F.lit(pivots)).alias("pivot"), "router", "router_extra", "tree_radius"))
    first = roots.groupBy("pivot").agg(F.min_by(F.struct("router", "router_extra"), "tree").alias("c"))
    apart = F.udf(lambda a, x, b, y: float(np.sqrt(((np.frombuffer(a, "<f8") - np.frombuffer(b, "<f8")) ** 2).sum() + (x - y) ** 2)), "double")
    reach = roots.join(first, "pivot").withColumn("reach", apart("router", "router_extra", "c.router", "c.router_extra") + F.col("tree_radius"))
    balls = reach.groupBy("pivot").agg(F.first("c").alias("c"), F.max("reach").alias("reach")).collect()
    numbers = np.array([r["pivot"] for r in balls])
    centres, extra = np.stack([np.frombuffer(bytes(r["c"]["router"]), "<f8") for r in balls]), np.array([r["c"]["router_extra"] for r in balls])
    radius = np.array([r["reach"] for r in balls])

    def limit(q: np.ndarray, floor) -> float:
        return np.inf if floor is None or floor != floor else np.sqrt(max(float(q @ q) + largest - 2 * float(floor), 0)) * (1 + 1e-9) + SLACK

    def near_pivots(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            out = []
            for row, tree, v, floor in zip(pdf["row"], pdf["tree"], _matrix(pdf["v"], dim).astype(np.float64), pdf["floor"], strict=True):
                low = np.maximum(_distances(centres, extra, v, 0.0) - radius, 0)
                out += [(row, tree, v.tolist(), floor, int(p)) for p in numbers[low <= limit(v, floor)]]
            yield pd.DataFrame(out, columns=["row", "own", "q", "floor", "pivot"]).astype({"floor": "Int64"})

    def near_trees(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            out = []
            for row, own, tree, q, floor, router, x, r in zip(*(pdf[c] for c in ("row", "own", "tree", "q", "floor", "router", "router_extra", "tree_radius")), strict=True):
                q = np.asarray(q, np.float64)
                away = float(np.sqrt(((np.frombuffer(router, "<f8") - q) ** 2).sum() + x * x))
                if tree != own and max(away - r, 0) <= limit(q, floor):
                    out.append((row, tree, floor))
            yield pd.DataFrame(out, columns=["row", "tree", "floor"]).astype({"floor": "Int64"})

    possible = known.mapInPandas(near_pivots, "row long, own long, q array<double>, floor long, pivot long")
    return possible.join(roots, "pivot").mapInPandas(near_trees, "row long, tree long, floor long")


def _search(pages: DataFrame, asked: DataFrame, k: int, dim: int, largest: float) -> DataFrame:
    """Search each tree for the queries (tree, row, vec_id, v, floor) sent to it, a block at a time.

    A tree's pages go only where it is asked, once for each BLOCK of its own queries.
    """

    def run(left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            search = Search(*_load(left), largest)
            for own, name, q, floor in zip(right["row"], right["vec_id"], _matrix(right["v"], dim), right["floor"], strict=True):
                out += [(own, name, found, score) for score, found in search.top(int(own), q, k, None if pd.isna(floor) else int(floor))]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])

    blocks = asked.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = asked.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    copied = pages.join(blocks, "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return copied.groupBy("tree", "block").cogroup(dealt.groupBy("tree", "block")).applyInPandas(run, FOUND)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM usable),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
